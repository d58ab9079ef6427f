"""Splitting texts into pre-tokens as the library's own patterns do.

The fast split is used for texts made only of characters that Unicode has had
since version 3.2, in the class they still have: all common scripts, marks and
signs. Any other text (newer scripts, most emoji, rare blanks and controls),
any that the normaliser would compose, and any that holds a special token's
string goes to the tokenizer library as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

from arcspark.llm.common import Kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters whose lower case depends on their neighbours or that the library maps otherwise.
_APART = {0x3A3}


def _kind(category: str) -> str:
    """L, N, or O for all else; '' for what has no stable class."""
    return "" if category[0] == "C" and category != "Cf" or category[0] == "Z" else category[0] if category[0] in "LN" else "O"


def _stable() -> dict[str, list[tuple[int, int]]]:
    """Ranges of code points by kind: those of the same kind in Unicode 3.2 and now."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "O": []}
    for code in range(0x20, 0x30000):
        c = chr(code)
        kind = _kind(unicodedata.ucd_3_2_0.category(c))
        if not kind or kind != _kind(unicodedata.category(c)) or code in _APART or c.isspace():
            continue
        own = ranges[kind]
        if own and own[-1][1] == code - 1:
            own[-1][1] = code
        else:
            own.append([code, code])
    return {k: [(a, b) for a, b in v] for k, v in ranges.items()}


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_S = r"\t\n\r "
_RANGES = _stable()
#: Below this code point, the Latin letters, patterns are a table look-up; beyond, a search through ranges.
_NARROW = 0x250


def _patterns(below: int) -> tuple[re.Pattern, dict[str, re.Pattern]]:
    """What may stand in a text of characters below ``below``, and how it is split."""
    letters, digits, others = (_class([(a, min(b, below - 1)) for a, b in r if a < below]) for r in _RANGES.values())
    # The split patterns that the two tokenizer files name.
    word_end = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_S}{letters}{digits}]+"
    byte_level = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{_S}{letters}{digits}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
    return re.compile(f"[{_S}{letters}{digits}{others}]*"), {"word_end": re.compile(word_end), "byte_level": re.compile(byte_level)}


_LATIN, _ALL = _patterns(_NARROW), _patterns(0x30000)


def split(text: str, how: str) -> list[str] | None:
    """The text's pre-tokens, ``how`` = "word_end" or "byte_level"; None if only the library can tell.

    Before it splits at word ends, the library composes characters and lower-cases them.
    """
    if "<|" in text:
        return None
    latin = _LATIN[0].fullmatch(text) is not None
    if not latin and (_ALL[0].fullmatch(text) is None or how == "word_end" and not unicodedata.is_normalized("NFC", text)):
        return None
    return (_LATIN if latin else _ALL)[1][how].findall(text.lower() if how == "word_end" else text)


class Cache(Kept):
    """Pre-token -> value; misses are encoded and kept, within a bound, by the worker until another operator's cache is taken."""

    def __init__(self, encode: Callable[[str], object], frequent: dict, bound: int):
        super().__init__()
        self._encode, self._frequent, self._bound = encode, frequent, bound + len(frequent)

    def take(self) -> Cache:
        super().take()
        if not self:
            self.update(self._frequent)
        return self

    def __missing__(self, word: str):
        if len(self) >= self._bound:
            self.clear()
            self.update(self._frequent)
        value = self[word] = self._encode(word)
        return value
