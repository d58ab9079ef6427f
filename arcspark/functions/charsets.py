"""Double-byte charsets told apart by their automata and by which characters are frequent, for many texts at once.

In these charsets a byte begins a character if an even number of possible
first bytes stands right before it: the state of the automaton after every
byte of a batch follows from lengths of runs, without stepping from byte to
byte. Texts of a batch lie end to end, a blank between them. A charset is out
where a pair of bytes is none of its characters; of the others the one counts
whose characters are the most frequent kinds of its language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bytes of texts that are judged at once; the least mean weight of a text that is in one of these charsets.
BYTES_AT_ONCE, LEAST = 1 << 18, 0.5


def _set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


@dataclass
class Automaton:
    """First and second bytes of characters, bytes that are characters alone, and weights of kinds of characters."""

    name: str
    first: np.ndarray
    second: np.ndarray
    alone: np.ndarray = field(default_factory=_set)
    #: (first bytes, second bytes, weight): the first that fits counts, ``rest`` where none does.
    kinds: tuple[tuple[tuple[int, int], tuple[int, int], float], ...] = ()
    rest: float = 0.2
    alone_weight: float = 0.0
    #: A byte before some characters, left out; a first byte whose second byte is one of ``second_after``.
    before: int | None = None
    after: int | None = None
    second_after: np.ndarray | None = None
    #: Second bytes that make half of a character of four bytes.
    half: np.ndarray | None = None

    def __post_init__(self):
        self.weights = np.full((256, 256), self.rest)
        for (a, b), (c, d), weight in reversed(self.kinds):
            self.weights[a : b + 1, c : d + 1] = weight
        self.valid = np.outer(self.first, self.second)
        if self.after is not None:
            self.valid[self.after] = self.second_after
        if self.half is not None:
            self.valid |= np.outer(self.first, self.half)

    def scores(self, data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Mean weight of each row's characters beyond ASCII; -1 where a byte is out of place or there are none."""
        if self.before is not None:
            kept = data != self.before
            data, row = data[kept], row[kept]
        n = len(data)
        first, at = self.first[data], np.arange(n)
        # possible first bytes in a run right before each byte
        last = np.maximum.accumulate(np.where(first, -1, at))
        run = at - 1 - np.concatenate([[-1], last[:-1]])
        begins = run % 2 == 0
        pair = np.flatnonzero(begins & first)
        pair = pair[pair + 1 < n]
        whole = row[pair] == row[pair + 1]  # a character may be cut off at a text's end
        pair = pair[whole]
        a, b = data[pair], data[pair + 1]
        bad = np.zeros(rows)
        bad += np.bincount(row[pair], ~self.valid[a, b], rows)
        single = np.flatnonzero(begins & ~first & (data >= 0x80))
        bad += np.bincount(row[single], ~self.alone[data[single]], rows)
        if self.half is not None:
            bad += np.bincount(row[pair], self.half[b], rows) % 2
        count = np.bincount(row[pair], minlength=rows) + np.bincount(row[single], minlength=rows)
        total = np.bincount(row[pair], self.weights[a, b], rows) + self.alone_weight * np.bincount(row[single], minlength=rows)
        return np.where((bad == 0) & (count > 0), total / np.maximum(count, 1), -1.0)


_HIGH = (0xA1, 0xFE)
_ANY = (0x40, 0xFE)
# The charsets' bytes, and where their standards put kana, hangul and the frequent ideographs.
AUTOMATA = (
    Automaton("Shift_JIS", _set((0x81, 0x9F), (0xE0, 0xFC)), _set((0x40, 0x7E), (0x80, 0xFC)), _set((0xA1, 0xDF)), (((0x82, 0x82), (0x9F, 0xF1), 2.0), ((0x83, 0x83), (0x40, 0x96), 2.0), ((0x88, 0x97), _ANY, 1.2), ((0x81, 0x81), _ANY, 0.5)), alone_weight=-1.0),
    Automaton("EUC-JP", _set((0x8E, 0x8E), _HIGH), _set(_HIGH), kinds=(((0xA4, 0xA5), _HIGH, 2.0), ((0xB0, 0xCF), _HIGH, 1.2), ((0xA1, 0xA1), _HIGH, 0.5), ((0x8E, 0x8E), _HIGH, -1.0)), before=0x8F, after=0x8E, second_after=_set((0xA1, 0xDF))),
    Automaton("EUC-KR", _set(_HIGH), _set(_HIGH), kinds=(((0xB0, 0xC8), _HIGH, 1.6), ((0xA1, 0xA1), _HIGH, 0.5), ((0xCA, 0xFD), _HIGH, 0.3)), rest=0.1),
    Automaton("GB2312", _set((0xA1, 0xF7)), _set(_HIGH), kinds=(((0xB0, 0xD7), _HIGH, 1.2), ((0xA1, 0xA1), _HIGH, 0.5), ((0xA3, 0xA3), _HIGH, 0.5))),
    Automaton("Big5", _set((0x81, 0xFE)), _set((0x40, 0x7E), _HIGH), kinds=(((0xA4, 0xC6), _ANY, 1.2), ((0xA1, 0xA1), _ANY, 0.5))),
    Automaton("GB18030", _set((0x81, 0xFE)), _set((0x40, 0x7E), (0x80, 0xFE)), kinds=(((0xB0, 0xD7), _HIGH, 1.14), ((0xA1, 0xA1), _HIGH, 0.45), ((0xA3, 0xA3), _HIGH, 0.45)), rest=0.3, half=_set((0x30, 0x39))),
)


def scores_of(texts: list[bytes]) -> np.ndarray:
    """Each automaton's scores of all texts; the blanks between them belong to none."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.asarray([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    row[np.cumsum(sizes) - 1] = -1
    return np.stack([a.scores(data, row, len(texts)) for a in AUTOMATA])


def double_byte(texts: list[bytes]) -> list[str | None]:
    """The likeliest double-byte charset of each text; None where none fits. Of equal ones the first named counts."""
    out: list[str | None] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BYTES_AT_ONCE):
            size += len(texts[end])
            end += 1
        some = texts[at:end]
        scores = scores_of(some)
        best = scores.argmax(0)
        out += [AUTOMATA[i].name if scores[i, k] > LEAST else None for k, i in enumerate(best.tolist())]
        at = end
    return out
