"""SentencePiece encoding and decoding for merge-type vocabularies, without the library on the main path.

A text's characters are symbols; an agenda holds the adjacent pairs whose
union is a piece, best score first and leftmost among equals, and is worked
off until it is empty. What stays and is no piece falls back to its bytes.

Pieces never reach over some places: before a run of blanks, and between two
characters that are neighbours in no piece. A text is cut there, each distinct
cut is encoded once a worker, and a bounded cache keeps its ids. The cuts that an
Arrow batch brings anew are checked against the library together, encoded and
decoded.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import Kept, id_and_text, in_runs

#: The mark that stands for a blank (a fixed value of the format).
BLANK = "▁"
#: Cuts that a worker's cache keeps, and the characters that one of them may have to be kept.
WORKER_CACHE, KEPT_CHARS = 700_000, 64
#: Fixed values of the model file's format: field numbers, the type that merges, the kinds of pieces.
PIECES, TRAINER, NORMALIZER, PIECE, SCORE, KIND, MODEL_TYPE, BYTE_FALLBACK, SUFFIX_BLANKS, CHARS_MAP, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE = 1, 2, 3, 1, 2, 3, 3, 35, 24, 2, 3, 4, 5
MERGES, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6
#: What the unknown piece decodes to (a fixed value of the library).
UNKNOWN_TEXT = " \u2047 ".encode()
#: Characters up to which a run's agenda is a list.
FEW = 40
_RUNS = re.compile("(?:^| )( *[^ ]*)")

codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
            yield tag >> 3, value
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        if size is None:
            size, at = _number(data, at)
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """A merge-type vocabulary: ids and scores of pieces, and where texts may be cut."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(x for k, v in message if k == TRAINER for x in _fields(v))
        normal = dict(x for k, v in message if k == NORMALIZER for x in _fields(v))
        if trainer.get(MODEL_TYPE) != MERGES or trainer.get(SUFFIX_BLANKS):
            raise ValueError("not a merge-type vocabulary with blanks before words")
        if normal.get(CHARS_MAP) or normal.get(EXTRA_BLANKS, 1) or not normal.get(ESCAPE, 1) or not normal.get(DUMMY_PREFIX, 1):
            raise ValueError("the vocabulary's normaliser changes characters or blanks")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.pieces: list[bytes] = []
        self.unknown, self.fallback = 0, bool(trainer.get(BYTE_FALLBACK))
        for i, piece in enumerate(dict(_fields(v)) for k, v in message if k == PIECES):
            text, kind = piece[PIECE].decode(), piece.get(KIND, NORMAL)
            if kind == NORMAL:
                self.ids[text], self.scores[text] = i, struct.unpack("<f", piece.get(SCORE, b"\0\0\0\0"))[0]
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind != CONTROL:
                raise ValueError("the vocabulary has pieces of its own kinds")
            self.pieces.append(text.replace(BLANK, " ").encode() if kind == NORMAL else bytes([int(text[3:5], 16)]) if kind == BYTE else UNKNOWN_TEXT if kind == UNKNOWN else b"")
        #: Pieces that begin with a blank.
        self.words = {i for p, i in self.ids.items() if p.startswith(BLANK)}
        long = [p for p in self.ids if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in long):
            raise ValueError("the vocabulary's pieces reach over blanks")
        # best score first, lower ids first among equals: a rank a piece
        order = sorted(self.ids, key=lambda p: (-self.scores[p], self.ids[p]))
        self.ranks = {}
        for p in order:
            same = self.ranks and self.scores[p] == self.scores[last]
            self.ranks[p], last = len(self.ranks) if not same else self.ranks[last], p
        self.longest = max(map(len, long), default=1)
        #: Neighbours that some piece holds: between any others a text may be cut.
        self.joined = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        #: The line feed, where it joins nothing.
        self.apart = "\n" if "\n" not in self.ids and not any("\n" in x for x in self.joined) else None

    def keys(self, text: str) -> list[str]:
        """The text cut before its blanks and line feeds. A key's first blank, where it had one, is left out."""
        if not text:
            return []
        text = text.replace(BLANK, " ")  # the same to the vocabulary
        s = text.replace(self.apart, " " + self.apart) if self.apart else text
        return s.split(" ") if s[0] != " " and "  " not in s else _RUNS.findall(s)

    def alone(self, key: str) -> int:
        """Where the characters begin, at a key's end, that join nothing, as most signs do: what stands before them may be known."""
        n = len(key)
        while n > 1 and key[n - 2] != " " and key[n - 2 : n] not in self.joined:
            n -= 1
        return n

    def cut(self, key: str) -> str:
        """What a key stands for, blanks marked. Before a line feed one blank is ours."""
        word = key.lstrip(" ")
        return BLANK * (len(key) - len(word) + (not (self.apart and word.startswith(self.apart)))) + word

    def encode(self, marked: str) -> list[int]:
        """Ids of a text whose blanks are marked, or of a cut of one."""
        if len(marked) <= FEW:
            symbols = self._few(marked)
        else:
            ends = [*(i for i in range(1, len(marked)) if marked[i - 1 : i + 1] not in self.joined), len(marked)]
            symbols = [s for a, b in zip([0, *ends[:-1]], ends, strict=True) for s in (self._few if b - a <= FEW else self._many)(marked[a:b])]
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in self._spelled(s)]

    def _spelled(self, symbol: str) -> list[int]:
        """Ids of a symbol, which may be no piece."""
        if (i := self.ids.get(symbol)) is not None:
            return [i]
        return [self.bytes[x] for x in symbol.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def _few(self, run: str) -> list[str]:
        """The agenda as a list of ranks by place: the least is the best, the first of equals the leftmost."""
        rank, none = self.ranks.get, len(self.ranks)
        symbols = list(run)
        agenda = [rank(a + b, none) for a, b in zip(run, run[1:])]  # noqa: B905
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + both, none)
        return symbols

    def _many(self, run: str) -> list[str]:
        """The agenda as a heap; an entry is stale once one of its symbols has grown or gone."""
        rank, n = self.ranks.get, len(run)
        symbols = list(run)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, a, a + 1, run[a : a + 2]) for a in range(n - 1) if (r := rank(run[a : a + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or after[a] != b or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, ""
            after[a] = end = after[b]
            if end < n:
                before[end] = a
            for x, y in ((before[a], a), (a, end)):
                if x >= 0 and y < n and len(symbols[x]) + len(symbols[y]) <= self.longest and (r := rank(symbols[x] + symbols[y])) is not None:
                    heapq.heappush(agenda, (r, x, y, symbols[x] + symbols[y]))
        return [s for s in symbols if s]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``. The blank that begins the first piece goes; bytes that are no characters become U+FFFD."""
        data = b"".join([self.pieces[i] for i in ids])
        if data.startswith(b" ") and next(i for i in ids if self.pieces[i]) in self.words:
            data = data[1:]
        return data.decode("utf-8", "each_byte")


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=4)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Encoder(Kept):
    """key -> ids; ``learn`` encodes the missing ones and checks them in one call.

    Holds up to WORKER_CACHE entries, and those it held before it was last
    full: what is used again moves over, the rest goes.
    """

    def __init__(self, path: str):
        super().__init__()
        self.model, self.library = model(path), library(path)
        self._numbers = list(range(len(self.model.pieces)))  # one object a number, for all entries
        self._before: dict[str, tuple[int, ...]] = {}
        self.differ: set[str] = set()

    def clear(self) -> None:
        super().clear()
        self._before = {}
        self.differ.clear()

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self[key] = self._before[key]
        return ids

    def _agree(self, cuts: list[str], ids: list[list[int]]) -> bool:
        """Whether the library gives these ids and decodes them as we do, all cuts in one text that line feeds keep apart."""
        apart = self.model.apart
        if apart is None:
            return False
        feed = self.model.encode(apart)
        own = [*self.model.encode(BLANK), *chain.from_iterable(chain(feed, x) for x in ids)]
        return self.library.encode(apart + apart.join(cuts).replace(BLANK, " ")) == own and self.library.decode(own) == self.model.decode(own)

    def _given(self, cut: str) -> list[int]:
        """The library's ids of one cut. Without a line feed to set it apart it must begin with a blank."""
        apart = self.model.apart
        if apart is None:
            return self.library.encode(cut.removeprefix(BLANK).replace(BLANK, " "))
        return self.library.encode(apart + cut.replace(BLANK, " "))[len(self.library.encode(apart)) :]

    def learn(self, keys: set[str]) -> dict[str, tuple[int, ...]]:
        """Keep the ids of the keys; those of long ones are returned and not kept. ``differ`` holds keys that the library encodes otherwise."""
        if len(self) > WORKER_CACHE:
            self._before = dict(self)
            super().clear()
            self.differ &= self._before.keys()
        own, number = self.model, self._numbers.__getitem__
        heads, new = {}, []
        for k in keys.difference(self).difference(self._before):
            if (head := k[: own.alone(k)]) != k:
                new.append(k)
            if head not in self and head not in self._before:
                heads[head] = None
        long = {}
        for head in heads:
            (self if len(head) <= KEPT_CHARS else long)[head] = tuple(map(number, own.encode(own.cut(head))))
        found = [long.get(h) or self[h] for h in heads]
        for k in new:
            n = own.alone(k)
            ids = (long.get(k[:n]) or self[k[:n]]) + tuple(number(i) for c in k[n:] for i in own._spelled(c))
            (self if len(k) <= KEPT_CHARS else long)[k] = ids
            found.append(ids)
        fresh = [*heads, *new]
        if fresh and not self._agree([own.cut(k) for k in fresh], found):
            for k, ids in zip(fresh, found, strict=True):
                if (given := tuple(self._given(own.cut(k)))) != ids:
                    (self if len(k) <= KEPT_CHARS else long)[k] = given
                    self.differ.add(k)
        return long


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].take()


def encoded(texts: list[str], own: Encoder) -> Iterator[tuple[list[int], bool]]:
    """The ids of each text, and whether the library gave the same for all its cuts."""
    cut = [own.model.keys(t) for t in texts]
    long = own.learn(set(chain.from_iterable(cut)))
    get = own.__getitem__ if not long else lambda k: long.get(k) or own[k]
    for keys in cut:
        yield [*chain.from_iterable(map(get, keys))], not own.differ or own.differ.isdisjoint(keys)


def encode(docs: DataFrame, model_file: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int, with the id ``end`` last, if any), agreed (the library gives the same).

    Null and empty texts have the end id only. Repeated rows, and rows without
    an id, are encoded each; an empty table gives no rows; other columns are
    not looked at. Texts are taken whole, some megabytes of a batch at a time:
    a task holds some 60 bytes a token of them, and some 300 bytes a character
    of the longest stretch without blanks. Where the library differs its ids
    are given and ``agreed`` is false.
    """
    last = [] if end is None else [end]

    def work(batches):
        own = encoder(model_file)
        for batch in batches:
            for a, b, texts in in_runs(batch.column(1)):
                out = [([*ids, *last], agreed) for ids, agreed in encoded(texts, own)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out], pa.bool_())], ["doc_id", "ids", "agreed"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, agreed boolean")


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text of its ids, agreed (the library gives the same; where not, its text is given).

    Null ids give an empty text. Ids outside the vocabulary are an error.
    """

    def work(batches):
        own, check = model(model_file), library(model_file)
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            given = check.decode(ids, num_threads=1)
            yield pa.record_batch([batch.column(0), pa.array(given, pa.string()), pa.array([own.decode(x) == t for x, t in zip(ids, given, strict=True)], pa.bool_())], ["doc_id", "text", "agreed"])

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, agreed boolean")


def piece_report(docs: DataFrame, model_file: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, agreed: ``encode`` and ``decode`` in one pass, digests only.

    Rows as in ``encode``; null texts count as empty.
    """

    def work(batches):
        own = encoder(model_file)
        number = [str(i) for i in range(len(own.model.pieces))]
        for batch in batches:
            for a, b, texts in in_runs(batch.column(1)):
                ids, agreed = [], []
                for own_ids, same in encoded(texts, own):
                    own_ids.append(end)
                    ids.append(own_ids)
                    agreed.append(same)
                said = [hashlib.sha256(" ".join([number[i] for i in x]).encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(own.model.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(map(len, ids), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string()), pa.array(agreed, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean")
