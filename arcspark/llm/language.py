"""Language ID by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent letter n-grams over
every learnable text. A document is ranked the same way and goes to the
profile from which its n-grams are least out of place.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspark.llm.common import text_of

#: Bits of a letter in an n-gram's number; a run of other characters is symbol 0.
LETTER_BITS = 20
#: N-grams in a profile; n-grams of all languages whose counts a task holds before it passes them on.
PROFILE, HELD = 300, 400_000
#: Languages that there may be: their profiles go to the driver and every worker.
LANGUAGES = 1000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> the letter in lower case, 0 for what is no letter or mark of one."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                table[code] = ord(c.lower()[0])
            elif unicodedata.category(c) in ("Mn", "Mc"):
                table[code] = code
        _letters = table
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Numbers of the text's 1-, 2- and 3-grams, every letter of every script apart; words begin and end with symbol 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[0], letters()[codes], [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
    two = s[:-1] << LETTER_BITS | s[1:]
    three = (two[:-1] << LETTER_BITS | s[2:])[s[1:-1] > 0]
    # the last two bits tell the length
    return np.concatenate([s[s > 0] * 4 + 1, two * 4 + 2, three * 4 + 3])


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ids, return_counts=True)


def top(ids: np.ndarray) -> np.ndarray:
    """The most frequent ids, most frequent first, lower ids first among equals."""
    kept, counts = counted(ids)
    return kept[np.argsort(-counts, kind="stable")[:PROFILE]]


@dataclass
class Profiles:
    """Languages and, for each n-gram that any of them ranks, the entries (language, rank) from ``starts`` on."""

    langs: list[str]
    ids: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        """From (language, n-gram, rank)."""
        langs = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(langs)}
        entries = np.asarray(sorted((r[1], place[r[0]], r[2]) for r in rows), np.int64).reshape(-1, 3)
        ids, starts = np.unique(entries[:, 0], return_index=True)
        return cls(langs, ids, np.append(starts, len(entries)), entries[:, 1].astype(np.int16), entries[:, 2].astype(np.int16))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        ids = ngrams(text)
        own = top(ids)
        at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        known = np.flatnonzero(self.ids[at] == own)
        # an n-gram that a language does not rank is PROFILE places out
        first, n = self.starts[at[known]], self.starts[at[known] + 1] - self.starts[at[known]]
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        nearer = PROFILE - np.abs(self.rank[entry] - np.repeat(known, n))
        distance = (PROFILE * len(own) - np.bincount(self.lang[entry], nearer, len(self.langs))) / (PROFILE * len(own))
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles from every row of ``docs`` with a language and a text."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                ids, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n for _, n in parts]), len(ids)).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(n)], ["lang", "id", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, n = counted(ngrams(text))
                parts = held.setdefault(lang, [])
                parts.append((ids, n))
                size += len(ids)
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(count, "lang string, id long, n long").groupBy("lang", "id").agg(F.sum("n").alias("n"))
    # the best of parts of a language first, so that no task orders all of a large language's n-grams
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    first = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "id"))).where(F.col("place") <= PROFILE).drop("place")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "id")
    best = first.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE).select("lang", "id", "rank")
    best = best.limit(LANGUAGES * PROFILE + 1).collect()
    if len(best) > LANGUAGES * PROFILE:
        raise ValueError(f"over {LANGUAGES} languages: their profiles would not be small")
    return Profiles.of([(r["lang"], r["id"], r["rank"]) for r in best])


def id_remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1 less the mean displacement).

    Learns from every row outside fold 0 whose language is given, repeated
    rows each. Null texts, texts without letters, and any text if nothing
    could be learnt, are ``und`` with score 0; equal distances go to the
    language first in order. Rows without an id are judged and learnt from as
    if their id were empty. An empty table gives no rows; other columns are
    not looked at. Texts are taken whole: a task holds some 100 bytes for each
    character of one. More than LANGUAGES languages are an error.
    """
    fold = id_remainder(id_col, folds)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.where(fold != 0), lang_col, text_col))

    def predict(batches):
        for batch in batches:
            found = [shared.value.predict(text) for text in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == 0).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
