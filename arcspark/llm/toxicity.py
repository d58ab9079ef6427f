"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, are estimated from every learnable
labelled row with absolute discounting: bigram, then word, then word stem
(its first letters), each level interpolated with the next. The last level
and a word's share of its stem come from counts that both classes share, and
an n-gram counted less than MIN_COUNT times takes its backoff's difference.
Each other difference is averaged with its backoff's by how likely it is to
be real: by its evidence (how much better two rates explain its counts than
one, in nats) and its size. A document's score is the difference of the two models'
log-likelihoods, normalised by its length, through a logistic calibration.

A document counts each of its different bigrams once, so that repeated
passages do not outvote the rest.
All counts are gathered over all learnable rows and grow with them, and so
does the model: every n-gram whose difference is not its backoff's takes part
in every score. The LOCAL most frequent of them are broadcast; texts are
joined with the table of all others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import CACHE_WORDS, Kept, id_and_text, in_runs, joined, materialize, mix, new_scope, packed, sized, sweep, text_of
from arcspark.llm.language import id_remainder

#: Kneser-Ney discount; pooled count below which an n-gram is rare; letters of a stem.
DISCOUNT, MIN_COUNT, STEM = 0.75, 4, 4
#: Nats of evidence at which a difference is as likely real as not.
DOUBT = 10.0
#: N-grams that are broadcast, at 12 bytes each; past it the join shuffles. Bits of the cells that tell what to send.
LOCAL, CELL_BITS = 3_000_000, 27
#: Rows of each class that the calibration is fitted on at most.
CALIBRATION_ROWS = 20_000
#: Bigrams that a task holds before it passes their counts on.
HELD = 1_000_000

_NOT_WORD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: A bigram in one number: 20 bits of the stem, 20 of the word within it, 24 of the word before.
STEM_BITS, WORD_BITS, BEFORE_BITS = 20, 20, 24
_LEVELS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_PARTS = ["_text", "n", "total", "name", "times"]
_START = 0x9E3779B9 & ((1 << BEFORE_BITS) - 1)


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_NOT_WORD).split()


class _Codes(Kept):
    """Token -> its stem's and its own bits of a bigram, and in the low bits what the next token has of it."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        own, stem = xxhash.xxh3_64_intdigest(token), xxhash.xxh3_64_intdigest(token[:STEM])
        word = own & ((1 << WORD_BITS) - 1)
        code = self[token] = (stem >> (64 - STEM_BITS) << WORD_BITS | word) << BEFORE_BITS | own >> (64 - BEFORE_BITS)
        return code


_codes = _Codes()
_BEFORE = np.uint64((1 << BEFORE_BITS) - 1)


def keys_of(tokens: list[bytes]) -> np.ndarray:
    """The bigram of each token, as one number."""
    codes = np.fromiter(map(_codes.take().__getitem__, tokens), np.uint64, len(tokens))
    before = np.concatenate([np.asarray([_START], np.uint64), codes[:-1] & _BEFORE])
    return codes & ~_BEFORE | before


def word_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, BEFORE_BITS)


def bigram_counts(rows: DataFrame) -> DataFrame:
    """Rows (toxic, text) -> (key, toxic, ordinary), summed over all rows."""

    def count(batches):
        held, size = ([], []), 0

        def out():
            key = np.concatenate([*held[1], *held[0]])
            n_toxic = sum(map(len, held[1]))
            held[0].clear()
            held[1].clear()
            found, at = np.unique(key, return_inverse=True)
            toxic, ordinary = (np.bincount(x, minlength=len(found)).astype(np.int32) for x in (at[:n_toxic], at[n_toxic:]))
            return pa.record_batch([pa.array(found.view(np.int64)), pa.array(toxic), pa.array(ordinary)], ["key", "toxic", "ordinary"])

        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for a, _, texts in in_runs(batch.column(1)):
                for i, text in enumerate(texts, a):
                    if tokens := words(text):
                        keys = np.unique(keys_of(tokens))
                        held[toxic[i]].append(keys)
                        size += len(keys)
                        if size >= HELD:
                            yield out()
                            size = 0
        if size:
            yield out()

    parts = rows.mapInArrow(count, "key long, toxic int, ordinary int")
    return parts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _less(n: Column) -> Column:
    return F.greatest(n - DISCOUNT, F.lit(0.0))


def _names(part: np.ndarray, level: int) -> np.ndarray:
    """One hash for stems, words and bigrams alike."""
    return mix(part ^ _LEVELS[level])


@dataclass
class Model:
    """What each n-gram adds to the difference (toxic less ordinary log-probability) of its backoff; calibration weights.

    The most frequent n-grams are arrays that every worker holds. The others
    lie in the table ``rest``, which texts are joined with; ``cells`` marks
    the hash cells they fall in, so that only what may be there is sent.
    """

    names: np.ndarray
    adds: np.ndarray
    rest: DataFrame | None
    cells: np.ndarray | None
    weights: np.ndarray

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        return self.names, self.adds, self.cells

    def score(self, n: Column, total: Column) -> Column:
        """From a text's length and the difference of its log-likelihoods; over the length, and over its square root."""
        long = F.greatest(n, F.lit(1)).cast("double")
        a, b, c = map(float, self.weights)
        x = total / long * a + total / F.sqrt(long) * b + c
        return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def _measure(texts: list[str], names: np.ndarray, adds: np.ndarray, cells: np.ndarray | None):
    """Per text its length and the sum over the n-grams held; and (text, name, times) of those that may be in the rest."""
    keys = [keys_of(words(t)) for t in texts]
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    owner, keys = np.repeat(np.arange(len(texts)), lengths), np.concatenate([np.zeros(0, np.uint64), *keys])
    total, asked = np.zeros(len(texts)), []
    for level, part in enumerate((keys >> np.uint64(BEFORE_BITS + WORD_BITS), keys >> np.uint64(BEFORE_BITS), keys)):
        name, at = np.unique(_names(part, level), return_inverse=True)
        place = np.minimum(np.searchsorted(names, name), max(len(names) - 1, 0))
        found = names[place] == name if len(names) else np.zeros(len(name), bool)
        add = np.zeros(len(name))
        add[found] = adds[place[found]]
        total += np.bincount(owner, add[at], len(texts))
        if cells is not None:
            cell = name >> np.uint64(64 - CELL_BITS)
            maybe = ~found & ((cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            sent = maybe[at]
            asked.append((owner[sent], name[at[sent]]))
    if not asked:
        return lengths, total, None
    who, name = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.lexsort((name, who))
    who, name = who[order], name[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(who), 1), bool), (who[1:] != who[:-1]) | (name[1:] != name[:-1])]))
    return lengths, total, (who[first], name[first].view(np.int64), np.diff(np.append(first, len(who))))


def measured(rows: DataFrame, model: Model, scope: str | None = None) -> DataFrame:
    """Rows (..., text) -> (..., n, total): the text's length and the sum of what its n-grams add."""
    shared = rows.sparkSession.sparkContext.broadcast(model.held())
    kept = rows.columns[:-1]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def whole(batches):
        for batch in batches:
            for a, b, texts in in_runs(batch.column(batch.num_columns - 1)):
                n, total, _ = _measure(texts, *shared.value)
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(n), pa.array(total)], [*kept, "n", "total"])

    if model.rest is None:
        return rows.mapInArrow(whole, f"{fields}, n long, total double")

    def parts(batches):
        for batch in batches:
            for a, b, texts in in_runs(batch.column(1)):
                n, total, (who, name, times) = _measure(texts, *shared.value)
                ids, empty = batch.column(0).slice(a, b - a), pa.nulls(len(who), pa.int64())
                yield pa.record_batch([ids, pa.array(n), pa.array(total), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], _PARTS)
                yield pa.record_batch([ids.take(pa.array(who)), empty, empty.cast(pa.float64()), pa.array(name), pa.array(times)], _PARTS)

    # a text is known by its hash; rows of equal texts send the same parts, so sums are over their number
    text = rows.select(*kept, F.xxhash64("text").alias("_text"), "text")
    sent = text.select("_text", "text").mapInArrow(parts, "_text long, n long, total double, name long, times long")
    sent = materialize(sent, "toxicity-parts", scope)
    added = sent.where("name IS NOT NULL").join(model.rest, "name").groupBy("_text").agg(F.sum(F.col("add") * F.col("times")).alias("more"))
    own = sent.where("name IS NULL").groupBy("_text").agg(F.first("n").alias("n"), F.first("total").alias("own"), F.count("*").alias("rows"))
    sums = own.join(added, "_text", "left").select("_text", "n", (F.col("own") + F.coalesce(F.col("more") / F.col("rows"), F.lit(0.0))).alias("total"))
    return text.drop("text").join(materialize(sums, "toxicity-sums", scope), "_text").drop("_text")


def _named(entries: DataFrame, level: int) -> DataFrame:
    """Rows (key, count, add) of one level -> (name, count, add), without those that add nothing."""

    def work(batches):
        for batch in batches:
            name = _names(batch.column(0).to_numpy().view(np.uint64), level)
            yield pa.record_batch([pa.array(name.view(np.int64)), *batch.columns[1:]], ["name", "count", "add"])

    return entries.where("add <> 0").mapInArrow(work, "name long, count long, add double")


def _placed(entries: DataFrame, scope: str | None) -> tuple[np.ndarray, np.ndarray, DataFrame | None, np.ndarray | None]:
    """Which n-grams every worker holds, the rest, and the rest's cells. All are used; counts decide only where they lie."""
    entries = materialize(entries, "toxicity-model", scope).withColumn("grade", F.floor(F.log2("count") * 8).cast("int"))
    least, held, total = None, 0, 0
    for r in sorted(entries.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):
        total += r["count"]
        if total <= LOCAL:
            least, held = r["grade"], total
    near = entries.where(F.col("grade") >= least) if held else entries.where("false")
    got = near.select("name", "add").toArrow()
    names, adds = got.column("name").to_numpy().view(np.uint64), got.column("add").to_numpy().astype(np.float32)
    order = np.argsort(names)
    if held == total:
        return names[order], adds[order], None, None
    rest = (entries.where(F.col("grade") < least) if held else entries).select("name", "add")
    cell = F.shiftrightunsigned("name", 64 - CELL_BITS)
    block = rest.groupBy(F.shiftright(cell, 15).alias("block")).agg(F.bitmap_construct_agg(cell.bitwiseAND(F.lit(32767))).alias("bits"))
    cells = np.zeros(1 << (CELL_BITS - 3), np.uint8)
    for r in block.toLocalIterator():
        cells[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return names[order], adds[order], rest, cells


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps that are halved until they gain."""
    scale = np.concatenate([np.maximum(np.abs(x).max(0, initial=0), 1e-9), [1.0]])
    a, w = np.column_stack([x, np.ones(len(x))]) / scale, np.zeros(3)
    ridge = np.asarray([1e-3, 1e-3, 1e-6])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (w * w))

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        share = 1.0
        while share > 1e-6 and loss(w - share * step) > now:
            share /= 2
        w, before = w - share * step, now
        now = loss(w)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w / scale


def learn(rows: DataFrame, scope: str | None = None) -> Model:
    """``rows`` (doc_id, text, toxic 0/1) -> Model."""
    none = np.zeros(0, np.uint64), np.zeros(0), None, None
    pairs = materialize(bigram_counts(rows.select("toxic", "text")), "toxicity-pairs", scope)
    # Kneser-Ney continuation counts: of how many different predecessors a word follows
    by_word = pairs.groupBy(word_of(F.col("key")).alias("w")).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")), F.count("*").alias("n"))
    by_word = materialize(by_word, "toxicity-words", scope)
    by_word = by_word.withColumn("stem", F.shiftrightunsigned("w", WORD_BITS))
    by_stem = by_word.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary", "n")))
    total = by_word.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("toxic", "ordinary", "n"))).first()
    if not total["toxic"] or not total["ordinary"]:
        return Model(*none, np.asarray([0.0, 0.0, -5.0]))
    sums = {c: float(total[c]) for c in ("toxic", "ordinary", "n")}
    classes = ("toxic", "ordinary")

    share = sums["toxic"] / (sums["toxic"] + sums["ordinary"])

    def freed(df: DataFrame) -> dict[str, float]:
        """The share of each class's mass that discounting frees."""
        got = df.agg(*(F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(c) for c in classes)).first()
        return {c: got[c] / sums[c] for c in classes}

    def trusted(gap: Column, backoff: Column) -> Column:
        """``gap`` as far as its counts speak for it, and for the other part its backoff's."""
        n, evidence = F.col("toxic") + F.col("ordinary"), F.lit(0.0)
        for c, part in (("toxic", share), ("ordinary", 1 - share)):
            evidence += F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * part))).otherwise(0.0)
        belief = 1 / (1 + F.exp(F.greatest(F.lit(DOUBT) - evidence, F.lit(-35.0)))) * gap * gap / (gap * gap + 1)
        return belief * gap + (1 - belief) * backoff

    def gap(toxic: Column, ordinary: Column) -> Column:
        return F.log(toxic) - F.log(ordinary)

    of_words, of_stems = freed(by_word), freed(by_stem)
    common, pooled = F.col("n") >= MIN_COUNT, F.col("n") / sums["n"]
    stem_level = by_stem.select("stem", "toxic", "ordinary", "n", *(F.when(common, _less(F.col(c)) / sums[c] + of_stems[c] * pooled).otherwise(pooled).alias(f"stem_{c}") for c in classes))
    stem_level = stem_level.withColumn("stem_gap", trusted(gap(F.col("stem_toxic"), F.col("stem_ordinary")), F.lit(0.0)))
    # a word's share of its stem is the same for both classes
    back = {c: F.col(f"stem_{c}") * F.col("n") / F.col("stem_n") for c in classes}
    # a rare word has its stem's difference, but bigrams that end in it may still be common
    # there are at most 2 ** STEM_BITS stems, and one may have very many words
    word_level = by_word.join(F.broadcast(stem_level.select("stem", F.col("n").alias("stem_n"), "stem_toxic", "stem_ordinary", "stem_gap")), "stem")
    word_level = word_level.select("w", "toxic", "ordinary", "n", "stem_gap", *(F.when(common, _less(F.col(c)) / sums[c] + of_words[c] * back[c]).otherwise(back[c]).alias(f"p_{c}") for c in classes))
    word_level = word_level.withColumn("word_gap", F.when(common, trusted(gap(F.col("p_toxic"), F.col("p_ordinary")), F.col("stem_gap"))).otherwise(F.col("stem_gap")))
    before = F.col("key").bitwiseAND(F.lit((1 << BEFORE_BITS) - 1))
    by_history = pairs.groupBy(before.alias("h")).agg(*(f for c in classes for f in (F.sum(c).alias(f"h_{c}"), F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(f"free_{c}"))))
    known = pairs.where(F.col("toxic") + F.col("ordinary") >= MIN_COUNT).select("*", before.alias("h"), word_of(F.col("key")).alias("w"))
    known = known.join(by_history, "h").join(word_level.select("w", "p_toxic", "p_ordinary", "word_gap"), "w")
    # a class that never saw the word before has only the backoff to go by
    p = {c: F.when(F.col(f"h_{c}") > 0, (_less(F.col(c)) + F.col(f"free_{c}") * F.col(f"p_{c}")) / F.col(f"h_{c}")).otherwise(F.col(f"p_{c}")) for c in classes}

    levels = (
        stem_level.select(F.col("stem").alias("key"), F.col("n").alias("count"), F.col("stem_gap").alias("add")),
        word_level.select(F.col("w").alias("key"), F.col("n").alias("count"), (F.col("word_gap") - F.col("stem_gap")).alias("add")),
        known.select("key", (F.col("toxic") + F.col("ordinary")).cast("long").alias("count"), (trusted(gap(p["toxic"], p["ordinary"]), F.col("word_gap")) - F.col("word_gap")).alias("add")),
    )
    stems, words_, bigrams = (_named(entries, level) for level, entries in enumerate(levels))
    model = Model(*_placed(stems.unionByName(words_).unionByName(bigrams), scope), np.asarray([0.0, 0.0, -5.0]))
    x, y = _calibration(rows, model, scope)
    if len(set(y)) == 2:
        model.weights = _fit(x, y)
    return model


def _calibration(rows: DataFrame, model: Model, scope: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most CALIBRATION_ROWS rows of each class, those whose id hashes lowest."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, min(1.0, CALIBRATION_ROWS / n)).otherwise(share)
    got = measured(rows.where(place < share).select("toxic", "text"), model, scope).toArrow()
    n, total = np.maximum(got.column("n").to_numpy(), 1), got.column("total").to_numpy()
    return np.column_stack([total / n, total / np.sqrt(n)]), got.column("toxic").to_numpy().astype(np.float64)


def learnable(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(id_remainder(id_col, folds) != held)
    return id_and_text(rows, id_col, text_col).join(sized(known, labels.count()), "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, learn_from: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= threshold).

    Learns only from labelled rows outside fold ``held`` of ``learn_from``
    (``docs`` if not given). A document with several labels counts as toxic if
    one says so; null labels are left out. Null and empty texts score as a
    text of no evidence. Without labelled rows of both classes no text is
    rejected. Rows that repeat score alike and are learnt from each; rows
    without an id fall into the fold of an empty id and have no label. Texts
    are taken whole. An empty table gives no rows; other columns are not
    looked at.
    """
    source = docs if learn_from is None else learn_from
    inner = new_scope("toxicity")
    model = learn(learnable(source, labels, id_col, text_col, folds, held), inner)
    rows = docs.select(F.col(id_col).alias("doc_id"), (id_remainder(id_col, folds) == held).alias("held_out"), text_of(text_col).alias("text"))
    found = measured(rows, model, scope)
    sweep(docs.sparkSession, inner)
    scored = found.select("doc_id", "held_out", model.score(F.col("n"), F.col("total")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, scope: str | None = None) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, their columns as they are.

    Cases are those of ``score_toxicity``; equal texts are judged alike. An
    empty table stays empty, and no column name is taken.
    """
    inner = new_scope("toxicity")
    model = learn(learnable(docs, labels, id_col, text_col, folds, held), inner)
    rows = packed(docs, tid=F.xxhash64(text_of(f"`{text_col}`")), text=text_of(f"`{text_col}`"))
    found = measured(rows.select("tid", "text"), model, inner)
    gone = materialize(found.where(model.score(F.col("n"), F.col("total")) >= threshold).select("tid").distinct(), "toxicity-gone", scope)
    sweep(docs.sparkSession, inner)
    return joined(rows.drop("text"), gone, "tid", "left_anti").select("row.*")
