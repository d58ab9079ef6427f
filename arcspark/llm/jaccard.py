"""N-gram Jaccard join with rare-first prefix filtering.

One pass counts shingles over all documents, in a fixed number of hash cells;
the cells' ranks and the rest of the hash make one number of a shingle, so
that a sorted set is in rare-first order. A second pass gives each document
its set's size and its class: documents of equal sets, known by a 64-bit hash
of the set. Two sets that reach the threshold share a shingle within both
prefixes, so classes are joined on prefix shingles only, and the filters rule
out most of what meets: sizes, places in the prefix, and, as the suffix
filter, parities of the shingles in 512 cells, which differ in no more cells
than the sets differ in shingles. What is left is verified on the whole sets;
a pair that failed is not verified again.

Links matter for components, so no group of one prefix shingle is expanded
into its pairs. Three rounds, each on the groups that still hold more than one
component: every class with one centre for its size; the pairs between
components that the filters allow, or a forest of the nearest where they are
many; and at last, in the groups with a forest, every pair between components
that the filters allow. No link between components can be missed. A large group is dealt into tiles: what lies outside
its largest component meets each block of it, and itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import id_and_text, in_runs, joined, materialize, mix, new_scope, packed, sized, small_batches, sweep, text_hashes, text_of
from arcspark.llm.components import stars

#: Cells of the shingle counts as a power of two; classes a task remembers; rows of a side of a tile.
CELL_BITS, REMEMBERED, HELD = 17, 100_000, 512
#: Cells of the counts in one row; nearest classes that a class offers to the forest.
COUNTS_A_ROW, NEAREST = 2048, 8
#: Pairs that are verified against one copy of their centre.
PAIRS_A_CENTRE = 500
#: Prefix shingles that several classes share, up to which they are broadcast.
BROADCAST_SHARED = 1_000_000
_CELLS = 1 << CELL_BITS


def rolled(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts end to end, as they come, and how many each text has.

    A text of fewer words is one shingle; one without words has none.
    """
    hashes = [text_hashes(t) for t in texts]
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    short = np.flatnonzero((n > 0) & (n < width))
    for i in short:  # padded with a number that depends on what is missing
        hashes[i] = np.concatenate([hashes[i], np.full(width - n[i], n[i], np.uint64)])
    n[short] = width
    flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
    counts = np.maximum(n - width + 1, 0)
    if not counts.any():
        return flat[:0], counts
    starts = np.cumsum(n) - n
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    with np.errstate(over="ignore"):
        out = np.full(len(flat) - width + 1, width, np.uint64)
        for j in range(width):
            out = mix(out + flat[j : len(flat) - width + 1 + j])
    return out[first], counts


def ordered(values: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingle hashes as numbers in rare-first order, one to one: the cell's rank, then the rest of the hash."""
    return (rank[(values & np.uint64(_CELLS - 1)).astype(np.int64)] << np.uint64(64 - CELL_BITS)) | (values >> np.uint64(CELL_BITS))


def sets_of(texts: list[str], width: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' shingle sets end to end, each sorted, and their sizes."""
    values, counts = rolled(texts, width)
    values = ordered(values, rank)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[(ends - counts)[counts > 0]] = True
    seen = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], seen[ends] - seen[ends - counts]


def classes_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return mix(mix(sums[ends] - sums[ends - sizes]) + sizes.astype(np.uint64)).view(np.int64)


def parities(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bytes a set, a bit for each of 512 cells: whether an odd number of shingles falls there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = owner * 512 + ((values >> np.uint64(20)) & np.uint64(511)).astype(np.int64)
    odd = np.bincount(cell, minlength=len(sizes) * 512) & 1
    return np.packbits(odd.astype(np.uint8)).reshape(len(sizes), 64)


def needed(n, percent: int):
    """Least overlap of a set of n with any set that it links with."""
    return (percent * n + 99) // 100


def least_overlap(n, m, percent: int):
    """Least intersection of two sets of n and m at the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def ranks(rows: DataFrame, width: int) -> np.ndarray:
    """Rank of each cell by how many shingles of all documents fall into it, rarest first."""

    def count(batches):
        total = np.zeros(_CELLS, np.int64)
        for batch in batches:
            for _, _, texts in in_runs(batch.column(0)):
                values, _ = rolled(texts, width)
                total += np.bincount((values & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS)
        yield rows_of(dict(enumerate(total.reshape(-1, COUNTS_A_ROW))))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        yield rows_of(sums)

    def rows_of(sums):
        return pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    got = rows.select("text").mapInArrow(count, kind).repartition(_CELLS // COUNTS_A_ROW, "block").mapInArrow(add, kind)
    counts = np.zeros(_CELLS, np.int64)
    with small_batches(rows.sparkSession):
        found = got.collect()
    for r in found:
        counts[r["block"] * COUNTS_A_ROW : (r["block"] + 1) * COUNTS_A_ROW] = np.frombuffer(r["counts"], np.int64)
    rank = np.empty(_CELLS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(_CELLS, dtype=np.uint64)
    return rank


_FACTS = ["doc_id", "rid", "n", "cid", "bits", "prefix"]


def describe(rows: DataFrame, width: int, percent: int, rank) -> DataFrame:
    """Rows (doc_id, text, rid) -> (doc_id, rid, n, cid); parities and prefix with a task's first row with an id of each class."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b, texts in in_runs(batch.column(1)):
                values, n = sets_of(texts, width, rank.value)
                cid, bits = classes_of(values, n), parities(values, n)
                ends, sent, prefix = np.cumsum(n), [], []
                for i, (c, size, end) in enumerate(zip(cid.tolist(), n.tolist(), ends.tolist(), strict=True)):
                    new = size > 0 and named[a + i] and c not in seen  # rows without an id link nothing
                    if new:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                    sent.append(bits[i].tobytes() if new else None)
                    prefix.append(values[end - size : end - needed(size, percent) + 1].view(np.int64) if new else None)
                yield pa.record_batch([ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.array(cid), pa.array(sent, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], _FACTS)

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rid long, n long, cid long, bits binary, prefix array<long>")


def shared_prefixes(facts: DataFrame, scope: str) -> DataFrame:
    """(h, cid, n, pos) of each class for the prefix shingles that it shares with another class."""
    sent = facts.where("prefix IS NOT NULL").select("cid", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = sent.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("h")
    shared = materialize(shared, "jaccard-shared", scope)
    met = joined(sent, shared, "h", "left_semi", limit=BROADCAST_SHARED)
    return materialize(met.select("h", "cid", "n", "pos").distinct(), "jaccard-groups", scope)


def may_link(n, pos, bits, m, qos, others, percent: int) -> np.ndarray:
    """Symmetric differences that parities show, or -1 where sizes, places or parities rule a pair out. ``n`` is one row's or each row's."""
    least = least_overlap(n, m, percent)
    ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - pos, m - qos) >= least)
    differ = np.bitwise_count(bits ^ others).sum(-1).astype(np.int64)
    return np.where(ok & (differ <= n + m - 2 * least), differ, -1)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 8)


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def with_centre(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y): each class of a group with the least class of about its size."""
    band = F.floor(F.log("n") / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    rows = groups.withColumn("band", band)
    heads = rows.groupBy("h", "band").agg(F.min(F.struct("n", "cid", "pos")).alias("c"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    least = F.ceil((F.col("n") + F.col("c.n")) * percent / (100 + percent))
    near = rows.join(heads, ["h", "band"]).where((F.col("cid") != F.col("c.cid")) & (F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")) >= least))
    pairs = near.where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")).select("n", F.col("c.n").alias("m"), F.col("c.cid").alias("x"), F.col("cid").alias("y")).distinct()
    bits = classes.select("cid", "bits")
    pairs = pairs.join(bits.withColumnsRenamed({"cid": "y", "bits": "own"}), "y").join(bits.withColumnsRenamed({"cid": "x", "bits": "others"}), "x")

    def work(batches):
        for batch in batches:
            n, m, x, y = _numbers(batch, ["n", "m", "x", "y"])
            ok = may_link(n, 0, _bits(batch.column(4)), m, 0, _bits(batch.column(5)), percent) >= 0
            yield pa.record_batch([pa.array(x[ok]), pa.array(y[ok])], ["x", "y"])

    return pairs.select("n", "m", "x", "y", "own", "others").mapInArrow(work, "x long, y long")


def open_groups(groups: DataFrame, tree: DataFrame, scope: str) -> DataFrame:
    """Rows of groups that hold several components, with ``part``, the group's rows and its largest part."""
    parts = groups.join(sized(tree.withColumnRenamed("node", "cid"), tree.count()), "cid", "left").withColumn("part", F.coalesce("root", "cid")).drop("root")
    sizes = parts.groupBy("h", "part").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("h").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    sizes = materialize(sizes.select("h", "rows", F.col("most.k").alias("k"), F.col("most.part").alias("most")), "jaccard-open", scope)
    return materialize(parts.join(sized(sizes, sizes.count()), "h"), "jaccard-parts", scope)


def in_tiles(rows: DataFrame) -> DataFrame:
    """Rows of open groups -> (tile, side, h, cid, n, pos, bits, part): any two rows of different parts meet in one tile.

    A group of at most HELD rows is one tile. In a larger one the largest part
    is dealt into blocks by class, and so are the other rows; blocks of the
    others meet each block of the largest part, each other and themselves.
    Rows of one ``side`` don't meet; of side -1 all do.
    """
    blocks = lambda n: F.greatest(F.ceil(n / HELD), F.lit(1)).cast("int")
    alone, largest = F.col("rows") <= HELD, F.col("part") == F.col("most")
    dealt = rows.withColumns({"major": F.when(alone, 0).otherwise(blocks(F.col("k"))), "minor": F.when(alone, 1).otherwise(blocks(F.col("rows") - F.col("k")))})
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(largest & ~alone, F.col("major")).otherwise(F.col("minor"))).cast("int"))
    tile = lambda kind, a, b, side: F.struct(F.xxhash64("h", F.lit(kind), a, b).alias("tile"), side.cast("int").alias("side"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    as_major = F.transform(up_to(F.greatest("minor", F.lit(1))), lambda j: tile(0, F.col("own"), j, F.lit(0)))
    with_major = F.transform(up_to(F.greatest("major", F.lit(1))), lambda i: tile(0, i, F.col("own"), F.lit(1)))
    with_minor = F.transform(up_to(F.greatest("minor", F.lit(1))), lambda j: tile(1, F.least("own", j), F.greatest("own", j), F.when(F.col("own") == j, -1).otherwise(F.col("own"))))
    places = F.when(alone, F.array(tile(2, F.lit(0), F.lit(0), F.lit(-1)))).when(largest, as_major).otherwise(F.concat(with_major, with_minor))
    dealt = dealt.select(F.explode(places).alias("at"), "h", "cid", "n", "pos", "bits", "part")
    return dealt.select("at.tile", "at.side", "h", "cid", "n", "pos", "bits", "part")


def _tiles(batches):
    """Arrays of the rows of each tile, from sorted rows: side, h, cid, n, pos, part, bits."""
    names, held = ["tile", "side", "h", "cid", "n", "pos", "part"], []
    for batch in batches:
        now = [*_numbers(batch, names), _bits(batch.column(batch.schema.get_field_index("bits")))]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cuts = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield [c[a:b] for c in now[1:]]
        last = cuts[-1] if len(cuts) else 0
        held = [c[last:] for c in now]
    if held and len(held[0]):
        yield held[1:]


def _forest(i: np.ndarray, j: np.ndarray, differ: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which pairs, nearest first, join parts that no pair before has joined."""
    _, node = np.unique(part, return_inverse=True)
    up, kept = list(range(int(node.max()) + 1)), []
    for k in np.argsort(differ, kind="stable").tolist():
        a, b = int(node[i[k]]), int(node[j[k]])
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            kept.append(k)
    return np.asarray(kept, np.int64)


def across(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (x, y) between components that the filters allow.

    With ``every`` all of them. Otherwise a tile in which a row has more than
    NEAREST gives a forest of the nearest, and a row (null, null, h): its group
    has more.
    """
    kind = "x long, y long, h long"

    def work(batches):
        done: set[tuple[int, int]] = set()

        def fresh(x, y):
            new = []
            for k, pair in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                if pair not in done:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(pair)
                    new.append(k)
            return new

        def out(cid, i, j, h=()):
            x, y = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
            new = fresh(x, y)
            none = pa.nulls(len(h), pa.int64())
            columns = pa.concat_arrays([pa.array(x[new]), none]), pa.concat_arrays([pa.array(y[new]), none]), pa.concat_arrays([pa.nulls(len(new), pa.int64()), pa.array(h, pa.int64())])
            return pa.record_batch(list(columns), ["x", "y", "h"])

        for side, h, cid, n, pos, part, bits in _tiles(batches):
            found, dense = [], False
            for i in range(len(n) - 1):
                # sorted by size: what is too large for row i begins at ``end``
                end = np.searchsorted(n, 100 * n[i] // percent, "right")
                j = np.flatnonzero((part[i + 1 : end] != part[i]) & ((side[i] < 0) | (side[i + 1 : end] != side[i]))) + i + 1
                if not len(j):
                    continue
                differ = may_link(n[i], pos[i], bits[i], n[j], pos[j], bits[j], percent)
                j, differ = j[differ >= 0], differ[differ >= 0]
                if every and len(j):
                    yield out(cid, np.full(len(j), i), j)
                    continue
                if len(j) > NEAREST:
                    dense = True
                    nearest = np.argpartition(differ, NEAREST)[:NEAREST]
                    j, differ = j[nearest], differ[nearest]
                if len(j):
                    found.append((np.full(len(j), i), j, differ))
            if found:
                i, j, differ = (np.concatenate(x) for x in zip(*found, strict=True))
                if dense:
                    kept = _forest(i, j, differ, part)
                    yield out(cid, i[kept], j[kept], [h[0]])
                else:
                    yield out(cid, i, j)

    return rows.repartition("tile").sortWithinPartitions("tile", "n", "cid").mapInArrow(work, kind)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, rank, scope: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, links): which classes were compared, and those whose whole sets reach the threshold.

    ``docs`` (doc_id, text). Each text goes once to each centre it is compared with.
    """
    pairs = materialize(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "jaccard-pairs", scope)
    # of two classes the one in more pairs is the centre, so that the other's text goes out few times
    ends = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).groupBy("cid").agg(F.count("*").alias("pairs"))
    stars_ = pairs.join(ends.select(F.col("cid").alias("x"), F.struct("pairs", "cid").alias("a")), "x").join(ends.select(F.col("cid").alias("y"), F.struct("pairs", "cid").alias("b")), "y")
    stars_ = stars_.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("m")).select("c.*", F.col("m.cid").alias("member"))
    copies = F.ceil(F.col("pairs") / PAIRS_A_CENTRE).cast("int")
    members = stars_.select(F.col("member").alias("cid"), F.col("cid").alias("x"), F.pmod(F.xxhash64("member"), copies).cast("int").alias("copy"))
    centres = stars_.select("cid", "pairs").distinct().select("cid", F.col("cid").alias("x"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    wanted = members.unionByName(centres).join(classes.select("cid", F.col("rep").alias("doc_id")), "cid")
    wanted = materialize(wanted, "jaccard-wanted", scope)
    rows = joined(docs, wanted, "doc_id").select("x", "copy", (F.col("cid") != F.col("x")).alias("member"), "cid", "text")

    def packed_texts(batches):
        for batch in batches:
            for a, b, texts in in_runs(batch.column(4)):
                small = [zstandard.compress(t.encode("utf-8", "surrogatepass"), 3) for t in texts]
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(small, pa.binary())], ["x", "copy", "member", "cid", "text"])

    rows = rows.mapInArrow(packed_texts, "x long, copy int, member boolean, cid long, text binary")
    rows = rows.repartition("x", "copy").sortWithinPartitions("x", "copy", "member")

    def work(batches):
        centre, whose = np.zeros(0, np.uint64), None
        for batch in batches:
            x, copy, cid = (batch.column(i).to_pylist() for i in (0, 1, 3))
            xs, ys = [], []
            for a, b, small in in_runs(batch.column(4), 300_000):
                texts = [zstandard.decompress(t).decode("utf-8", "surrogatepass") for t in small]
                values, n = sets_of(texts, width, rank.value)
                same, ends = classes_of(values, n), np.cumsum(n)
                for i, k in enumerate(range(a, b)):
                    if same[i] != cid[k]:
                        continue  # another text under the same id
                    s = values[ends[i] - n[i] : ends[i]]
                    if cid[k] == x[k]:
                        centre, whose = s.copy(), (x[k], copy[k])
                    elif whose == (x[k], copy[k]):
                        both = len(np.intersect1d(s, centre, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(centre) - both):
                            xs.append(x[k])
                            ys.append(cid[k])
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return pairs, materialize(rows.mapInArrow(work, "x long, y long"), "jaccard-links", scope)


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.col(a).alias("a"), F.col(b).alias("b"))


def _components(rows: DataFrame, width: int, percent: int, scope: str | None) -> DataFrame:
    """Rows (doc_id, text, rid) -> (doc_id, rid, n, cid, component_id); reads tables of ``scope`` alone."""
    spark = rows.sparkSession
    inner = new_scope("jaccard")
    texts = rows.select("doc_id", "text")
    rank = spark.sparkContext.broadcast(ranks(rows, width))
    facts = materialize(describe(rows, width, percent, rank), "jaccard-facts", inner)
    own = materialize(facts.select("doc_id", "rid", "n", "cid"), "jaccard-own", scope)
    classes = facts.where("n > 0 AND doc_id IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("bits", ignorenulls=True).alias("bits"))
    classes = materialize(classes, "jaccard-classes", inner)

    groups = shared_prefixes(facts, inner)
    compared, links = verified(with_centre(groups, classes, percent), texts, classes, width, percent, rank, inner)
    tree = stars(_edges(links, "x", "y"), inner)
    for every in (False, True):
        open_ = open_groups(groups, tree, inner)
        if open_.isEmpty():
            break
        found = across(in_tiles(open_.join(classes.select("cid", "bits"), "cid")), percent, every)
        found = materialize(found, "jaccard-found", inner)
        pairs = found.where("x IS NOT NULL").select("x", "y").join(compared, ["x", "y"], "left_anti")
        now, more = verified(pairs, texts, classes, width, percent, rank, inner)
        compared = compared.unionByName(now)
        if not more.isEmpty():
            tree = stars(_edges(tree, "node", "root").unionByName(_edges(more, "x", "y")), inner)
        groups = joined(groups, found.where("h IS NOT NULL").select("h").distinct(), "h", "left_semi")

    placed = classes.join(tree.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = materialize(placed.join(least, "root").select("cid", "component_id"), "jaccard-components", scope)
    sweep(spark, inner)
    linked = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
    out = own.join(by_class, "cid", "left")
    return out.select("doc_id", "rid", "n", "cid", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))


def _with_rid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id that links reach), class_id (equal for equal sets).

    Texts of fewer than ``width`` words are one shingle; null, empty and blank
    texts have an empty set and link with nothing. Rows without an id keep a
    null component and link nothing. Rows that repeat a doc_id are taken each
    by its own text. Links are symmetric, so ties don't arise. An empty table
    gives no rows. Other columns are not looked at. A task holds the words of
    about a million characters, or of one longer text: some 100 bytes a word.
    """
    found = _components(_with_rid(docs, id_col, text_col), width, percent, scope)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cid").alias("class_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """``docs`` without those that link, over any number of links, with a lower doc_id.

    Of rows that repeat an id and its text one stays, any one. Rows that repeat
    an id with other texts are judged each by its own text. Rows without an
    id, and texts without words, stay. An empty table stays empty. No column
    name is taken: rows are carried packed.
    """
    inner = new_scope("near-duplicates")
    found = materialize(_components(_with_rid(docs, id_col, text_col), width, percent, inner).where("n > 0 AND doc_id IS NOT NULL"), "jaccard-found", inner)
    gone = materialize(found.where("component_id <> doc_id").select("rid").distinct(), "jaccard-gone", scope)
    again = materialize(found.where("component_id = doc_id").groupBy("rid").count().where("count > 1").select("rid"), "jaccard-again", scope)
    sweep(docs.sparkSession, inner)
    rows = packed(docs, rid=F.xxhash64(F.col(f"`{id_col}`"), text_of(f"`{text_col}`")))
    kept = joined(rows, gone, "rid", "left_anti")
    if not again.isEmpty():
        kept = joined(kept, again, "rid", "left_anti").unionByName(joined(kept, again, "rid", "left_semi").dropDuplicates(["rid"]))
    return kept.select("row.*")
