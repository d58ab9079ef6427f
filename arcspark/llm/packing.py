"""Best-fit packing of token sequences by minimum bin slack.

One pass tokenises each document and cuts it into pieces. Only the histogram
of piece lengths reaches the driver: at most ``capacity`` lengths, whatever
the corpus size. There, bin by bin, a bitset subset-sum over the lengths that
are still available finds the fullest feasible combination with the longest
piece left; the combination is removed as often as its pieces last. What
comes out is a short list of bin patterns, and each piece finds its bin from
its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspark.llm import pretoken
from arcspark.llm.common import id_and_text, materialize

#: Pre-tokens whose ids a worker keeps: some 200 bytes each.
WORKER_CACHE = 700_000
#: Rows of one length and salt that one task ranks; lengths and salts that the driver counts at most.
ROWS_A_SALT, MOST_CELLS = 200_000, 2_000_000

_state: dict = {}


def encoder(tokenizer_file: str):
    """text -> ids as little-endian unsigned 32-bit bytes, without added tokens."""
    if tokenizer_file not in _state:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)

        def whole(text: str) -> bytes:
            return np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        cache = pretoken.Cache(whole, {}, WORKER_CACHE)
        get = cache.__getitem__

        def encode(text: str) -> bytes:
            words = pretoken.split(text, "byte_level")
            return whole(text) if words is None else b"".join(map(get, words))

        _state[tokenizer_file] = encode, cache
    encode, cache = _state[tokenizer_file]
    cache.take()
    return encode


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(tokenizer_file)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within ``room``.

    Bit s of ``sums`` says that s can be made. Longer lengths are added first
    and the way back takes a shorter one only where it is needed.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(room, 0, -1):
        left = min(counts[length], room // length)
        take = 1
        while left:
            take = min(take, left)
            steps.append((sums, length, take))
            sums |= (sums << (length * take)) & mask
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Entries (length, first rank, pieces a bin, first bin, first offset) and the number of bins."""
    counts, rank, entries, bins = [0] * (capacity + 1), [0] * (capacity + 1), [], 0
    for length, n in histogram.items():
        counts[length] = n
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            used = fullest(counts, capacity - longest)
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(counts[length] // n for length, n in used.items())
            offset = 0
            for length, n in sorted(used.items(), reverse=True):
                entries.append((length, rank[length], n, bins, offset))
                rank[length] += n * times
                counts[length] -= n * times
                offset += n * length
            bins += times
    return entries, bins


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Documents over ``capacity``
    tokens are cut into full pieces after a first one that may be shorter.
    Repeated rows, and rows without an id, are packed each; an empty table
    gives no rows; other columns are not looked at. Of equal lengths any piece
    may take any place. Texts are taken whole: a task holds the ids of one at
    a time.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(id_and_text(docs, id_col, text_col), tokenizer_file, capacity, end_id), "pieces", scope)
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    # each length is salted by its own number of pieces; rows of a length and salt grow only past MOST_CELLS of them
    each = max(ROWS_A_SALT, sum(sizes.values()) // MOST_CELLS)
    salts = max(16, 2 * max(sizes.values(), default=0) // each)
    own = F.create_map(*(F.lit(x) for length, n in sorted(sizes.items()) for x in (length, max(16, min(salts, 2 * n // each))))) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(F.element_at(own, F.col("length")), F.lit(1))).cast("int"))
    cells = salted.groupBy("length", "salt").count().collect()
    base, histogram = {}, {}
    for r in sorted(cells):
        base[r["length"] * salts + r["salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
    entries, _ = plan_bins(histogram, capacity)
    entries.sort()
    table = np.asarray(entries, np.int64).reshape(-1, 5)
    cell = np.asarray(sorted(base.items()), np.int64).reshape(-1, 2)
    plan = spark.sparkContext.broadcast((table, cell))
    wide = np.int64(1) << np.int64(44)

    def place(batches):
        table, cell = plan.value
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank - 1 + cell[np.searchsorted(cell[:, 0], length * salts + salt), 1]
            e = table[np.searchsorted(keys, length * wide + rank, "right") - 1]
            nth = rank - e[:, 1]
            yield pa.record_batch([*batch.columns[:5], pa.array(e[:, 3] + nth // e[:, 2]), pa.array(e[:, 4] + nth % e[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return salted.withColumn("rank", F.row_number().over(order)).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
