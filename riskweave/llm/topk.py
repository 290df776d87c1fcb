"""Exact top-k search by inner product over a bit-sliced index.

Every component is quantised to an integer. The index keeps, per block of rows and attribute, one bitmap for each binary
digit (slice). A query multiplies an attribute by its own component through shifts of the attribute's slices, and adds
them up with bitmap full adders into a bit-sliced sum. The best rows are then selected from the most significant slice of
the sum downward; rows that tie at the boundary are resolved exactly, by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import stored

SCALE = 256.0
#: Rows of a block (one bitmap is a bit for each).
BLOCK_ROWS = 16_384
#: Most bytes of queries that are broadcast at once; more are searched in several rounds over the index, which stays where it is.
BROADCAST_BYTES = 32 << 20


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and q, the floors of the scaled components, of rows that take part."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    floor = lambda x: F.when(F.abs(x.cast("double") * SCALE) < 2.0**63, F.floor(x.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("a scaled component leaves 64 bits")).cast("long"))
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, finite)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, floor).alias("q"))


def slices(values: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of the digits of values - min, least significant first, and min."""
    low = int(values.min())
    up, bitmaps = values.view(np.uint64) - np.uint64(low & (1 << 64) - 1), []  # modulo 2**64, where any difference fits
    while up.any():
        bits = np.packbits((up & np.uint64(1)).astype(np.uint8), bitorder="little")
        bitmaps.append(np.pad(bits, (0, -len(bits) % 8)).view(np.uint64))
        up >>= np.uint64(1)
    return bitmaps, low


def add(total: list[np.ndarray], more: list[np.ndarray], shift: int) -> None:
    """total += more << shift, digit by digit, with carries kept as bitmaps."""
    while len(total) < shift:
        total.append(np.zeros_like(more[0]))
    carry = None
    for k in range(shift, shift + len(more)):
        b = more[k - shift]
        if k == len(total):
            total.append(b.copy() if carry is None else b ^ carry)
            carry = None if carry is None else b & carry
            continue
        a = total[k]
        half = a ^ b
        if carry is None:
            total[k], carry = half, a & b
        else:
            total[k], carry = half ^ carry, (a & b) | (half & carry)
    k = shift + len(more)
    while carry is not None and carry.any():
        if k == len(total):
            total.append(carry)
            return
        total[k], carry = total[k] ^ carry, total[k] & carry
        k += 1


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: list[np.ndarray], within: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are surely among the k highest, and of those that tie for what places are left."""
    sure, tied = np.zeros_like(within), within
    for digit in reversed(total):
        high = sure | (tied & digit)
        n = count(high)
        if n > k:
            tied = tied & digit
        elif n < k:
            sure, tied = high, tied & ~digit
        else:
            return high, np.zeros_like(within)
    return sure, tied


def search_block(index: list[tuple[list[np.ndarray], int]], valid: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best rows of a block, ids ascending within it; the row with id `own` is left out."""
    total, constant = [], 0
    top = {}
    for d, (bitmaps, low) in enumerate(index):
        x = int(q[d])
        if not x:
            continue
        digits = bitmaps
        if x > 0:
            constant += x * low
        else:  # x * v = -x * (high - v) + x * high, and high - v has the complements of the digits of v - low
            high = (1 << len(bitmaps)) - 1
            constant += x * (low + high)
            digits = [top.setdefault((d, j), ~b) for j, b in enumerate(bitmaps)]
        x = abs(x)
        for shift in range(x.bit_length()):
            if x >> shift & 1 and digits:
                add(total, digits, shift)
    within = valid.copy()
    at = int(np.searchsorted(ids, own))
    while at < len(ids) and ids[at] == own:
        within[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        at += 1
    k = min(k, count(within))
    if not k:
        return []
    sure, tied = best(total, within, k)
    rows = members(sure)
    rows = np.concatenate([rows, members(tied)[: k - len(rows)]])
    out = []
    for row in rows.tolist():
        bit = np.uint64(row & 63)
        out.append((int(ids[row]), constant + sum(int(t[row >> 6] >> bit & np.uint64(1)) << j for j, t in enumerate(total))))
    return out


def build_index(rows: DataFrame) -> DataFrame:
    """One row for each (block, dims): ids ascending and, per attribute, the lowest value and the slices, as bytes.

    Ids are dealt to blocks by hash, so that ids in a narrow range spread as well as any.
    """
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))

    def pack(key, batch):
        ids = batch.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        q = batch.column("q").combine_chunks().flatten().to_numpy().reshape(len(ids), key[1].as_py())[order].astype(np.int64)
        lows, widths, parts = [], [], []
        for d in range(q.shape[1]):
            bitmaps, low = slices(q[:, d])
            lows.append(low)
            widths.append(len(bitmaps))
            parts += [b.tobytes() for b in bitmaps]
        return pa.table({"block": [key[0].as_py()], "dims": [key[1].as_py()], "ids": [ids[order].astype("<i8").tobytes()], "lows": [lows], "widths": [widths], "bits": [b"".join(parts)]}, schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("lows", pa.list_(pa.int64())), ("widths", pa.list_(pa.int32())), ("bits", pa.binary())]))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("dims", F.size("q"))
    return dealt.groupBy("block", "dims").applyInArrow(pack, "block long, dims int, ids binary, lows array<long>, widths array<int>, bits binary")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row whose id is divisible by query_every.

    The score is the integer inner product of quantised vectors; ties go to the smaller vec_id. Vectors that are null or
    hold a null or non-finite component take no part, nor do null ids; vectors meet only others of their own length, empty
    ones too, whose scores are 0. A component or score that leaves 64 bits is an error. With fewer than k candidates all are
    returned; a query without any has no row. Rows that repeat an id are candidates each, never of a query of that id, and
    a repeated query is answered once, by one of its rows (the least vector). An empty table gives no rows. Other columns
    are not read.
    """
    rows = stored(quantised(vectors, id_col, vector_col))
    index = stored(build_index(rows))
    asked = stored(rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("q").alias("q")))
    size = asked.agg(F.coalesce(F.sum(8 * F.size("q") + 16), F.lit(0))).first()[0]
    rounds = max(1, -(-size // BROADCAST_BYTES))
    context = rows.sparkSession.sparkContext
    # while there are fewer blocks than tasks, each block is searched for a part of the queries at a time
    parallel = 4 * max(1, context.defaultParallelism)
    parts = max(1, -(-parallel // max(1, index.count())))
    blocks = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parallel, "block", "part") if parts > 1 else index.withColumn("part", F.lit(0))

    def searched(queries) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], dtype="<i8")
                    words = -(-len(ids) // 64)
                    bits = np.frombuffer(row["bits"], dtype=np.uint64).reshape(-1, words)
                    ends = np.cumsum([0, *row["widths"]]).tolist()
                    attributes = [(list(bits[a:b]), low) for a, b, low in zip(ends, ends[1:], row["lows"])]
                    valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
                    own, vectors = queries.value.get(row["dims"], ((), ()))
                    found = [(q, vec_id, score) for q, x in zip(own[row["part"] :: parts], vectors[row["part"] :: parts]) for vec_id, score in search_block(attributes, valid, ids, x, q, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found) if found else [[]] * 3)], names=["query_id", "vec_id", "score"])

        return blocks.mapInArrow(search, "query_id long, vec_id long, score long")

    found = None
    for g in range(rounds):
        of: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == g).collect():  # BROADCAST_BYTES or so
            ids, vectors_of = of.setdefault(len(r["q"]), ([], []))
            ids.append(r["vec_id"])
            vectors_of.append(np.array(r["q"], dtype=np.int64))
        one = searched(context.broadcast(of))
        one = stored(one) if rounds > 1 else one
        found = one if found is None else found.unionByName(one)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
