"""Centroid clustering of integer vectors, with block-norm screening.

Vectors are cut into blocks of components; the norms of the blocks are the compressed form that is kept beside the vector.
By Cauchy-Schwarz the squared distance of two vectors is at least the sum over blocks of the squared difference of their
norms. Each vector's exact distance to the centroid with the least bound is taken first; only centroids whose bound doesn't
exceed the best exact distance so far get exact integer distances. Bounds are lowered by what rounding can add, so no
nearest centroid is ever screened out.

A round is one pass over the vectors: centroids (a few rows) go to the tasks, and each task sends back the sum and count of
each cluster, which Spark adds up. Sums are exact integers, in limbs, however large the components are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

#: Blocks of a vector, and what a 32-bit norm may be off, as a share of it.
BLOCKS, SLACK = 8, 2.0**-22
#: Vectors whose components stay within SMALL are 32-bit; distances to centroids within SMALL then fit 64 bits (64 components).
SMALL = 1 << 26
#: Bits of a limb of an exact sum, and rows that a step of a vectorised loop takes.
LIMB, STEP = 40, 4_096
LONG = (1 << 63) - 1


def integers(x: float, scale: int) -> int:
    """floor(scale * x) exactly, where the product itself would be beyond a double too."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def block_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the BLOCKS blocks of each row of integers."""
    parts = np.array_split(np.arange(x.shape[1]), BLOCKS)
    return np.stack([np.sqrt((x[:, p].astype(np.float64) ** 2).sum(1)) for p in parts], axis=1)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """vec_id, small (32-bit integers), norms (32-bit floats of the blocks) and wide (the components as given, where a
    component is beyond SMALL) of vectors with exactly `components` finite components."""
    x = F.col("x")
    finite = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(x.isNotNull() & finite)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), components)
            fits = (np.abs(flat) * scale < SMALL).all(1) if len(batch) else np.zeros(0, bool)
            q = np.floor(np.where(fits[:, None], flat, 0) * scale).astype("<i4")
            norms = block_norms(q).astype("<f4")
            wide = [None if f else row.tolist() for f, row in zip(fits, flat)]
            columns = [batch.column(0), pa.array([r.tobytes() for r in q], pa.binary(), mask=~fits), pa.array([r.tobytes() for r in norms], pa.binary(), mask=~fits), pa.array(wide, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "small", "norms", "wide"])

    return kept.mapInArrow(compress, "vec_id long, small binary, norms binary, wide array<double>")


class Nearest:
    """The nearest of a few centroids (lists of Python integers) and the squared distance; the smaller number at a tie."""

    def __init__(self, centroids: list[list[int]], scale: int):
        self.centroids, self.scale = centroids, scale
        self.small = [k for k, c in enumerate(centroids) if all(abs(v) <= SMALL for v in c)]
        self.wide = [k for k in range(len(centroids)) if k not in self.small]
        self.c = np.array([centroids[k] for k in self.small], dtype=np.int64)
        self.norms = block_norms(self.c) if self.small else None
        self.exact = 0  # distances taken, against rows times centroids without screening

    def exactly(self, x: list[int]) -> tuple[int, int]:
        d, k = min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(self.centroids))
        return k, d

    def of_small(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.small:
            found = [self.exactly(r) for r in x.tolist()]
            return np.array([k for k, _ in found], np.int64), np.array([min(d, LONG + 1) for _, d in found], object)
        norms, rows = norms.astype(np.float64), np.arange(len(x))
        gap = np.abs(norms[:, None] - self.norms) - SLACK * (norms[:, None] + self.norms)
        bound = (np.maximum(gap, 0) ** 2).sum(2) * (1 - 1e-12)
        at = bound.argmin(1)
        best = ((x - self.c[at]) ** 2).sum(1)
        self.exact += len(x)
        tried = at.copy()
        for k in range(len(self.small)):
            open_ = rows[(bound[:, k] <= best) & (tried != k)]
            d = ((x[open_] - self.c[k]) ** 2).sum(1)
            self.exact += len(open_)
            nearer = (d < best[open_]) | (d == best[open_]) & (k < at[open_])
            at[open_[nearer]], best[open_[nearer]] = k, d[nearer]
        number = np.array(self.small)[at]
        for k in self.wide:  # a component beyond SMALL alone can put such a centroid out of reach
            c = self.centroids[k]
            least = sum(max(0, abs(v) - SMALL) ** 2 for v in c)
            for r in rows[best >= min(least, LONG)].tolist():
                d = sum((a - b) ** 2 for a, b in zip(x[r].tolist(), c))
                if (d, k) < (int(best[r]), int(number[r])):
                    number[r], best[r] = k, d
        return number, best

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[list[int]] | np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of a batch (vec_id, small, norms, wide): row numbers, integer vectors, cluster and distance of each."""
        small = batch.column("small")
        rows = np.flatnonzero(small.is_valid().to_numpy(zero_copy_only=False))
        for a in range(0, len(rows), STEP):
            some = pa.array(rows[a : a + STEP])
            x = np.frombuffer(b"".join(small.take(some).to_pylist()), "<i4").reshape(len(some), -1).astype(np.int64)
            norms = np.frombuffer(b"".join(batch.column("norms").take(some).to_pylist()), "<f4").reshape(len(some), BLOCKS)
            yield rows[a : a + STEP], x, *self.of_small(x, norms)
        rest = np.flatnonzero(~small.is_valid().to_numpy(zero_copy_only=False))
        if len(rest):
            x = [[integers(v, self.scale) for v in row] for row in batch.column("wide").take(pa.array(rest)).to_pylist()]
            found = [self.exactly(r) for r in x]
            yield rest, x, np.array([k for k, _ in found], np.int64), np.array([d for _, d in found], object)


def moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    width = len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, n = Nearest(centroids, scale), np.zeros(len(centroids), np.int64)
        sums = [[0] * width for _ in centroids]
        for batch in batches:
            for _, x, cluster, _ in nearest(batch):
                n += np.bincount(cluster, minlength=len(n))
                for k in np.unique(cluster).tolist():
                    own = x[cluster == k].sum(0).tolist() if isinstance(x, np.ndarray) else [sum(c) for c in zip(*(r for r, q in zip(x, cluster) if q == k))]
                    sums[k] = [a + b for a, b in zip(sums[k], own)]
        out = []  # cluster, limb, count and the limb of each component's sum; the sign goes with each limb
        for k, total in enumerate(sums):
            limbs = max(1, *(-(-abs(v).bit_length() // LIMB) for v in total))
            for limb in range(limbs if n[k] else 0):
                part = [(abs(v) >> LIMB * limb & (1 << LIMB) - 1) * (1 if v >= 0 else -1) for v in total]
                out.append((k, limb, 0 if limb else int(n[k]), part))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["cluster", "limb", "n", "sums"])

    parts = kept.mapInArrow(add, "cluster int, limb int, n long, sums array<long>")
    totals = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums")).collect()  # a few limbs of each centroid
    count, total = [0] * len(centroids), [[0] * width for _ in centroids]
    for r in totals:
        count[r["cluster"]] += r["n"]
        total[r["cluster"]] = [a + (int(b) << LIMB * r["limb"]) for a, b in zip(total[r["cluster"]], r["sums"])]
    return [[v // n for v in t] if n else c for c, n, t in zip(centroids, count, total)]


def first_centroids(kept: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The vectors with the k least hashes of seed and id, in that order; equal ids go by their components."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("h", h).orderBy("h", "wide", "small").limit(k).select("small", "wide").collect()
    return [np.frombuffer(r["small"], "<i4").tolist() if r["small"] is not None else [integers(v, scale) for v in r["wide"]] for r in rows]


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part.

    Vectors take part that have exactly `components` components, none null or non-finite; each component x becomes
    floor(scale * x). Fewer than k such vectors are as many centroids; no vectors, no rows. Rows that repeat an id keep a row
    each; a null id counts as the empty text where first centroids are chosen. Clusters are exact for components of any
    size; a distance, or a sum of distances, that needs more than 64 bits is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = stored(kept_vectors(vectors, id_col, vector_col, components, scale))
    centroids = first_centroids(kept, k, scale, seed)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, scale)
        for batch in batches:
            for rows, _, cluster, d in nearest(batch):
                distance = pa.array(d) if d.dtype == np.int64 else pa.array([int(v) if v <= LONG else None for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(cluster, pa.int32()), distance], names=["vec_id", "cluster", "distance"])

    assigned = stored(kept.mapInArrow(assign, schema))
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(whole.alias("d")).collect()}  # k rows at most
    fits = lambda v: F.lit(int(v) if v is not None and v <= LONG else None).cast("long")
    total = None if None in sums.values() else sum(sums.values())
    each = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return assigned.withColumns({"cluster_inertia": each([fits(sums.get(i, 0)) for i in range(len(centroids))]), "inertia": fits(total), "centroid_sha256": each([F.lit(n) for n in names])})
