"""Prefix sums and exact quantiles over tables of any size, by ranges.

Rows are dealt by ranges of their order and kept. The totals of the ranges are a histogram of one row a range; its running
sums place every range, so that what is asked of single rows needs no more than their own range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.sinks import kept

PART = "__part"
#: Buckets of a column in which ranks of cuts are looked for.
GRID = 1024


def dealt(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows with the number of the range of `order` that holds them; ranges ascend with their numbers."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def prefix_sums(rows: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """The rows with the sum of each column over all rows up to this one, itself included; `order` should tell rows apart."""
    d = dealt(rows, order)
    totals = d.groupBy(PART).agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])  # a row a range
    before = Window.partitionBy(F.lit(1)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PART, *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    upto = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(F.broadcast(offsets), PART).withColumns({k: F.col(f"__{k}") + F.sum(c).over(upto) for k, c in sums.items()}).drop(PART, *[f"__{k}" for k in sums])


def numbered(rows: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """name = the place of each row in the order, from 1; rows that tie are told apart by where they were read."""
    at = rows.withColumn("__at", F.monotonically_increasing_id())
    return prefix_sums(at, [*order, F.col("__at")], **{name: F.lit(1).cast("bigint")}).drop("__at")


def quantiles(rows: DataFrame, columns: list[str], fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """The columns of `by`, feature, and values: exact quantiles of each column, interpolated, in the order of the fractions.

    Equal values are counted first, by partial sums, and dealt by ranges of (group, feature, value). Counts per range place
    the wanted ranks; only ranges that hold one are looked into. Nulls don't count; a column without values has no row.
    """
    by = by or []
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "feature", "value").where("value is not null")
    keys = [*by, "feature"]
    d = dealt(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), [*keys, "value"])
    ranges = d.groupBy(*keys, PART).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*keys))})
    # the ranks about each wanted place, and the share of the value there in the quantile
    place = lambda f: f * (F.col("total") - 1)
    near = lambda f, i: F.array(F.struct(i.alias("i"), F.floor(place(f)).alias("rank"), (1 - (place(f) - F.floor(place(f)))).alias("share")), F.struct(i.alias("i"), F.ceil(place(f)).alias("rank"), (place(f) - F.floor(place(f))).alias("share")))
    every = F.flatten(F.transform(F.array(*[F.lit(float(f)) for f in fractions]), near))
    here = lambda w: (w["share"] > 0) & w["rank"].between(F.col("before"), F.col("before") + F.col("n") - 1)
    wanted = ranges.withColumn("w", F.explode(F.filter(every, here)))
    wanted = wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col(PART).alias("w_part"), "before", "w.*")
    held = wanted.select(*[c for c in wanted.columns if c.startswith("w_")]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys] + [F.col(PART) == F.col("w_part")]
    inside = d.join(held, same, "left_semi").withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, PART).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("rank") - F.col("before")
    found = inside.join(wanted, [*same, rank >= F.col("upto") - F.col("n"), rank < F.col("upto")])
    each = found.groupBy(*keys, "i").agg(F.sum(F.col("value") * F.col("share")).alias("q"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("values"))  # as many as fractions


def buckets(at: dict[str, list[float]], end: str = "__bin"):
    """A Bucketizer that adds to each column the number of its cuts below the value; a missing value has a bucket of its own.
    A column without cuts is cut at 0."""
    from pyspark.ml.feature import Bucketizer

    # Spark's buckets hold their lower end, these the upper one
    ends = [np.unique([-np.inf, *np.nextafter(c or [0.0], np.inf), np.inf]).tolist() for c in at.values()]
    return Bucketizer(inputCols=list(at), outputCols=[f"{c}{end}" for c in at], splitsArray=ends, handleInvalid="keep")


def cuts(rows: DataFrame, columns: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Up to bins - 1 ascending cuts of each column, a value at most the cut lying below it: all values but the largest of a
    column that has no more than `bins`, else exact quantiles. Nulls and NaN don't count.

    Approximate quantiles part each column into some GRID buckets, and all rows are counted by bucket. Single values are
    counted only in buckets that hold a wanted rank, or in all of a column with few; cuts don't depend on the buckets.
    """
    x = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    at = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    about = x.agg(*[F.percentile_approx(c, at, F.lit(10 * GRID)).alias(c) for c in columns]).first()
    edges = {c: sorted(set(about[c] or [])) for c in columns}
    x = buckets(edges).transform(x)
    bucket = {c: F.when(F.col(c).isNotNull(), F.col(f"{c}__bin").cast("int")) for c in columns}
    sizes = x.select(*[bucket[c].alias(c) for c in columns]).unpivot([], columns, "feature", "bucket").where("bucket is not null").groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # GRID a column
    wanted = []
    for c in columns:
        of, few = sorted((r["bucket"], r["n"]) for r in sizes if r["feature"] == c), len(edges[c]) <= bins
        before, total = 0, sum(n for _, n in of)
        for b, n in of:
            if few or (before + n) * bins // total > before * bins // total:
                wanted.append((c, b, before, total, few))
            before += n
    here = {c: [w[1] for w in wanted if w[0] == c] for c in columns}
    found: dict[str, list[float]] = {c: [] for c in columns}
    if not wanted:
        return found
    inside = x.select(*[F.when(bucket[c].isin(here[c]), F.struct(bucket[c].alias("bucket"), F.col(c).alias("value"))).alias(c) for c in columns if here[c]])
    counts = kept(inside.unpivot([], inside.columns, "feature", "x").where("x is not null").groupBy("feature", "x.bucket", "x.value").agg(F.count(F.lit(1)).alias("n")))
    places = F.broadcast(rows.sparkSession.createDataFrame(wanted, "feature string, bucket int, before long, total long, few boolean"))
    values = F.broadcast(counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values")))  # a row a column
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))  # a bucket is a small share
    placed = counts.join(places, ["feature", "bucket"]).join(values, "feature").withColumn("upto", upto)
    reaches = F.expr(f"upto * {bins} div total > (upto - n) * {bins} div total")
    chosen = placed.where((F.col("upto") < F.col("total")) & (F.col("few") & (F.col("values") <= bins) | reaches)).select("feature", "value")
    for feature, value in sorted(chosen.collect()):  # at most bins a column
        found[feature].append(value)
    return found
