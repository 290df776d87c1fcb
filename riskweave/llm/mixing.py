"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

#: Mean of one Poisson draw; a higher rate is the sum of equal draws, so that exp(-mean) stays far from zero.
STEP_RATE = 16.0
#: Terms of the distribution function; the tail beyond them is under 1e-40 at a mean of STEP_RATE.
TERMS = 96
#: Most rows of the table of sources that are broadcast (about 1 kB each); with more sources both sides are shuffled.
BROADCAST_SOURCES = 20_000
UNIT = float(1 << 52)


def _hashed(*parts):
    """52 bits of SHA-256 over the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None, source_col: str = "source") -> DataFrame:
    """of_source, parts and cdf: how often a row of each source is drawn, and the distribution function of one draw."""
    counts = stored(docs.groupBy(F.col(source_col).alias("of_source")).agg(F.count(F.lit(1)).alias("n")))
    rows, sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = F.lit(total if total is not None else rows)
    if weights is None:
        share = F.lit(1.0) / max(1, sources)
    else:
        known, all_of_it = F.lit(0.0), float(sum(weights.values()))
        for k, w in weights.items():
            known = F.when(F.col("of_source").eqNullSafe(F.lit(k)), F.lit(w / all_of_it if all_of_it else 0.0)).otherwise(known)
        share = known
    rated = counts.withColumn("rate", size * share / F.col("n"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1.0), F.ceil(F.col("rate") / STEP_RATE).cast("double")))
    rated = rated.withColumn("step", F.col("rate") / F.col("parts"))
    cdf = F.expr(f"aggregate(sequence(1, {TERMS - 1}), struct(exp(-step) as p, array(exp(-step)) as cs), (a, k) -> struct(a.p * step / k as p, concat(a.cs, array(element_at(a.cs, -1) + a.p * step / k)) as cs), a -> a.cs)")
    return rated.select("of_source", F.col("parts").cast("long").alias("parts"), cdf.alias("cdf"))


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """row (a struct of all columns), copy and shuffle_key of every copy, in a global order by shuffle_key."""
    table = rates(docs, weights, total, source_col)
    few = table.count() <= BROADCAST_SOURCES
    table = F.broadcast(table) if few else table
    # the row is one column, so that no name of docs can clash with those used here
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    u = F.expr(f"transform(sequence(0L, parts - 1), i -> cast(conv(substring(sha2(cast(concat_ws(':', '{seed}', cast(i as string), coalesce(cast(id as string), '')) as binary), 256), 1, 13), 16, 10) as long) / {UNIT:.0f}D)")
    drawn = d.join(table, d["source"].eqNullSafe(table["of_source"])).withColumn("u", u)
    drawn = drawn.withColumn("n", F.expr("aggregate(u, 0L, (a, u) -> a + size(filter(cdf, c -> c <= u)))")).where("n > 0")
    copies = drawn.select("row", "id", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("copy"))
    keyed = copies.withColumn("shuffle_key", _hashed(F.lit(seed), F.lit("order"), F.col("id"), F.col("copy")))
    return keyed.orderBy("shuffle_key", "id", "copy").drop("id")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of docs plus copy (from 0) and shuffle_key, in a global order by shuffle_key.

    A source's rows are repeated at the mean rate total * weight / rows: each row's count is the inverse of that Poisson
    distribution at a uniform number hashed from seed and id, so that a rerun or a lost task draws alike. Without weights
    the sources get equal shares; without total the mix has as many rows as docs, on average. A weight of zero or a source
    that weights leave out draws nothing, and so does every source if all weights are zero. A null source is a source of its own; a null id hashes as the empty text; rows
    that repeat an id draw the same count. Null and empty texts are ordinary rows, an empty table gives none. Columns of
    docs that are called copy or shuffle_key, in any case, are replaced; all others pass as they are.
    """
    mixed = replicated(docs, weights, total, seed, id_col, source_col)
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("copy", "shuffle_key")], "copy", "shuffle_key")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The copies with the columns of docs alone, all as they were."""
    return replicated(docs, weights, total, seed, id_col, source_col).select("row.*")
