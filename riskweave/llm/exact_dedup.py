"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (Misra-Gries, `approx_top_k`) names digests that may be frequent; one pass counts those exactly.
Winners, at most `candidates` rows whatever the input, are broadcast and settle their rows where they are read. The
other digests, each with a small share of the rows, go through an ordinary shuffle of ids and digests, without texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import free_name, stored

#: Most digests that the sketch proposes, hence most rows that are broadcast (about 100 bytes each).
CANDIDATES = 1_000
#: Counters of the sketch: it finds every digest with more than about 1/TRACKED of the rows.
TRACKED = 16_384


def text_digest(text):
    """SHA-256 (lowercase hex) of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ").cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = CANDIDATES, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. Null texts count as empty and equal empty ones. The smallest non-null
    id stays; rows that repeat id and text count in group_size and are kept alike; a null id stays only in a group without
    other ids. An empty table gives no rows. Other columns are never looked at, whatever their names.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")))
    proposed = rows.agg(F.expr(f"approx_top_k(text_sha256, {int(candidates)}, {int(tracked)})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"), F.col("t.count").alias("about"))
    proposed = proposed.where("about > 1").select("text_sha256")
    verified = rows.join(F.broadcast(proposed), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = stored(verified.where("group_size > 1"))
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # a digest is counted by partial sums and found again by a join that can be split, so that none is gathered in one task
    several = stored(rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    light = rest.join(several, "text_sha256", "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).fillna(1, ["group_size"])
    names = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return heavy.select(names).unionByName(light.select(names)).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called.

    Dropped rows alone are sent to be found again, by id and digest. Rows that repeat id and text stay alike.
    """
    of = free_name(docs, "digest")
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_digest")).distinct()
    d = docs.withColumn(of, text_digest(F.col(text_col)))
    return d.join(gone, d[id_col].eqNullSafe(gone["gone_id"]) & (d[of] == gone["gone_digest"]), "left_anti").drop(of)
