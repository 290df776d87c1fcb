"""Streams against their batch forms, fed by files in shuffled micro-batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riskweave.operators import correlation as c
from riskweave.operators import events as e
from riskweave.streaming import streams


def feed(spark, df, folder, parts, order=None):
    """Write rows as one file a part and read them as a stream of one file a batch."""
    rows = df.collect()
    if order:
        rows.sort(key=lambda r: r[order])
    else:
        random.Random(1).shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def sample(spark, n=60):
    r = random.Random(3)
    rows = [(f"A{k}", f"E{r.randrange(4)}", r.choice(["ps1_behavioral", "ps2_transaction"]), r.random(), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(900))) for k in range(n)]
    return spark.createDataFrame(rows, "assessment_id string, entity_id string, domain string, score double, event_time timestamp")


def run(query):
    query.processAllAvailable()
    query.stop()


def test_correlation_converges(spark, tmp_path):
    df = sample(spark)
    out = streams.correlated(feed(spark, df, str(tmp_path), 4))
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r["assessment_id"]] = r["anchor"]

    run(out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start())
    want = {r[0]: r[1] for r in c.anchored(df).select("assessment_id", F.unix_micros("anchor")).collect()}
    assert seen == want


def test_novelty_is_incremental(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"{k:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), f"U{r.randrange(3)}", f"P{r.randrange(6)}") for k in range(80)]
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, user_id string, pc_id string")
    seen = {}
    run(streams.novelty(feed(spark, df, str(tmp_path), 3, "event_id")).writeStream.outputMode("append").foreachBatch(lambda b, _: seen.update({x[0]: x[1] for x in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert seen == {x["event_id"]: x["new"] for x in e.first_of(df, ["user_id", "pc_id"], "new").collect()}


def test_ingest_once_with_dead_letters(spark, tmp_path):
    df = sample(spark, 20)
    bad = spark.createDataFrame([("", "E", "ps1_behavioral", 0.5, None)], df.schema)
    stream = feed(spark, df.unionByName(df).unionByName(bad), str(tmp_path), 3)
    run(streams.ingest(stream, str(tmp_path / "ledger"), str(tmp_path / "dead"), str(tmp_path / "cp")))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "ledger")).select("assessment_id").collect()) == sorted(r[0] for r in df.select("assessment_id").collect())
    assert [r["error"] for r in spark.read.json(str(tmp_path / "dead")).collect()] == ["assessment_id"]


def test_hourly_and_buffer(spark, tmp_path):
    df = sample(spark).select(F.col("assessment_id").alias("log_id"), F.col("entity_id").alias("user_id"), "event_time")
    seen = {}
    run(streams.hourly(feed(spark, df, str(tmp_path), 2), "30 hours").writeStream.outputMode("complete").foreachBatch(lambda b, _: seen.update({(x[0], x[1]): x[2] for x in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert seen == {(x[0], x[1]): x[2] for x in df.groupBy("user_id", F.date_trunc("hour", "event_time")).count().collect()}
    tails = []
    run(streams.buffered(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 10, str(tmp_path / "tail"), str(tmp_path / "cp2"), lambda t: tails.append(t.count())))
    assert tails and set(tails) == {10}
