"""Structured Streaming forms of parsing, novelty, windows, ingestion and correlation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.functions import scalars as s
from riskweave.operators import correlation as c
from riskweave.sources.tail import TailSource
from riskweave.sources.versioned import VersionedTable


def kafka_lines(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """Lines of a topic from its earliest offset; the query's checkpoint keeps what has been read."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    reader = reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader
    return reader.load().select(F.col("value").cast("string").alias("line"))


def kafka_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str):
    """Rows as JSON into a topic, at least once."""
    return rows.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def parsed(lines: DataFrame) -> DataFrame:
    """Fields of well-formed log lines; stateless."""
    return lines.select(*[v.alias(k) for k, v in s.log_fields(F.col("line")).items()]).where("log_id is not null")


def hourly(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Events per user and hour; an hour is closed, and emitted once, when the watermark passes it."""
    return events.withWatermark("event_time", late).groupBy("user_id", F.window("event_time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("window_start"), "n_events")


def novelty(events: DataFrame, value: str = "pc_id") -> DataFrame:
    """event_id and new, as in the batch form, for a stream whose batches come in order of time.

    State of a user: the values seen so far.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(frames)).sort_values(["event_time", "event_id"])
        new = []
        for v in rows[value]:
            new.append(int(v not in seen and bool(v)))
            seen.add(v)
        state.update((sorted(x for x in seen if x),))
        yield pd.DataFrame({"event_id": rows["event_id"], "new": new})

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id string, new int", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def correlated(assessments: DataFrame, minutes: int = c.WINDOW_MINUTES) -> DataFrame:
    """assessment_id, entity_id and anchor (microseconds) of every timed record of an entity that got new ones.

    Lateness has no limit: an entity's whole history is its state and is windowed again, so the last output of an entity
    is what a batch over all its records gives.
    """
    limit = minutes * 60_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = (list(x) for x in state.get) if state.exists else ([], [])
        have = set(ids)
        for frame in frames:
            for i, t in zip(frame["assessment_id"], frame["us"]):
                if i not in have:
                    have.add(i)
                    ids.append(i)
                    times.append(int(t))
        state.update((ids, times))
        anchor, out = None, []
        for t, i in sorted(zip(times, ids)):
            anchor = t if anchor is None or t - anchor > limit else anchor
            out.append((i, key[0], anchor))
        yield pd.DataFrame(out, columns=["assessment_id", "entity_id", "anchor"])

    timed = assessments.where("event_time is not null").select("entity_id", "assessment_id", F.unix_micros("event_time").alias("us"))
    return timed.groupBy("entity_id").applyInPandasWithState(step, "assessment_id string, entity_id string, anchor bigint", "ids array<string>, times array<bigint>", "update", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, ledger: str, dead: str, checkpoint: str, each: Callable[[DataFrame, int], Any] | None = None):
    """Validated new records to the ledger, rejected ones with their errors to the dead-letter table.

    A batch writes under its own number and replaces that folder when it is repeated, so at-least-once delivery leaves
    every record once.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        checked = c.invalid(df).persist()
        bad = checked.where(F.size("errors") > 0)
        bad.select(F.to_json(F.struct(*df.columns)).alias("payload"), F.array_join("errors", ",").alias("error"), F.col("errors").alias("details")).write.mode("overwrite").json(f"{dead}/batch={number}")
        good = c.dedupe(checked.where(F.size("errors") == 0).drop("errors"), ["event_time"])
        earlier = _earlier(spark, ledger, number, good)
        good = c.new_only(good, earlier) if earlier is not None else good
        good.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        if each:
            each(spark.read.parquet(f"{ledger}/batch={number}"), number)
        checked.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def _earlier(spark: SparkSession, ledger: str, number: int, like: DataFrame) -> DataFrame | None:
    if not number:
        return None
    return spark.read.schema(like.schema.add("batch", T.IntegerType())).parquet(ledger).where(F.col("batch") < number).drop("batch")


def buffered(stream: DataFrame, keep: int, folder: str, checkpoint: str, each: Callable[[DataFrame], None], order: str = "log_id"):
    """each gets the last `keep` rows, by order, after every batch; the tail is kept between batches in folder."""

    def batch(df: DataFrame, number: int) -> None:
        before = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/tail-{number - 1}") if number else None
        tail = (before.unionByName(df) if before is not None else df).orderBy(F.desc(order)).limit(keep)
        tail.write.mode("overwrite").parquet(f"{folder}/tail-{number}")
        each(df.sparkSession.read.parquet(f"{folder}/tail-{number}"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def snapshots(stream: DataFrame, table: VersionedTable, checkpoint: str, of: Callable[[DataFrame], DataFrame]):
    """After each batch the whole result of `of` over it is the table's next version; readers see one or the other, whole."""
    return stream.writeStream.foreachBatch(lambda df, _: table.overwrite(of(df))).option("checkpointLocation", checkpoint).start()


def tailed(spark: SparkSession, folder: str, group: str = "default", most: int = 64 << 20) -> DataFrame:
    """partition, offset and line of a folder of growing files, from where the group has come to."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", folder).option("group", group).option("bytes", str(most)).load()


def consume(lines: DataFrame, ledger: VersionedTable, dead: VersionedTable, checkpoint: str, each: Callable[[int], Any] | None = None):
    """JSON records of lines (partition, offset, line) into the ledger, each id once; others with error, payload and details
    into dead, each offset once. Offsets count as handled after both, so a batch that comes again changes nothing."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ledger.schema.fields)

    def batch(df: DataFrame, number: int) -> None:
        parsed = df.withColumn("r", F.from_json("line", kind)).select("partition", "offset", "line", "r.*")
        checked = c.invalid(parsed).persist()
        bad = checked.where(F.size("errors") > 0)
        dead.insert_new(bad.select(F.concat_ws(":", "partition", "offset").alias("at"), F.array_join("errors", ",").alias("error"), F.col("line").alias("payload"), F.to_json(F.struct("errors")).alias("details")), "at")
        ledger.insert_new(checked.where(F.size("errors") == 0).select(*ledger.schema.names), "assessment_id")
        checked.unpersist()
        if each:
            each(number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
