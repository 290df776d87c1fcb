"""Features of account transactions: balances, trailing windows, as-of patterns, summaries and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "2010-01-01 00:00:00"
TYPES = ("PAYMENT", "TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT")
ELIGIBLE = ("TRANSFER", "CASH_OUT")
#: Windows in one stretch of an account's time; rows of about one in BUCKET windows are dealt twice.
BUCKET = 32
#: Parts for each core that rows are dealt into: a task sorts one part, so its memory is that share of the input.
SPREAD = 8


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys into SPREAD parts a core, or into the session's shuffle partitions if those are more."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD * spark.sparkContext.defaultParallelism), *keys)


def _account() -> Window:
    return Window.partitionBy("nameOrig").orderBy("step", "row_id")


def _trailing(window: int):
    """Rows of the account from step - window to step; peers of the same step count, also later ones."""
    return Window.partitionBy("nameOrig").orderBy("step").rangeBetween(-window, 0)


def balances(tx: DataFrame) -> DataFrame:
    """How far both balances are from what the amount explains."""
    return tx.withColumns({"error_balance_orig": F.col("oldbalanceOrg") - F.col("amount") - F.col("newbalanceOrig"), "error_balance_dest": F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest")})


def calendar(tx: DataFrame) -> DataFrame:
    """Merchant flag, hour, day and UTC time of the step."""
    return tx.withColumns({
        "is_merchant_dest": F.coalesce(F.col("nameDest").startswith("M"), F.lit(False)), "hour_of_day": F.pmod("step", F.lit(24)), "day_index": F.floor(F.col("step") / 24),
        "event_time": F.timestamp_add("HOUR", F.col("step"), F.lit(EPOCH).cast("timestamp")), "time_basis": F.lit("synthetic_step_hours"),
    })


def recency(tx: DataFrame) -> DataFrame:
    """Steps since the account's previous transaction."""
    return spread(tx, "nameOrig").withColumn("steps_since_prev", F.col("step") - F.lag("step").over(_account()))


def bucketed(tx: DataFrame, window: int) -> DataFrame:
    """Rows dealt by account and stretch of BUCKET windows, each also in the next stretch if windows there reach back to it
    (__own is false there); so an account with very many rows is split, and every window lies within one stretch."""
    width = BUCKET * window
    bucket = F.floor(F.col("step") / width)
    reaches = F.col("step") >= (bucket + 1) * width - window
    both = F.when(reaches, F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own"))))
    parts = tx.withColumn("__e", F.explode(both)).withColumns({"__bucket": F.col("__e.b"), "__own": F.col("__e.own")}).drop("__e")
    return spread(parts, "nameOrig", "__bucket")


def trailing(tx: DataFrame, window: int = 24) -> DataFrame:
    """Count, sum and distinct destinations over the trailing window, and the amount against the window's average.

    A destination counts from its first row until `window` steps after the last one that follows within the window: the
    number of destinations at a row is that of such starts up to its step without that of such ends before it. Null is no
    destination. One shuffle, by account and stretch of time.
    """
    if window < 1:
        raise ValueError("window must be at least 1 step")
    dealt = bucketed(tx, window)
    w = Window.partitionBy("nameOrig", "__bucket").orderBy("step")
    to = Window.partitionBy("nameOrig", "__bucket", "nameDest").orderBy("step")
    before, after = F.lag("step").over(to), F.lead("step").over(to)
    known = F.col("nameDest").isNotNull()
    opens, closes = known & (before.isNull() | (F.col("step") > before + window)), known & F.col("step").isNotNull() & (after.isNull() | (after > F.col("step") + window))
    recent, upto, ended = w.rangeBetween(-window, 0), w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -window - 1)
    out = dealt.withColumns({"__opens": opens.cast("int"), "__closes": closes.cast("int")})
    out = out.withColumns({"txn_count": F.count(F.lit(1)).over(recent), "total_amount": F.sum("amount").over(recent), "unique_dest": F.sum("__opens").over(upto) - F.coalesce(F.sum("__closes").over(ended), F.lit(0))})
    average = F.col("total_amount") / F.col("txn_count")
    return out.where("__own").drop("__bucket", "__own", "__opens", "__closes").withColumn("amount_ratio", F.when(average != 0, F.col("amount") / average).otherwise(1.0))


def transfer_then_cash_out(tx: DataFrame, window: int = 2) -> DataFrame:
    """Whether a CASH_OUT has a TRANSFER of the account at most `window` steps before it, or at its step.

    The nearest earlier TRANSFER is near enough exactly if any is, so a range frame says it without a join.
    """
    near = F.max((F.col("type") == "TRANSFER").cast("int")).over(_trailing(window)) == 1
    return spread(tx, "nameOrig").withColumn("is_transfer_then_cashout", (F.col("type") == "CASH_OUT") & near)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """Backward as-of join: each left row with the right value of the latest time not after it (the largest at a tie).

    Both sides form one union, ordered per key; the value is carried forward. One shuffle, no pairs.
    """
    r = right.groupBy(key, time).agg(F.max(value).alias("__value"))
    names = left.columns
    union = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(dict(r.dtypes)["__value"])}).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn(out, F.last("__value", ignorenulls=True).over(w)).where("__side = 1").select(*names, out)


def adjacent_pattern(tx: DataFrame, gap: int = 2) -> DataFrame:
    """Accounts whose next TRANSFER or CASH_OUT after a TRANSFER is a CASH_OUT within `gap` steps."""
    two = tx.where(F.col("type").isin(*ELIGIBLE))
    w = _account()
    after = two.withColumns({"next_type": F.lead("type").over(w), "next_gap": F.lead("step").over(w) - F.col("step")})
    return after.where((F.col("type") == "TRANSFER") & (F.col("next_type") == "CASH_OUT") & F.col("next_gap").between(0, gap)).select("nameOrig").distinct()


def one_hot(tx: DataFrame, levels: tuple[str, ...] = TYPES) -> DataFrame:
    """An int column for each level; the raw type stays."""
    return tx.withColumns({f"type_{t}": (F.col("type") == t).cast("int") for t in levels})


def with_entity(tx: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """entity_id of the account, null if it has none."""
    return tx.join(crosswalk.select(F.col("account").alias("nameOrig"), "entity_id"), "nameOrig", "left")


def account_summary(tx: DataFrame, least: int = 1) -> DataFrame:
    """Activity of each account with at least `least` transactions."""
    kind = lambda t: F.count_if(F.col("type") == t)
    out = tx.groupBy("nameOrig").agg(F.count(F.lit(1)).alias("total_txn_count"), F.sum("amount").alias("total_amount"), kind("TRANSFER").alias("transfer_count"), kind("CASH_OUT").alias("cashout_count"), F.sum("isFraud").alias("fraud_count"), F.sum("isFlaggedFraud").alias("flagged_fraud_count"))
    pattern = adjacent_pattern(tx).withColumn("has_transfer_then_cashout", F.lit(True))
    return out.where(F.col("total_txn_count") >= least).join(pattern, "nameOrig", "left").fillna({"has_transfer_then_cashout": False})


def entity_coverage(crosswalk: DataFrame, tx: DataFrame, low: int = 2) -> DataFrame:
    """Transactions of each mapped account, and whether it is missing or has few."""
    n = tx.groupBy(F.col("nameOrig").alias("account")).agg(F.count(F.lit(1)).alias("n"))
    out = crosswalk.join(n, "account", "left").withColumn("txn_count", F.coalesce("n", F.lit(0)))
    return out.withColumns({"missing": F.col("txn_count") == 0, "low_activity": F.col("txn_count").between(1, low - 1)}).drop("n")


def eligible(tx: DataFrame) -> DataFrame:
    """Transactions that the fraud model scores, by type or, where it is null, by its one-hot columns."""
    hot = [F.coalesce(F.col(f"type_{t}"), F.lit(0)) == 1 for t in ELIGIBLE if f"type_{t}" in tx.columns]
    by_type = F.col("type").isin(*ELIGIBLE)
    for h in hot:
        by_type = F.coalesce(by_type, F.lit(False)) | (F.col("type").isNull() & h)
    return tx.where(by_type)


def earliest_fraud(tx: DataFrame) -> DataFrame:
    """The first fraudulent transaction of each account, by step, amount and row."""
    w = Window.partitionBy("nameOrig").orderBy("step", "amount", "row_id")
    return tx.where("isFraud = 1").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def split_steps(tx: DataFrame, train: float = 0.6, val: float = 0.8) -> DataFrame:
    """train_cut and val_cut: the steps at those positions of all sorted steps; val_cut is moved above train_cut.

    Counts per step stand in for the sorted rows, so the ordered pass is over distinct steps alone.
    """
    per = tx.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    upto = per.withColumns({"upto": F.sum("n").over(Window.orderBy("step")), "all": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    at = lambda f: F.min(F.when(F.col("upto") > F.floor(F.col("all") * F.lit(f)), F.col("step")))
    cuts = upto.agg(at(train).alias("train_cut"), at(val).alias("val_cut"))
    return cuts.withColumn("val_cut", F.greatest("val_cut", F.col("train_cut") + 1))


def part(train_cut: Column, val_cut: Column) -> Column:
    """train, val or test, by the step."""
    return F.when(F.col("step") <= train_cut, "train").when(F.col("step") <= val_cut, "val").otherwise("test")


def time_split(tx: DataFrame, train: float = 0.6, val: float = 0.8) -> DataFrame:
    """part = train, val or test of each row, by its step."""
    cuts = split_steps(tx, train, val)
    return tx.join(F.broadcast(cuts)).withColumn("part", part(F.col("train_cut"), F.col("val_cut"))).drop("train_cut", "val_cut")  # cuts has one row


def joined_back(pairs: DataFrame, tx: DataFrame, keys: tuple[str, ...] = ("nameOrig", "step", "amount")) -> DataFrame:
    """The raw rows of distinct keys, with how many rows each key has found, 0 too: a caller wants exactly one."""
    wanted = pairs.select(*keys).distinct()
    n = wanted.join(tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), list(keys), "left").fillna(0, ["n_rows"])
    return n.join(tx, list(keys), "left")


def exactly_one(found: DataFrame, keys: tuple[str, ...] = ("nameOrig", "step", "amount")) -> DataFrame:
    """What joined_back found; raises unless each key has one row."""
    bad = [tuple(r) for r in found.where("n_rows <> 1").select(*keys, "n_rows").distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"keys without exactly one row: {bad}")
    return found.drop("n_rows")
