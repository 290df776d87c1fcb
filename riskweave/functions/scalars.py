"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token, status, risk weight and family of cryptographic algorithms; the first token that a name holds decides.
ALGORITHMS = (
    ("ML-KEM", "quantum_safe", 0.0, "pqc"),
    ("KYBER", "quantum_safe", 0.0, "pqc"),
    ("ML-DSA", "quantum_safe", 0.0, "pqc"),
    ("DILITHIUM", "quantum_safe", 0.0, "pqc"),
    ("SPHINCS", "quantum_safe", 0.0, "pqc"),
    ("AES-256", "quantum_safe", 0.05, "symmetric"),
    ("AES256", "quantum_safe", 0.05, "symmetric"),
    ("AES-128", "quantum_weakened", 0.40, "symmetric"),
    ("AES128", "quantum_weakened", 0.40, "symmetric"),
    ("3DES", "legacy_broken", 0.90, "symmetric"),
    ("MD5", "broken", 0.85, "hash"),
    ("SHA-1", "broken", 0.80, "hash"),
    ("HMAC", "quantum_adequate", 0.10, "hash"),
    ("SHA-256", "quantum_adequate", 0.10, "hash"),
    ("SHA256", "quantum_adequate", 0.10, "hash"),
    ("RSA", "quantum_vulnerable", 1.0, "asymmetric"),
    ("ECDSA", "quantum_vulnerable", 1.0, "asymmetric"),
    ("ECDHE", "quantum_vulnerable", 1.0, "asymmetric"),
    ("ECDH", "quantum_vulnerable", 1.0, "asymmetric"),
    ("ECC", "quantum_vulnerable", 1.0, "asymmetric"),
    ("DSA", "quantum_vulnerable", 1.0, "asymmetric"),
    ("DIFFIE", "quantum_vulnerable", 1.0, "asymmetric"),
    ("DH", "quantum_vulnerable", 1.0, "asymmetric"),
)
# Replacements by purpose, weights of sensitivity, tiers of priority and the years from which stored data is worth harvesting.
REPLACEMENTS = {"key_exchange": "ML-KEM (Kyber)", "signature": "ML-DSA (Dilithium)"}
SENSITIVITY = {"public": 0.1, "internal": 0.4, "confidential": 0.7, "restricted": 1.0}
TIERS, HARVEST_YEARS = (("CRITICAL", 0.7), ("HIGH", 0.45), ("MEDIUM", 0.2)), 5
USER_ID, PC_ID = "^[A-Z]{3}[0-9]{4}$", "^PC-[0-9]{4}$"
US_TIME = "MM/dd/yyyy HH:mm:ss"
ISO_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
LOG_FORMATS = ("dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm")


def parse_any(text: Column, formats: tuple[str, ...] = LOG_FORMATS) -> Column:
    """The time that the first fitting format reads, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def us_time(text: Column) -> Column:
    """A time like 01/31/2010 07:00:00, else null."""
    return parse_any(text, (US_TIME,))


def iso_time(text: Column) -> Column:
    """An ISO-8601 date or time; Z and offsets count, without either it is UTC's session time; anything else is null."""
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp"))


def strict_bool(text: Column) -> Column:
    """True, False or, for an empty text, null; anything else raises."""
    return F.when(text == "True", True).when(text == "False", False).when((text == "") | text.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)))


def to_utc(local: Column, zone: str) -> Column:
    """Local time to UTC, null where the zone skips that time."""
    utc = F.to_utc_timestamp(local, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == local, utc)


def to_utc_strict(local: Column, zone: str) -> Column:
    """Local time to UTC; a time that the zone skips, or has twice, raises."""
    utc = F.to_utc_timestamp(local, zone)
    # the zone's offsets before and after any shift near by: both may lead back to the same local time
    day = F.expr("interval 1 day")
    offset = lambda t: F.from_utc_timestamp(t, zone) - t
    sides = [local - offset(utc - day), local - offset(utc + day)]
    again = F.lit(False)
    for side in sides:
        again = again | ((side != utc) & (F.from_utc_timestamp(side, zone) == local))
    fault = lambda what: F.raise_error(F.concat(F.lit(f"{what} time in {zone}: "), local.cast("string"))).cast("timestamp")
    return F.when(F.from_utc_timestamp(utc, zone) != local, fault("skipped")).when(again, fault("ambiguous")).otherwise(utc)


def number(text: Column) -> Column:
    """A double; null, NaN and garbage are 0."""
    return F.coalesce(F.nanvl(text.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def flag_number(flag: Column) -> Column:
    """A boolean as 0 or 1; null is 0."""
    return F.coalesce(flag.cast("double"), F.lit(0.0))


def logistic(score: Column, slope: float = 45.0) -> Column:
    return F.round(1 / (1 + F.exp(score * slope)), 4)


def interpolate(x: Column, knots: list[float], values: list[float]) -> Column:
    """Piecewise linear through (knot, value), clamped at both ends; of equal knots the last counts."""
    at = F.array(*[F.lit(float(k)) for k in knots])
    v = F.array(*[F.lit(float(y)) for y in values])
    n = F.size(F.filter(at, lambda k: k <= x))
    lo, hi = F.get(at, n - 1), F.get(at, n)
    a, b = F.get(v, n - 1), F.get(v, n)
    return F.when(x.isNull(), None).when(n == 0, F.lit(float(values[0]))).when(n == len(knots), F.lit(float(values[-1]))).otherwise(a + (b - a) * (x - lo) / (hi - lo))


def algorithm(name: Column) -> tuple[Column, Column]:
    """Status and risk weight."""
    upper, status, risk = F.upper(F.coalesce(name, F.lit(""))), F.lit("unknown"), F.lit(0.5)
    for token, s, r, _ in reversed(ALGORITHMS):
        status, risk = F.when(F.contains(upper, F.lit(token)), s).otherwise(status), F.when(F.contains(upper, F.lit(token)), r).otherwise(risk)
    return status, risk


def family(name: Column) -> Column:
    """The family of the token that decides."""
    upper, out = F.upper(F.coalesce(name, F.lit(""))), F.lit("unknown")
    for token, _, _, kind in reversed(ALGORITHMS):
        out = F.when(F.contains(upper, F.lit(token)), kind).otherwise(out)
    return out


def replacement(status: Column, family_: Column, purpose: Column) -> Column:
    """What should take an algorithm's place."""
    by_purpose = F.lit("ML-KEM / ML-DSA")
    for k, v in REPLACEMENTS.items():
        by_purpose = F.when(purpose == k, v).otherwise(by_purpose)
    return F.when(status.isin("quantum_safe", "pqc", "quantum_adequate"), "none (already adequate)").when(family_ == "symmetric", "AES-256").otherwise(by_purpose)


def sensitivity(level: Column) -> Column:
    w = F.lit(0.4)
    for k, v in SENSITIVITY.items():
        w = F.when(F.lower(level) == k, v).otherwise(w)
    return w


def half_even(x: Column, digits: int) -> Column:
    """The decimal of so many digits that is nearest to the exact binary value of a double, the even one at a tie.

    The product with the power of ten is taken with its rounding error, from the halves of both factors, so that a product
    that looks like a tie is told from one that is.
    """
    scale, half = 10.0**digits, 134217729.0
    p, top = x * F.lit(scale), x * F.lit(half)
    high = top - (top - x)
    low, s_high = x - high, half * scale - (half * scale - scale)
    s_low = scale - s_high
    error = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    tied = F.abs(p - F.rint(p)) == 0.5
    whole = F.when(tied & (error > 0), F.ceil(p).cast("double")).when(tied & (error < 0), F.floor(p).cast("double")).otherwise(F.rint(p))
    return F.when(F.abs(p) < float(1 << 52), whole / scale).otherwise(x)


def priority(risk: Column, level: Column, years: Column) -> Column:
    """Risk by sensitivity and by how long the data must stay secret."""
    return half_even(risk * sensitivity(level) * (0.4 + 0.6 * F.least(years / 10, F.lit(1.0))), 3)


def tier(score: Column) -> Column:
    out = F.lit("LOW")
    for name, least in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def harvest_now(status: Column, level: Column, years: Column) -> Column:
    return (status == "quantum_vulnerable") & F.lower(level).isin("confidential", "restricted") & (years >= HARVEST_YEARS)


def log_fields(line: Column) -> dict[str, Column]:
    """Fields of a tab-separated line of exactly five; null for any other line."""
    parts = F.split(line, "\t")
    ok = F.size(parts) == 5
    pick = lambda i: F.when(ok, F.get(parts, F.lit(i)))
    return {"log_id": pick(0), "ts": parse_any(pick(1)), "user": F.substring_index(pick(2), "/", -1), "pc": F.regexp_replace(pick(3), "^PC-", ""), "activity": pick(4)}


def iso_utc(ts: Column) -> Column:
    """ISO-8601 in UTC, with six digits of a second where it has a fraction."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Rows as JSON with names and map keys in order at every depth, times in ISO-8601 UTC, and nulls as they are."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda k, v: clean(v, kind.valueType))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
        return iso_utc(c) if isinstance(kind, T.TimestampType) else c

    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*[clean(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names]), {"ignoreNullFields": "false"})
