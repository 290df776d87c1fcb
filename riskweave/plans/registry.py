"""Queries over the test tables, by name, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.plans import views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def half_even_sql(x: str, digits: int) -> str:
    """DuckDB: a double between 0 and 1 rounded to digits, half to even on its binary value, in whole numbers of 2**-100."""
    one = f"{1 << 100}"
    v = f"(({x}) * {one}::double)::hugeint * {10**digits}"
    up = f"({v} % {one}::hugeint > {1 << 99}::hugeint or {v} % {one}::hugeint = {1 << 99}::hugeint and ({v} // {one}::hugeint) % 2 = 1)::int"
    return f"(({v} // {one}::hugeint + {up})::double / {10.0**digits}::double)"


def query(name: str, inputs: str, sql: str | None = None):
    """Register a function of the named tables or views; sql is a SELECT over the same names, optionally WITH its own parts."""
    names = inputs.split()

    def register(of: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: of(*(views.table(spark, sf_dir, n) for n in names))
        if sql:
            body = sql.strip()
            parts = [f"{n} as ({views.duckdb(n)})" for n in names if n in views.VIEWS]
            if body.startswith("with "):
                cut = len("with recursive ") if body.startswith("with recursive ") else len("with ")
                body = f"with recursive {', '.join([*parts, body[cut:]])}"
            elif parts:
                body = f"with {', '.join(parts)} {body}"
            _SQL[name] = body
        return of

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from riskweave.plans import behaviour, correlation, entities, fraud, incidents, models, scalars, transactions  # noqa: F401  they register theirs

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents: anchored windows over assessments of both domains, fused and decided."""
    from riskweave.operators import correlation as c

    return c.incidents(c.anchored(views.table(spark, sf_dir, "asm")))
