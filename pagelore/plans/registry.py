"""Registry of the queries: name, DataFrame plan, and equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(plan: Query) -> Query:
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantile_sql(values: str, share: float) -> str:
    """SQL for the interpolated quantile of a sorted list, the rule of ``operators.quantiles.between``."""
    place = f"({share}::double * (len({values}) - 1))"
    lo, hi = f"{values}[floor({place})::int + 1]", f"{values}[ceil({place})::int + 1]"
    return f"case when {lo} = {hi} then {lo} else least({hi}, {lo} + ({place} - floor({place})) * ({hi} - {lo})) end"
