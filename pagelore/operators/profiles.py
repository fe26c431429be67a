"""Profiles of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.quantiles import order_statistics
from pagelore.sources.store import stored


def profile(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n, min, median, mean, max, std) of each field. Fields are worked out once and stored; the deviation is the
    population's, taken as 1 where it is below 1e-9; of a field without values all but n are null."""
    names = {f: f"c{i}" for i, f in enumerate(fields)}
    held = stored(df.select(*(F.col(f"`{f}`").cast("double").alias(n) for f, n in names.items())))
    raw = [F.struct(F.lit(f).alias("field"), F.count(n).alias("n"), F.min(n).alias("min"), F.avg(n).alias("mean"), F.max(n).alias("max"), F.stddev_pop(n).alias("raw")) for f, n in names.items()]
    rows = held.agg(F.array(*raw).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    middles = order_statistics(held, None, list(names.values()), (0.5,)).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(n)["q"][0].alias("median")) for f, n in names.items()))).alias("m")).select("m.*")
    out = rows.join(F.broadcast(middles), "field", "left")  # a row a field
    return out.select("field", "n", "min", "median", "mean", "max", F.when(F.abs("raw") < 1e-9, 1.0).otherwise(F.col("raw")).alias("std"))
