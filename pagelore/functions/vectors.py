"""Vector algebra on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


#: Places that scores of unit vectors keep, so that vectors of one direction score alike whatever they were summed from.
SCORE_PLACES = 12


def unit_score(a: Column, b: Column) -> Column:
    """The dot product of unit vectors to SCORE_PLACES places."""
    return F.round(dot(a, b), SCORE_PLACES)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is. The norm is bound once, not worked out for each element."""
    bound = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), norm(w).alias("n")))
    scaled = F.transform(bound, lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] > 0, s["n"]).otherwise(1.0)))
    return scaled[0]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def mean_vectors(df: DataFrame, key: str, vector: str, name: str = "mean") -> DataFrame:
    """(key, mean vector): averages by key and place, so partial sums and not vectors are shuffled. The outer form keeps
    Spark from working vectors out once more to filter empty ones, which go right after."""
    places = df.select(key, F.posexplode_outer(vector).alias("pos", "x")).where("pos is not null").groupBy(key, "pos").agg(F.avg("x").alias("m"))
    held = F.array_sort(F.collect_list(F.struct("pos", "m")))  # as long as a vector
    return places.groupBy(key).agg(F.transform(held, lambda s: s["m"]).alias(name))
