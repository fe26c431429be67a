"""Exact order statistics of many columns and groups at once: no task ranks a whole group or column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.sources.store import stored

#: Rows that a cell should have at most, and the least and most cells of a column; they set what a task ranks, not the result.
CELL_ROWS, FEWEST, MOST = 100_000, 16, 1 << 15


def _cell(bounds: Column, v: Column, count: int) -> Column:
    """Number of v's cell by binary search: 2 i + 1 is the i-th bound itself, 2 i what lies below it and above the one before."""
    steps = [1 << i for i in reversed(range(count.bit_length()))]
    below = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when((at + s <= count) & (F.get(bounds, at + s - 1) < v), at + s).otherwise(at))
    return F.transform(F.array(below), lambda b: 2 * b + F.when(F.get(bounds, b) == v, 1).otherwise(0))[0]


def between(lo: Column, hi: Column, part: Column) -> Column:
    """Interpolated and never beyond its neighbours, so equal values give just that value."""
    return F.when(lo == hi, lo).otherwise(F.least(hi, lo + part * (hi - lo)))


def order_statistics(rows: DataFrame, key: str | None, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(key, a struct (n, q) a column): how many values a group has, and their quantiles between neighbouring ranks.

    ``rows`` is read three times, so it should be stored. First bounds of each column over all groups are taken from a
    sketch; a value that is common in the whole column is a bound. Values equal to a bound are a cell of their own, and
    those between two bounds another, of at most a like share of all rows, whatever the groups. Counts of cells by group
    then say which of them have the wanted ranks, and only the values of those cells between bounds are collected and sorted.
    Null values don't count, null keys have no row, nor has a group without values in any column; without a key there is
    one row if there is any value.
    """
    count = max(FEWEST, min(MOST, rows.count() // CELL_ROWS))
    at = F.array(*(F.lit((i + 0.5) / count) for i in range(count)))
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    held = rows.select(F.lit(0).alias("k") if key is None else F.col(f"`{key}`").alias("k"), *(F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items())).where("k is not null")
    sketch = held.agg(F.array(*(F.coalesce(F.percentile_approx(n, at, 4 * count), F.array().cast("array<double>")) for n in names.values())).alias("bounds"))
    tall = held.select("k", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(n).alias("v")) for i, n in enumerate(names.values())))).alias("x")).select("k", "x.c", "x.v").where("v is not null")
    placed = tall.crossJoin(F.broadcast(sketch)).select("k", "c", "v", _cell(F.get("bounds", F.col("c")), F.col("v"), count).alias("cell"))  # one row

    group = Window.partitionBy("k", "c")  # of cells: 2 * count + 1 rows at most
    cells = placed.groupBy("k", "c", "cell").agg(F.count("*").alias("held"), F.min("v").alias("same"))
    cells = cells.withColumn("n", F.sum("held").over(group)).withColumn("before", F.sum("held").over(group.orderBy("cell")) - F.col("held"))
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = F.lit(not shares) & (F.col("before") == 0)
    for p in places:
        wanted |= (F.ceil(p) >= F.col("before")) & (F.floor(p) < F.col("before") + F.col("held"))
    cells = cells.where(wanted)
    known = cells.select("k", "c", "n", "before", "held", F.array("same").alias("vs")).where("cell % 2 = 1")
    sought = cells.where("cell % 2 = 0").select("k", "c", "cell", "n", "before", "held")
    found = placed.where("cell % 2 = 0").join(sought, ["k", "c", "cell"]).groupBy("k", "c", "n", "before", "held").agg(F.sort_array(F.collect_list("v")).alias("vs"))

    def value(rank: Column, c: int) -> Column:
        here = (F.col("c") == c) & (rank >= F.col("before")) & (rank < F.col("before") + F.col("held"))
        return F.max(F.when(here, F.get("vs", F.least(rank - F.col("before"), F.size("vs") - 1).cast("int"))))

    out = []
    for i, c in enumerate(columns):
        q = [F.struct(value(F.floor(p), i).alias("lo"), value(F.ceil(p), i).alias("hi"), F.max(F.when(F.col("c") == i, p - F.floor(p))).alias("part")) for p in places]
        n = F.coalesce(F.max(F.when(F.col("c") == i, F.col("n"))), F.lit(0))
        out.append(F.struct(n.alias("n"), F.array(*q).alias("q")).alias(c))
    picked = known.unionByName(found).groupBy("k").agg(*out)
    exact = [F.struct(F.col(f"`{c}`")["n"].alias("n"), F.transform(F.col(f"`{c}`")["q"], lambda s: between(s["lo"], s["hi"], s["part"])).alias("q")).alias(c) for c in columns]
    return picked.select(*([] if key is None else [F.col("k").alias(key)]), *exact)


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(key, n, q): number and quantiles of the non-null values of each key that has any. ``rows`` is stored first."""
    held = stored(rows.select(F.col(f"`{key}`").alias("group"), F.col(f"`{value}`").cast("double").alias("v")))
    return order_statistics(held, "group", ["v"], shares).select(F.col("group").alias(key), "v.n", "v.q")
