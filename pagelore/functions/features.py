"""Numeric features of a page's text, and their normalization."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagelore.functions.text import TOKEN

#: The text features in their fixed order; the layout features (font_count, width_mm, height_mm) come from a parser.
TEXT_FIELDS = ("chars", "token_count", "fill_percent", "spaces", "whitespace", "non_whitespace", "line_count", "empty_lines")
LAYOUT_FIELDS = ("font_count", "width_mm", "height_mm")
_COUNTED = ("chars", "token_count", "spaces", "whitespace", "line_count", "empty_lines")
_WORD = re.compile(TOKEN)


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in _COUNTED]))
def _counts(texts: pa.Array) -> pa.Array:
    """What is counted in each text, in one pass; Python has the same white space and line ends as ``WHITESPACE`` and
    ``splitlines``. As expressions, each count made a list of all its matches, and a filter made them all again."""
    rows = np.zeros((len(texts), len(_COUNTED)))
    for row, held in zip(rows, texts, strict=True):
        text = held.as_py().decode("utf-8", "replace")
        lines = text.splitlines()
        row[:] = len(text), len(_WORD.findall(text.lower())), text.count(" "), len(text) - sum(map(len, text.split())), len(lines), sum(not x.strip() for x in lines)
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(_COUNTED))


def page_features(text: Column) -> dict[str, Column]:
    """The eight text features as doubles; null is an empty page."""
    n = _counts(F.coalesce(text, F.lit("")).cast("binary"))
    filled = n["chars"] - n["whitespace"]
    made = {"fill_percent": F.coalesce(F.try_divide(filled, n["chars"]), F.lit(0.0)), "non_whitespace": filled}
    return {c: n[c] if c in _COUNTED else made[c] for c in TEXT_FIELDS}


def layout_features(fonts: Column, width_points: Column, height_points: Column) -> dict[str, Column]:
    """Distinct fonts and the page's size in millimetres."""
    return {"font_count": F.coalesce(F.size(F.array_distinct(fonts)), F.lit(0)).cast("double"), "width_mm": width_points * 25.4 / 72, "height_mm": height_points * 25.4 / 72}


def column_stats(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n, mean, std) with the population deviation, taken as 1 where it is below 1e-9."""
    aggs = [F.struct(F.lit(f).alias("field"), F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("raw")) for f in fields]
    rows = df.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return rows.select("field", "n", "mean", F.when(F.abs("raw") < 1e-9, 1.0).otherwise(F.col("raw")).alias("std"))


def zscored(df: DataFrame, fields: tuple[str, ...], suffix: str = "_z") -> DataFrame:
    """Adds each field's z-score over all rows; the statistics are one row, made by one aggregation."""
    aggs = [x for f in fields for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))]
    held = df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    out = held.withColumns({f + suffix: (F.col(f) - F.col(f"{f}_mean")) / F.when(F.abs(f"{f}_std") < 1e-9, 1.0).otherwise(F.col(f"{f}_std")) for f in fields})
    return out.drop(*[f"{f}_{s}" for f in fields for s in ("mean", "std")])
