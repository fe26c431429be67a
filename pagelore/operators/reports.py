"""What a finished job reports: validation, search results and predictions, each with its counts, written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.scores import percent
from pagelore.functions.text import MIN_CHARS, normalized
from pagelore.operators import paradigm
from pagelore.sources.files import numbered
from pagelore.sources.reports import write_report
from pagelore.sources.store import stored


def _facts(spark: SparkSession, about: dict[str, str]) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in sorted(about.items())]


def write_validation(scores: DataFrame, tag: str, member: str, path: str, about: dict[str, str], method: str = "p05", sigma: float = 2.0) -> None:
    """``scores`` (tag, member, score) as a validation: ``rows`` with every member's similarity_pct, whether it is valid and
    its place in its tag, the least similar first, and ``metrics``, the report of each tag. Tags of one member have a place
    and no verdict. The head has the counts over all tags."""
    scores = stored(scores.select(tag, member, "score"))
    held = scores.join(paradigm.thresholds(scores, tag, method, sigma).select(tag, "threshold"), tag, "left")
    rows = stored(numbered(held, (tag,), F.struct("score", member)).select(tag, member, percent(F.col("score")).alias("similarity_pct"), (F.col("score") >= F.col("threshold")).alias("valid"), F.col("number").alias("place")))
    valid = F.count_if("valid")
    head = rows.agg(F.count("*").alias("total_covers"), valid.alias("valid_count"), (F.count("valid") - valid).alias("invalid_count"), F.count_if(F.col("valid").isNull()).alias("not_judged"))
    write_report(path, head.select("*", F.lit(method).alias("threshold_method"), *_facts(rows.sparkSession, about)), rows=rows, metrics=paradigm.report(scores, tag, method, sigma))


def write_search(results: DataFrame, tag: str, doc: str, path: str, about: dict[str, str]) -> None:
    """The result of a search (tag, doc, similarity_pct, pass_threshold): ``all_results``, and ``found`` with each hit's place
    in its tag, the best first, ties by document; a null verdict is no hit. ``tags`` has total_files, found_count and
    found_ratio of each tag, the head those of all."""
    rows = stored(results.select(tag, doc, "similarity_pct", "pass_threshold"))
    found = numbered(rows.where("pass_threshold"), (tag,), F.struct((-F.col("similarity_pct")).alias("down"), doc))
    counts = [F.count("*").alias("total_files"), F.count_if("pass_threshold").alias("found_count"), F.round(F.coalesce(F.try_divide(F.count_if("pass_threshold"), F.count("*")), F.lit(0.0)), 6).alias("found_ratio")]
    head = rows.agg(*counts).select("*", *_facts(rows.sparkSession, about))
    write_report(path, head, all_results=rows, found=found.select(tag, doc, "similarity_pct", F.col("number").alias("place")), tags=rows.groupBy(tag).agg(*counts))


def prediction_rows(docs: DataFrame, predicted: DataFrame, doc: str, text: str, label: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, status, predicted_label, confidence_pct, probs_pct) of every document. Texts of less than ``min_chars`` are
    "skipped_short_text", those without a prediction "no_vector"; both have nulls for the rest."""
    short = F.length(normalized(F.col(text))) < min_chars
    pct = F.map_from_arrays(F.transform("labels", lambda x: x.cast("string")), F.transform("probabilities", lambda p: F.round(p * 100, 4)))
    made = predicted.select(doc, F.col(label).cast("string").alias("guess"), F.round(F.array_max("probabilities") * 100, 4).alias("sure"), pct.alias("each"))
    held = docs.select(doc, short.alias("short")).join(made, doc, "left")
    status = F.when(F.col("short"), "skipped_short_text").when(F.col("guess").isNull(), "no_vector").otherwise("ok")
    ok = F.col("status") == "ok"
    return held.withColumn("status", status).select(doc, "status", F.when(ok, F.col("guess")).alias("predicted_label"), F.when(ok, F.col("sure")).alias("confidence_pct"), F.when(ok, F.col("each")).alias("probs_pct"))


def write_predictions(rows: DataFrame, path: str, about: dict[str, str]) -> None:
    """``prediction_rows`` with total_files and predicted_count in the head, and ``labels``, the documents of each label."""
    rows = stored(rows)
    head = rows.agg(F.count("*").alias("total_files"), F.count("predicted_label").alias("predicted_count")).select("*", *_facts(rows.sparkSession, about))
    write_report(path, head, rows=rows, labels=rows.where("predicted_label is not null").groupBy("predicted_label").agg(F.count("*").alias("n")))


def first_of_each(rows: DataFrame, groups: tuple[str, ...], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group with their place, for reports of skipped or bad rows; the bound is the feature.
    Spark cuts each task's rows to ``most`` a group before it shuffles them, so a hot group is no larger than others."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def listing(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, place, rows): the distinct values of each group in order, null left out. A row a value, so the list may
    be of any length."""
    held = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("rows"))
    return numbered(held, (group,), value).select(group, value, F.col("number").alias("place"), "rows")


def kept_counts(rows: DataFrame, keep: Column, *groups: str) -> DataFrame:
    """(groups, kept, dropped): how many rows a condition keeps; one that is null drops its row."""
    ok = F.coalesce(keep, F.lit(False))
    return rows.groupBy(*groups).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
