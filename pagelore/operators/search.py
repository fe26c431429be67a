"""Finding and ranking the documents that pass a tag's cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.scores import passes, percent
from pagelore.functions.text import MIN_CHARS, normalized
from pagelore.functions.vectors import doubles, unit, unit_score


def find_docs(vectors: DataFrame, paradigms: DataFrame, tag: str, doc: str, vec: str, override_pct: float | None = None) -> DataFrame:
    """(tag, doc, similarity_pct, pass_threshold) of every document against every paradigm (tag, paradigm, threshold).

    The catalog is a stated, small set against all rows; Spark broadcasts it if its measured size allows.
    """
    held = vectors.select(doc, unit(doubles(F.col(vec))).alias("u")).join(paradigms.select(tag, "paradigm", "threshold"), F.lit(True))
    score = unit_score(F.col("u"), F.col("paradigm"))
    return held.select(tag, doc, percent(score).alias("similarity_pct"), passes(score, F.col("threshold"), override_pct).alias("pass_threshold"))


def found(results: DataFrame, doc: str) -> DataFrame:
    """The passing rows, best first, ties by document."""
    return results.where("pass_threshold").orderBy(F.col("similarity_pct").desc(), F.col(doc).asc())


def compare_page(pages: DataFrame, vectors: DataFrame, paradigm: DataFrame, doc: str, text: str, vec: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each page's similarity with one paradigm; "insufficient_text" and nulls for pages of too little text."""
    size = F.length(normalized(F.col(text)))
    held = pages.select(doc, size.alias("chars")).join(vectors.select(doc, unit(doubles(F.col(vec))).alias("u")), doc, "left").join(paradigm.select("paradigm", "threshold"), F.lit(True))
    ok = (F.col("chars") >= min_chars) & F.col("u").isNotNull()
    score = F.when(ok, unit_score(F.col("u"), F.col("paradigm")))
    return held.select(doc, "chars", F.when(ok, "ok").otherwise("insufficient_text").alias("status"), percent(score).alias("similarity_pct"), passes(score, F.col("threshold")).alias("pass_threshold"))


def summary(results: DataFrame) -> DataFrame:
    hits = F.count_if("pass_threshold")
    return results.agg(F.count("*").alias("total_files"), hits.alias("found_count"), F.round(F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)), 6).alias("found_ratio"))
