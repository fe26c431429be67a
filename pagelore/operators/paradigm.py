"""Prototype vectors ("paradigms") of document classes, their cutoffs and validation. All classes in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions.scores import percent, status_from_ratio
from pagelore.functions.text import MIN_CHARS, TOKEN, normalized, tokens
from pagelore.functions.vectors import doubles, mean_vectors, norm, unit, unit_score
from pagelore.operators.quantiles import exact_quantiles
from pagelore.sources.store import stored

MIN_DIM = 8


def hash_encoder(df: DataFrame, doc: str, text: str, dim: int = 64) -> DataFrame:
    """(doc, any other columns, vec): the stand-in encoder, counts of hashed tokens at length 1. Replace it by any job of
    that shape. Texts without a token are left out. Counts are made where a row lies."""
    ids = [c for c in df.columns if c != text]
    digits = (7, 2) if 256 % dim == 0 else (1, 8)  # of the first eight, those that the remainder depends on
    place = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), *digits), 16, 10).cast("bigint") % dim
    every = F.sequence(F.lit(0), F.lit(dim)).cast("array<bigint>")
    # each place once more, so that in order the places' first positions tell their counts
    order = F.sort_array(F.concat(F.transform(tokens(F.col(text)), place), every))
    counts = F.transform(F.array(order), lambda o: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.array_position(o, i.cast("bigint") + 1) - F.array_position(o, i.cast("bigint")) - 1).cast("double")))[0]
    return df.where(F.lower(F.col(text)).rlike(TOKEN)).select(*ids, unit(counts).alias("vec"))


def embed_covers(docs: DataFrame, doc: str, text: str, encoder: Callable[[DataFrame, str, str], DataFrame] = hash_encoder, min_chars: int = MIN_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, *carry, vec) of covers of enough text; short ones are left out before the encoder runs."""
    held = docs.select(doc, *carry, normalized(F.col(text)).alias(text)).where(F.length(text) >= min_chars)
    return encoder(held, doc, text)


def paradigms(vectors: DataFrame, tag: str, vec: str) -> DataFrame:
    """(tag, paradigm): the unit vector of the mean of unit vectors. Raises on vectors that cancel out."""
    units = vectors.select(tag, unit(doubles(F.col(vec))).alias("u"))
    means = mean_vectors(units, tag, "u", "m")
    checked = F.when(norm(F.col("m")) > 0, unit(F.col("m"))).otherwise(F.raise_error(F.lit("the paradigm has zero norm")))
    return means.select(tag, checked.alias("paradigm"))


def self_scores(vectors: DataFrame, tag: str, vec: str, carry: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """Every member's cosine with its own paradigm (of ``known``, if they are there already), within [-1, 1]. Paradigms are
    one row a tag: Spark picks the join by their measured size."""
    held = vectors.select(tag, *carry, unit(doubles(F.col(vec))).alias("u")).join(paradigms(vectors, tag, vec) if known is None else known.select(tag, "paradigm"), tag)
    return held.select(tag, *carry, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), unit_score(F.col("u"), F.col("paradigm")))).alias("score"))


def cutoffs(scores: DataFrame, tag: str, score: str = "score", method: str = "p05", sigma: float = 2.0, least: int = 2, more: tuple[float, ...] = ()) -> DataFrame:
    """(tag, n, threshold, q) of the tags with at least ``least`` members: the exact 5th percentile, or the mean less
    ``sigma`` population deviations for any other method name; q has the quantiles that ``more`` names."""
    exact = exact_quantiles(scores, tag, score, (0.05, *more)) if method == "p05" or more else None
    if method == "p05":
        return exact.where(F.col("n") >= least).select(tag, "n", F.col("q")[0].alias("threshold"), F.slice("q", 2, len(more)).alias("q"))
    sizes = scores.groupBy(tag).agg(F.count("*").alias("n"), (F.avg(score) - sigma * F.stddev_pop(score)).alias("threshold")).where(F.col("n") >= least)
    if not more:
        return sizes.select(tag, "n", "threshold", F.array().cast("array<double>").alias("q"))
    return sizes.join(exact.select(tag, F.slice("q", 2, len(more)).alias("q")), tag)


def thresholds(scores: DataFrame, tag: str, method: str = "p05", sigma: float = 2.0, least: int = 2) -> DataFrame:
    """(tag, n, threshold) of the tags with at least ``least`` members."""
    return cutoffs(scores, tag, "score", method, sigma, least).drop("q")


def report(scores: DataFrame, tag: str, method: str = "p05", sigma: float = 2.0) -> DataFrame:
    """Per tag: members, valid and invalid ones, ratio and its status, and the spread of scores in percent. Scores are worked
    out once and stored, so those that are judged are those that made the cutoff."""
    scores = stored(scores.select(tag, "score"))
    held = scores.join(cutoffs(scores, tag, "score", method, sigma, more=(0.1, 0.5, 0.9)), tag)
    out = held.groupBy(tag).agg(F.count("*").alias("total"), F.count_if(F.col("score") >= F.col("threshold")).alias("valid"), F.first("threshold").alias("threshold"), F.min("score").alias("lo"), F.first("q").alias("q"), F.avg("score").alias("mean"), F.max("score").alias("hi"))
    ratio = F.col("valid") / F.col("total")
    return out.select(
        tag, "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), F.round(ratio, 6).alias("valid_ratio"), status_from_ratio(ratio).alias("status"), F.round("threshold", 6).alias("threshold"),
        percent(F.col("lo")).alias("min_pct"), percent(F.col("q")[0]).alias("p10_pct"), percent(F.col("q")[1]).alias("median_pct"), percent(F.col("mean")).alias("mean_pct"), percent(F.col("q")[2]).alias("p90_pct"), percent(F.col("hi")).alias("max_pct"),
    )


def worst(scores: DataFrame, by: str, most: int = 20) -> DataFrame:
    """The rows of least score, a top-k report."""
    return scores.orderBy(F.col("score").asc(), F.col(by).asc()).limit(most)
