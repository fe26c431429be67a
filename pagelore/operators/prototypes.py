"""Medoid and prototypes of a class from the scores of all pairs, and the blended score against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.scores import blended, normalized_score, status_from_ratio
from pagelore.functions.vectors import dot, mean_vectors
from pagelore.operators.paradigm import cutoffs
from pagelore.sources.store import stored

Scorer = Callable[[Column, Column], Column]


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, held within [-1, 1]: a product just above 1 would fall to the logistic branch. Null of a null."""
    product = dot(a, b)
    return normalized_score(F.when(product.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product))))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats and nulls: the size of the union follows from that of the intersection, which is
    bound to a name, as in a lambda Spark works out each place that names it."""
    ratio = F.transform(F.array(F.size(F.array_intersect(b, a))), lambda n: F.try_divide(n, F.size(a) + F.size(b) - n))
    return F.coalesce(F.get(ratio, 0), F.lit(0.0))


def pair_scores(items: DataFrame, others: DataFrame, key: str, doc: str, feature: str, scorer: Scorer) -> DataFrame:
    """(key, i, j, score) of every ordered pair within a key, its own included; a null score counts as 0. For any scorer,
    so it is quadratic in a class if both sides are whole: for that see ``block_scores``, where no pair is a row, and
    ``mean_scores``, the linear way for dot products."""
    a = items.select(key, F.col(doc).alias("i"), F.col(feature).alias("a"))
    b = others.select(key, F.col(doc).alias("j"), F.col(feature).alias("b"))
    return a.join(b, key).select(key, "i", "j", F.coalesce(scorer(F.col("a"), F.col("b")), F.lit(0.0)).alias("score"))


def mean_from_pairs(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.where("i <> j").groupBy(key, "i").agg(F.avg("score").alias("mean"))


def mean_scores(items: DataFrame, key: str, doc: str, vec: str) -> DataFrame:
    """(key, i, mean): mean dot product with the others of its key, from the sum vector: (u.S - u.u) / (n - 1)."""
    sums = mean_vectors(items, key, vec, "m").join(items.groupBy(key).agg(F.count("*").alias("n")), key)
    held = items.join(sums, key)
    u = F.col(vec)
    return held.where("n > 1").select(key, F.col(doc).alias("i"), ((dot(u, F.col("m")) * F.col("n") - dot(u, u)) / (F.col("n") - 1)).alias("mean"))


def medoid(means: DataFrame, key: str) -> DataFrame:
    """(key, medoid): the item of the highest mean, first of equals. A grouped maximum, so hot keys are combined early."""
    best = F.max_by("i", F.struct("mean", -F.col("i")))
    return means.groupBy(key).agg(best.alias("medoid"), F.max("mean").alias("medoid_mean"))


def top_prototypes(items: DataFrame, medoids: DataFrame, key: str, doc: str, feature: str, scorer: Scorer, most: int = 8) -> DataFrame:
    """(key, rank, prototype, score): the items most like the medoid, itself included; a top-k report.

    Scores each item once, against the medoid of its key; Spark cuts to ``most`` a task before the shuffle.
    """
    middle = items.join(medoids.select(key, F.col("medoid").alias(doc)), [key, doc])
    near = pair_scores(middle, items, key, doc, feature, scorer)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("j").asc()))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", F.col("j").alias("prototype"), "score")


def prototype_scores(items: DataFrame, prototypes: DataFrame, key: str, doc: str, feature: str, scorer: Scorer) -> DataFrame:
    """(key, i, score_pct): the blend of the best and the mean score against the prototypes of the key, which are few."""
    few = items.join(prototypes.select(key, F.col("prototype").alias(doc)), [key, doc])
    held = pair_scores(items, few, key, doc, feature, scorer)
    return held.groupBy(key, "i").agg(F.max("score").alias("best"), F.avg("score").alias("mean")).select(key, "i", blended(F.col("best"), F.col("mean")).alias("score_pct"))


def token_report(scored: DataFrame, key: str, method: str = "p05", sigma: float = 2.0) -> DataFrame:
    """Per key: how many blended scores pass the cutoff, which is taken on the rounded percentages."""
    scored = stored(scored.select(key, "score_pct"))
    cut = cutoffs(scored, key, "score_pct", method, sigma, 3).select(key, F.col("threshold").alias("threshold_pct"))
    held = scored.join(cut, key)
    out = held.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("score_pct") >= F.col("threshold_pct")).alias("valid"), F.first("threshold_pct").alias("t"), F.avg("score_pct").alias("m"))
    ratio = F.col("valid") / F.col("total")
    return out.select(key, "total", "valid", F.round(ratio, 6).alias("valid_ratio"), status_from_ratio(ratio).alias("status"), F.round("t", 3).alias("threshold_pct"), F.round("m", 4).alias("mean_pct"))
