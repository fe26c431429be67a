"""Families of pages: nearest centroid, confidence, text re-rank, block entries, document verdicts, k-means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.scores import confidence_rank, family_confidence, feature_similarity, positive
from pagelore.functions.text import BEST_EXCERPT, MIN_COMPARED, normalized
from pagelore.functions.vectors import distance
from pagelore.operators.block_scores import BlockScorer, between


def fitted(pages: DataFrame, family: str, fields: tuple[str, ...]) -> DataFrame:
    """One row (mean, std, families): each field's mean and population deviation over all rows, the latter taken as 1 where
    it is below 1e-9, and each family's name, size and centroid in z-scores.

    One aggregation by family gives all of it; what is put together in one row is a row a family.
    """
    per = pages.groupBy(family).agg(F.count("*").cast("double").alias("n"), F.array(*(F.avg(f) for f in fields)).alias("mean"), F.array(*(F.var_pop(f) for f in fields)).alias("var"))
    rows = per.agg(F.array_sort(F.collect_list(F.struct(F.col(family).alias("family"), "n", "mean", "var"))).alias("all"))

    def total(of) -> Column:
        return F.aggregate("all", F.lit(0.0), lambda t, x: t + x["n"] * of(x))

    size = total(lambda x: F.lit(1.0))
    rows = rows.select("all", F.array(*(total(lambda x, i=i: x["mean"][i]) / size for i in range(len(fields)))).alias("mean"))
    spread = [F.sqrt(total(lambda x, i=i: x["var"][i] + F.pow(x["mean"][i] - F.col("mean")[i], F.lit(2))) / size) for i in range(len(fields))]
    rows = rows.select("all", "mean", F.array(*(F.when(s < 1e-9, 1.0).otherwise(s) for s in spread)).alias("std"))
    centroid = lambda x: F.array(*((x["mean"][i] - F.col("mean")[i]) / F.col("std")[i] for i in range(len(fields))))
    return rows.select("mean", "std", F.transform("all", lambda x: F.struct(x["family"].alias("family"), x["n"].cast("long").alias("members"), centroid(x).alias("centroid"))).alias("families"))


def measured(pages: DataFrame, model: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``pages`` with ``z``, their z-scores, and ``near``: (distance, family, centroid) of every family, the nearest first.

    The model is one row, so each page is measured where it lies. Extra columns stay but for those of these names.
    """
    held = pages.drop("z", "near", "model").crossJoin(F.broadcast(model.select(F.struct("mean", "std", "families").alias("model"))))
    held = held.withColumn("z", F.array(*((F.col(f) - F.col("model.mean")[i]) / F.col("model.std")[i] for i, f in enumerate(fields))))
    each = F.transform("model.families", lambda c: F.struct(distance(F.col("z"), c["centroid"]).alias("distance"), c["family"].alias("family"), c["centroid"].alias("centroid")))
    return held.withColumn("near", F.array_sort(each)).drop("model")


def scores_by_family(near: Column) -> Column:
    """Distances in order of the family instead."""
    return F.array_sort(F.transform(near, lambda c: F.struct(c["family"].alias("family"), c["distance"].alias("distance"))))


def ranked(near: Column, text_scores: Column | None = None) -> Column:
    """Of measured pages: (rank, family, distance, text_score) of every family in the order that counts: by text score from
    the map ``text_scores`` (missing ones last) and distance, or by distance alone. Made where the page lies."""
    score = (lambda c: F.lit(None).cast("double")) if text_scores is None else (lambda c: F.element_at(text_scores, c["family"]).cast("double"))
    each = F.transform(near, lambda c: F.struct((-F.coalesce(score(c), F.lit(-1.0))).alias("down"), c["distance"].alias("distance"), c["family"].alias("family"), score(c).alias("text_score")))
    return F.transform(F.array_sort(each), lambda c, i: F.struct((i + 1).alias("rank"), c["family"].alias("family"), c["distance"].alias("distance"), c["text_score"].alias("text_score")))


def family_stats(members: DataFrame, family: str) -> DataFrame:
    """(family, members, dist_min, dist_mean, dist_max) of assigned pages."""
    return members.groupBy(family).agg(F.count("*").alias("members"), F.min("distance").alias("dist_min"), F.avg("distance").alias("dist_mean"), F.max("distance").alias("dist_max"))


def with_confidence(assigned: DataFrame, stats: DataFrame, family: str) -> DataFrame:
    """Adds the confidence of each assignment; families without statistics are unknown."""
    held = assigned.join(stats.select(family, "dist_mean", "dist_max"), family, "left")
    return held.withColumn("confidence", family_confidence(F.col("distance"), F.col("dist_mean"), F.col("dist_max"))).drop("dist_mean", "dist_max")


def similarities(fields: tuple[str, ...]) -> list[Column]:
    """Of measured pages: each feature's similarity in percent to the nearest family's centroid, and their mean."""
    each = [feature_similarity(F.col("z")[i] - F.col("near")[0]["centroid"][i]) for i in range(len(fields))]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return [*(e.alias(f"{f}_pct") for f, e in zip(fields, each, strict=True)), (F.floor((F.round(total * 100) * 2 + len(fields)) / (2 * len(fields))) / 100).alias("mean_pct")]  # halves go up


def merged_examples(*lists: Column, most: int = 5) -> Column:
    """The first ``most`` distinct examples of several lists, in order; a null list is empty."""
    return F.slice(F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))), 1, most)


def page_scores(pages: DataFrame, catalog: DataFrame, page: str, fields: tuple[str, ...]) -> DataFrame:
    """``pages`` with status, family, distance, confidence and scores by the model of their page number.

    ``catalog`` has a row a page number (page, mean, std, families with centroid, dist_mean and dist_max); of pages that it
    doesn't have the status is "uncatalogued" and the rest null; a page without its features is "no_features". The catalog
    is sent to the pages: page numbers are few and common, so a shuffle by them would put most pages in one task.
    """
    held = pages.join(F.broadcast(catalog.select(page, F.struct("mean", "std", "families").alias("model"))), page, "left")
    z = F.array(*((F.col(f) - F.col("model.mean")[i]) / F.col("model.std")[i] for i, f in enumerate(fields)))
    each = F.transform("model.families", lambda c: F.struct(distance(F.col("z"), c["centroid"]).alias("distance"), c["family"].alias("family"), c["dist_mean"].alias("dist_mean"), c["dist_max"].alias("dist_max")))
    missing = F.exists(F.array(*fields), lambda x: x.isNull())
    status = F.when(F.col("model").isNull(), "uncatalogued").when(missing, "no_features").otherwise("ok")
    held = held.withColumn("status", status).withColumn("z", z).withColumn("near", F.when(F.col("status") == "ok", F.array_sort(each)))
    best = F.col("near")[0]
    sure = F.when(F.col("status") == "ok", family_confidence(best["distance"], best["dist_mean"], best["dist_max"]))
    return held.withColumns({"family": best["family"], "distance": best["distance"], "confidence": sure, "scores": scores_by_family(F.col("near"))}).drop("model", "z", "near")


def page_catalog(pages: DataFrame, page: str, family: str, fields: tuple[str, ...]) -> DataFrame:
    """The catalog that ``page_scores`` reads: for each page number the statistics of its fields, and each family's
    centroid with the least, mean and greatest distance of its members. What a row of it is made of is sent to the pages."""
    stats = pages.groupBy(page).agg(F.array(*(F.avg(f) for f in fields)).alias("mean"), F.array(*(F.when(F.stddev_pop(f) < 1e-9, 1.0).otherwise(F.stddev_pop(f)) for f in fields)).alias("std"))
    z = pages.join(F.broadcast(stats), page).withColumn("z", F.array(*((F.col(f) - F.col("mean")[i]) / F.col("std")[i] for i, f in enumerate(fields))))
    cents = z.groupBy(page, family).agg(F.array(*(F.avg(F.col("z")[i]) for i in range(len(fields)))).alias("centroid"))
    apart = z.join(F.broadcast(cents), [page, family]).groupBy(page, family).agg(F.first("centroid").alias("centroid"), F.count("*").alias("members"), *(f(distance(F.col("z"), F.col("centroid"))).alias(n) for f, n in ((F.min, "dist_min"), (F.avg, "dist_mean"), (F.max, "dist_max"))))
    families = apart.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(family).alias("family"), "centroid", "members", "dist_min", "dist_mean", "dist_max"))).alias("families"))
    return stats.join(families, page)


def examples(members: DataFrame, doc: str, family: str, most: int = 5) -> DataFrame:
    """The closest members of each family, a top-k report. Spark cuts to ``most`` a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(family).orderBy(F.col("distance").asc(), F.col(doc).asc()))
    return members.withColumn("rank", rank).where(F.col("rank") <= most).select(family, "rank", doc, "distance")


def reranked(pages: DataFrame, refs: DataFrame, doc: str, text: str, family: str, scorer: BlockScorer, encode: Callable[[Column], Column] = lambda c: c, compare: bool = True) -> DataFrame:
    """(doc, status, best, mean, best_ref, best_excerpt, candidates): a page's text against its family's reference texts.

    Texts of fewer than MIN_COMPARED characters aren't compared; scores that aren't finite are dropped. ``encode`` is what
    the scorer needs of a text, made once for each text. Pages and references meet in blocks, so no pair is a row. Status is
    ok, disabled (not ``compare``), unavailable_short_text, unavailable_no_reference, or error where no score is finite.
    """
    size = F.length(normalized(F.col(text)))
    short = F.coalesce(size, F.lit(0)) < MIN_COMPARED
    if not compare:
        none = (F.lit(None).cast(t).alias(n) for n, t in (("best", "double"), ("mean", "double"), ("best_ref", "long"), ("best_excerpt", "string")))
        return pages.select(doc, F.lit("disabled").alias("status"), *none, F.lit(0).cast("long").alias("candidates"))
    known = refs.where(F.length(normalized(F.col("ref_text"))) >= MIN_COMPARED)
    asked = pages.where(~short).select(doc, family, encode(F.col(text)).alias("a"))
    totals = between(asked, known.select(family, "ref_id", encode(F.col("ref_text")).alias("b")), family, doc, "a", "ref_id", "b", scorer)
    texts = known.select(F.col(family).alias("of"), F.col("ref_id").alias("ref"), F.substring(normalized(F.col("ref_text")), 1, BEST_EXCERPT).alias("best_excerpt"))
    agg = totals.join(texts, (F.col(family) == F.col("of")) & (F.col("best_item") == F.col("ref")), "left").select(family, F.col("i").alias(doc), "n", "sum", "best", "best_item", "best_excerpt")
    status = F.when(short, "unavailable_short_text").when(F.col("n").isNull(), "unavailable_no_reference").when(F.col("n") == 0, "error").otherwise("ok")
    mean = F.try_divide("sum", "n")
    return pages.join(agg, [doc, family], "left").select(doc, status.alias("status"), F.round("best", 6).alias("best"), F.round(mean, 6).alias("mean"), F.col("best_item").alias("best_ref"), "best_excerpt", F.coalesce("n", F.lit(0)).alias("candidates"))


def entries(hits: DataFrame, doc: str, page: str) -> DataFrame:
    """The first page of each run of consecutive hit pages: one whose previous hit isn't the page before."""
    last = F.lag(page).over(Window.partitionBy(doc).orderBy(page))
    return hits.withColumn("previous", last).where(F.col("previous").isNull() | (F.col("previous") != F.col(page) - 1)).drop("previous")


def verdicts(pages: DataFrame, doc: str, page: str, ai: str | None = None) -> DataFrame:
    """(doc, status, pages, hits, best_page, best_confidence, best_distance) from scored pages.

    The best page has a text score, the highest one, the highest confidence, the least distance, and comes first; if any
    page is a hit it is sought among the entries of hit runs.
    """
    good = positive(F.col("confidence"))
    at_start = entries(pages.where(good), doc, page).select(doc, page, F.lit(1).alias("entry"))
    held = pages.join(at_start, [doc, page], "left")
    score = F.col(ai) if ai else F.lit(None).cast("double")
    key = F.struct(F.coalesce("entry", F.lit(0)), score.isNotNull().cast("int"), F.coalesce(score, F.lit(-1.0)), confidence_rank(F.col("confidence")), -F.coalesce("distance", F.lit(float("inf"))), -F.col(page))
    out = held.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(good).alias("hits"), F.max_by(F.struct(page, "confidence", "distance"), key).alias("b"))
    return out.select(doc, F.when(F.col("hits") > 0, "detected").otherwise("not_detected").alias("status"), "pages", "hits", F.col(f"b.{page}").alias("best_page"), F.col("b.confidence").alias("best_confidence"), F.round("b.distance", 6).alias("best_distance"))


def batch_summary(results: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("status") == "detected")
    return results.agg(F.count("*").alias("total"), hit.alias("detected"), (F.count("*") - hit).alias("not_detected"), F.round(F.coalesce(F.try_divide(hit, F.count("*")), F.lit(0.0)), 6).alias("ratio"))
