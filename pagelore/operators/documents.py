"""Search of whole documents: every page against a family catalog and its reference texts, hits, entries and a verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.scores import confidence_rank, family_confidence, normalized_score, positive
from pagelore.functions.text import MIN_COMPARED, excerpt, normalized
from pagelore.functions.vectors import distance
from pagelore.operators.families import batch_summary

#: How a page's family was chosen, and why its text wasn't compared.
BY_TEXT, BY_DISTANCE = "text_rerank_then_distance", "distance_only"
REFERENCES = "array<struct<rank:int,doc:string,distance:double,excerpt:string>>"


def with_examples(catalog: DataFrame, members: DataFrame, page: str, family: str, doc: str, text: str, most: int = 5) -> DataFrame:
    """``catalog`` (page, families as ``families.page_catalog`` makes them) with the ``most`` closest members of each family
    (page, family, doc, text, distance) as its reference examples: a bounded list, first by distance and doc."""
    rank = F.row_number().over(Window.partitionBy(page, family).orderBy("distance", doc))
    few = members.withColumn("rank", rank).where(F.col("rank") <= most)  # Spark cuts to ``most`` a task before the shuffle
    lists = few.groupBy(page, family).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(doc).cast("string").alias("doc"), "distance", excerpt(F.col(text)).alias("excerpt")))).cast(REFERENCES).alias("examples"))
    held = catalog.join(lists.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct(family, "examples"))).alias("of")), page, "left")
    each = F.transform("families", lambda c: c.withField("examples", F.coalesce(F.element_at("of", c["family"]), F.array().cast(REFERENCES))))
    return held.withColumn("families", each).drop("of")


def metadata(name: str, family: Column, registry: Column | None) -> Column:
    """A fact of a family: its own, or where it has none the registry's."""
    if registry is None:
        return family[name]
    return F.coalesce(family[name], F.get(F.filter(registry, lambda r: r["family"] == family["family"]), 0)[name])


def searched(pages: DataFrame, catalog: DataFrame, page: str, text: str, fields: tuple[str, ...], scorer: Callable[[Column, Column], Column], encode: Callable[[Column], Column] = lambda c: c, compare: bool = True, catalog_page: int = 0) -> DataFrame:
    """``pages`` with status, strategy, family, distance, confidence, text_status, text_score and text_ref.

    All pages are scored by the families of the catalog's page ``catalog_page``, a row of a few families with a few examples
    each, so it is sent to the pages and nothing is shuffled. Where a page's text can be compared with any example, the
    family of the best text score wins, then the nearest; else the nearest one. dist_mean, dist_max and examples are the
    family's own or, where it has none, those of the catalog's ``registry``, if it has that column. A page without its
    features is "no_features" and has no family. text_status is ok, disabled, unavailable_short_text, unavailable_no_reference
    or error, where no score is a finite number. An empty catalog leaves all pages "uncatalogued".
    """
    listed = F.col("registry") if "registry" in catalog.columns else None

    def known(c: Column) -> Column:
        """The family's examples that can be compared, encoded here once and not for every page."""
        long = F.filter(F.coalesce(metadata("examples", c, listed), F.array().cast(REFERENCES)), lambda e: F.length(normalized(e["excerpt"])) >= MIN_COMPARED)
        return F.transform(long, lambda e: F.struct((-e["rank"]).alias("order"), e["doc"].alias("doc"), encode(e["excerpt"]).alias("b")))

    def facts(c: Column) -> Column:
        own = [c["family"].alias("family"), c["centroid"].alias("centroid"), *(metadata(f, c, listed).alias(f) for f in ("dist_mean", "dist_max"))]
        return F.struct(*own, *([known(c).alias("known")] if compare else []))

    one = catalog.where(F.col(page) == catalog_page).select(F.struct("mean", "std", F.transform("families", facts).alias("families")).alias("model_of_page")).limit(1)
    names = pages.columns
    held = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).join(F.broadcast(one), F.lit(True), "left")
    value = lambda f: F.col("row").getField(f).cast("double")
    model = F.col("model_of_page")
    missing = F.exists(F.array(*(value(f) for f in fields)), lambda x: x.isNull())
    status = F.when(model.isNull(), "uncatalogued").when(missing, "no_features").otherwise("ok")
    z = F.array(*((value(f) - model["mean"][i]) / model["std"][i] for i, f in enumerate(fields)))
    body = F.col("row").getField(text)
    long = F.length(normalized(body)) >= MIN_COMPARED
    held = held.select("row", "model_of_page", status.alias("status"), z.alias("z"), long.alias("long"), F.when(long & F.lit(compare), encode(body)).alias("a"))

    # inside a lambda Spark works an expression out at each place that names it, so what is named twice is bound to a lambda
    def bound(value: Column, of: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), of)[0]

    def told(c: Column, p: Column) -> Column:
        own = [distance(p["z"], c["centroid"]).alias("distance"), *(c[f].alias(f) for f in ("family", "dist_mean", "dist_max"))]
        if not compare:
            return F.struct(*own, F.lit(None).cast("double").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("compared"))
        raw = F.transform(c["known"], lambda e: F.struct(scorer(p["a"], e["b"]).alias("raw"), e["order"].alias("order"), e["doc"].alias("doc")))
        scores = F.when(p["long"], F.transform(raw, lambda s: F.struct(normalized_score(s["raw"]).alias("score"), s["order"].alias("order"), s["doc"].alias("doc"))))
        best = lambda s: F.struct(F.array_max(F.filter(s, lambda x: x["score"].isNotNull())).alias("best"), F.coalesce(F.size(s), F.lit(0)).alias("compared"))
        return bound(bound(scores, best), lambda s: F.struct(*own, s["best"]["score"].alias("text"), s["best"]["doc"].alias("ref"), s["compared"].alias("compared")))

    each = bound(F.struct("z", "a", "long"), lambda p: F.transform(model["families"], lambda c: told(c, p)))
    held = held.withColumn("each", F.when(F.col("status") == "ok", each))
    by_text = F.exists("each", lambda c: c["text"].isNotNull())
    order = F.transform("each", lambda c: F.struct((-F.when(by_text, F.coalesce(c["text"], F.lit(-1.0))).otherwise(0.0)).alias("key"), c["distance"].alias("distance"), c["family"].alias("family"), c.alias("c")))
    held = held.withColumn("best", F.get(F.array_sort(order), 0)).withColumn("by_text", by_text)
    best = F.col("best")["c"]
    compared = F.exists("each", lambda c: c["compared"] > 0)
    why = F.when(F.lit(not compare), "disabled").when(~F.col("long"), "unavailable_short_text").when(~compared, "unavailable_no_reference").when(~F.col("by_text"), "error").otherwise("ok")
    return held.select(
        *(F.col("row").getField(c).alias(c) for c in names), "status", F.when(F.col("status") == "ok", F.when(F.col("by_text"), BY_TEXT).otherwise(BY_DISTANCE)).alias("strategy"), best["family"].alias("family"), best["distance"].alias("distance"),
        F.when(F.col("status") == "ok", family_confidence(best["distance"], best["dist_mean"], best["dist_max"])).alias("confidence"), F.when(F.col("status") == "ok", why).alias("text_status"), best["text"].alias("text_score"), best["ref"].alias("text_ref"),
    )


def verdicts(found: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, status, pages_total, pages_scanned, page_errors, hit_pages, entry_pages, best_page, best_family, best_confidence,
    best_distance, best_text_score, strategy) of searched pages, a row a document.

    status is detected, not_detected or, where no page could be scored, no_usable_pages. The best page is sought among the
    first pages of runs of hits, if there is one: that with a text score, the highest one, the highest confidence, the least
    distance, and the first of equals.
    """
    ok, good = F.col("status") == "ok", positive(F.coalesce("confidence", F.lit("")))
    before = F.lag(page).over(Window.partitionBy(doc).orderBy(page))
    entry = found.where(good).select(doc, page, (before.isNull() | (before != F.col(page) - 1)).cast("int").alias("entry"))
    held = found.join(entry.where("entry = 1").dropDuplicates([doc, page]), [doc, page], "left")
    score = F.col("text_score")
    key = F.struct(F.coalesce("entry", F.lit(0)), score.isNotNull().cast("int"), F.coalesce(score, F.lit(-1.0)), confidence_rank(F.col("confidence")), -F.coalesce("distance", F.lit(float("inf"))), -F.col(page))
    best = F.max_by(F.struct(page, "family", "confidence", "distance", "text_score", "strategy"), F.when(ok, key)).alias("b")
    out = held.groupBy(doc).agg(F.count("*").alias("pages_total"), F.count_if(ok).alias("pages_scanned"), F.count_if(good).alias("hit_pages"), F.count("entry").alias("entry_pages"), best)
    status = F.when(F.col("pages_scanned") == 0, "no_usable_pages").when(F.col("hit_pages") > 0, "detected").otherwise("not_detected")
    return out.select(
        doc, status.alias("status"), "pages_total", "pages_scanned", (F.col("pages_total") - F.col("pages_scanned")).alias("page_errors"), "hit_pages", "entry_pages", F.col(f"b.{page}").alias("best_page"),
        F.col("b.family").alias("best_family"), F.col("b.confidence").alias("best_confidence"), F.col("b.distance").alias("best_distance"), F.col("b.text_score").alias("best_text_score"), "b.strategy",
    )


def write_search(found: DataFrame, doc: str, page: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the searched pages, the verdicts made of what was written, and their summary under ``path``; returns all three
    as read back. Pages are Parquet, the other two lines of JSON."""
    spark: SparkSession = found.sparkSession
    found.write.mode("errorifexists").parquet(f"{path}/pages")
    back = spark.read.parquet(f"{path}/pages")
    told = verdicts(back, doc, page)
    told.write.mode("errorifexists").json(f"{path}/documents", ignoreNullFields=False)
    documents = spark.read.schema(told.schema).json(f"{path}/documents")
    counts = batch_summary(documents)
    counts.write.mode("errorifexists").json(f"{path}/summary")
    return back, documents, spark.read.schema(counts.schema).json(f"{path}/summary")
