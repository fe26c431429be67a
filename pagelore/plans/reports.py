"""Queries over what jobs report: written reports read back, listings, counts, defaults and the catalog's history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import scores, text
from pagelore.functions.text import skip_reason
from pagelore.operators import families, jobs, reports, supervised
from pagelore.operators.catalog import Catalog
from pagelore.plans import vectors
from pagelore.plans.families import _NEAR, measured
from pagelore.plans.registry import query, table
from pagelore.plans.vectors import _CUTOFF, _FOUND, _LINEAR, _PARADIGM, _REPORT
from pagelore.sources import files
from pagelore.sources.reports import read_head, read_part
from pagelore.sources.store import scratch

_NORMAL = "trim(regexp_replace(coalesce(text, ''), '[[:space:]]+', ' ', 'g'))"


def _validated(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "validation")
    reports.write_validation(vectors.scores(spark, sf_dir), "label", "vec_id", path, {"source": "embeddings", "comparison_mode": "cover_vs_paradigm_only"})
    return path


@query(
    "validation_rows",
    f"""with {_PARADIGM}, {_CUTOFF}, j as (select label, vec_id, s, s >= t valid from s join t using (label))
select label, vec_id, round(s * 100, 4) similarity_pct, valid, row_number() over (partition by label order by s, vec_id) place, count(*) over () total_covers, count(*) filter (valid) over () valid_count, 'p05' threshold_method from j""",
)
def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a validation that was written, with the head's counts."""
    path = _validated(spark, sf_dir)
    head = read_head(spark, path)
    rows = read_part(spark, path, "rows", "label int, vec_id long, similarity_pct double, valid boolean, place long")
    return rows.select("*", *(F.lit(head[c]).cast("long").alias(c) for c in ("total_covers", "valid_count")), F.lit(head["threshold_method"]).alias("threshold_method"))


@query("validation_metrics", f"with {_PARADIGM}, {_REPORT}")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = ", ".join(f"{c}_pct double" for c in ("min", "p10", "median", "mean", "p90", "max"))
    return read_part(spark, _validated(spark, sf_dir), "metrics", f"label int, total long, valid long, invalid long, valid_ratio double, status string, threshold double, {pct}")


def _searched(spark: SparkSession, sf_dir: str) -> str:
    path, found = scratch(spark, "search"), vectors.search.find_docs(table(spark, sf_dir, "embeddings"), vectors.catalog(spark, sf_dir), "label", "vec_id", "embedding")
    reports.write_search(found, "label", "vec_id", path, {"source": "embeddings"})
    return path


@query("search_found", f"{_FOUND} select label, vec_id, round(s * 100, 4) similarity_pct, row_number() over (partition by label order by round(s * 100, 4) desc, vec_id) place from a where s >= t")
def search_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_part(spark, _searched(spark, sf_dir), "found", "label int, vec_id long, similarity_pct double, place long")


@query(
    "search_counts",
    f"{_FOUND}, h as (select count(*) all_files, count(*) filter (s >= t) all_found from a) select label, count(*) total_files, count(*) filter (s >= t) found_count, round(count(*) filter (s >= t) / count(*), 6) found_ratio, any_value(all_files) all_files, any_value(all_found) all_found from a, h group by label",
)
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of each tag from a written search, beside those of its head."""
    path = _searched(spark, sf_dir)
    head = read_head(spark, path)
    tags = read_part(spark, path, "tags", "label int, total_files long, found_count long, found_ratio double")
    return tags.select("*", F.lit(head["total_files"]).cast("long").alias("all_files"), F.lit(head["found_count"]).cast("long").alias("all_found"))


@query(
    "prediction_report",
    f"""with {_LINEAR}, b as (select vec_id, max(p) p, sum(p * (label + 1)) m from pb group by vec_id),
r as (select doc_id, case when length({_NORMAL}) < 40 then 'skipped_short_text' when pr.vec_id is null then 'no_vector' else 'ok' end status, pr.label, b.p from documents left join pr on pr.vec_id = doc_id left join b on b.vec_id = doc_id)
select doc_id, status, case when status = 'ok' then label::varchar end predicted_label, case when status = 'ok' then round(p * 100, 4) end confidence_pct, case when status = 'ok' then 10 end classes, count(*) over () total_files, count(*) filter (status = 'ok') over () predicted_count from r""",
)
def prediction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of documents, some of too little text and some without a vector, written and read back."""
    path = scratch(spark, "predictions")
    made = vectors.classified(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    rows = reports.prediction_rows(table(spark, sf_dir, "documents"), made, "doc_id", "text", "label")
    reports.write_predictions(rows, path, {"embedding_model": jobs.DEFAULT_MODEL, "page_index": "0"})
    head = read_head(spark, path)
    back = read_part(spark, path, "rows", "doc_id long, status string, predicted_label string, confidence_pct double, probs_pct map<string,double>")
    counts = [F.lit(head[c]).cast("long").alias(c) for c in ("total_files", "predicted_count")]
    return back.select("doc_id", "status", "predicted_label", "confidence_pct", F.when(F.col("probs_pct").isNotNull(), F.size("probs_pct")).alias("classes"), *counts)


@query("first_skips", f"with r as (select source, doc_id, length({_NORMAL}) n from documents) select source, doc_id, 'cover_text_too_short(' || n || '<400)' reason, row_number() over (partition by source order by doc_id)::int place from r where n < 400 qualify place <= 50")
def first_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 skipped documents of each source, with the reason."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", skip_reason(F.col("text"), 400).alias("reason")).where("reason is not null")
    return reports.first_of_each(rows, ("source",), "doc_id", 50)


@query("source_listing", "select lang, source, row_number() over (partition by lang order by source) place, count(*) as \"rows\" from documents where source is not null group by lang, source")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(table(spark, sf_dir, "documents"), "lang", "source")


@query("cover_counts", "select role, count(*) filter (turn = 0) kept, count(*) filter (turn is null or turn <> 0) dropped from conversations group by role")
def cover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages kept and others dropped, counted."""
    return reports.kept_counts(table(spark, sf_dir, "conversations"), F.col("turn") == 0, "role")


_PROPS = "case when json_valid(props) then json_extract_string(props, '$.k') end"


@query("default_values", f"select event_id, coalesce(nullif(floor(value / 10)::int, 0), 3000) max_chars, coalesce(nullif(-floor(value / 10), 0), 0.5) share, coalesce(nullif({_PROPS}, ''), 'hash64') model from events")
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read from rows, with defaults for null, zero (of either sign) and empty ones."""
    held = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    tenth = F.floor(F.col("value") / 10)
    return held.select(
        "event_id", scores.defaulted(tenth.cast("int"), F.lit(3000)).alias("max_chars"), scores.defaulted(-tenth.cast("double"), F.lit(0.5), 0.0).alias("share"), scores.defaulted(F.col("k"), F.lit(jobs.DEFAULT_MODEL), "").alias("model"),
    )


@query("time_forms", "select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') compact_utc, strftime(ts, '%Y-%m-%d %H:%M:%S') human from events")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.compact_utc(F.col("ts"), zoned=False).alias("compact_utc"), text.human_time(F.col("ts")).alias("human"))


@query(
    "resolved_paths",
    """with f as (select case doc_id % 3 when 0 then '/in/' || doc_id when 1 then source || '/' || doc_id else doc_id::varchar end p from documents where doc_id % 5 <> 0 union select doc_id::varchar p from documents where doc_id % 6 = 0),
r as (select l.doc_id, coalesce(source, '') source from labels l left join documents using (doc_id))
select doc_id, coalesce(a.p, b.p, c.p) resolved from r left join f a on a.p = '/in/' || doc_id left join f b on b.p = source || '/' || doc_id left join f c on c.p = doc_id::varchar""",
)
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a catalog and where their files are: by the whole path, the source's folder, or the name alone."""
    docs, name = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    here = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/in/"), name)).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/"), name)).otherwise(name)
    held = docs.where("doc_id % 5 <> 0").select(here.alias("path")).union(docs.where("doc_id % 6 = 0").select(name))
    rows = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("source").alias("source_dir")), "doc_id", "left")
    rows = rows.select("doc_id", F.concat(F.lit("/in/"), name).alias("path"), F.coalesce("source_dir", F.lit("")).alias("source_dir"), name.alias("file"))
    return files.resolved_path(held, rows, "doc_id").select("doc_id", "resolved")


@query("label_lookup", "select doc_id, quality, dense_rank() over (order by quality)::int - 1 label_id from labels where quality is not null")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    return supervised.checked_labels(held, "quality", supervised.label_ids(held, "quality")).select("doc_id", "quality", "label_id")


@query("evaluation_loss", "with b as (select value, (row_number() over (order by event_id) - 1) // 96 g from events), m as (select avg(value) m from b group by g) select round((select avg(m) from m), 6) batch_loss, round((select avg(value) from b), 6) mean_loss")
def evaluation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the means of batches of 96 by position, and the plain mean."""
    out = supervised.evaluation_loss(table(spark, sf_dir, "events"), "event_id", "value", 96)
    return out.select(F.round("batch_loss", 6).alias("batch_loss"), F.round("mean_loss", 6).alias("mean_loss"))


@query("catalog_changes", "with t as (select distinct label from embeddings) select 1 version, label::varchar tag, 'added' change, 'create' \"action\", 0 update_count from t union all select 2, label::varchar, 'changed', 'update', 1 from t where label % 2 = 0")
def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of two versions changed: the snapshots of before and after, the events and the counts of updates."""
    catalog, held = Catalog(spark, scratch(spark, "catalog")), table(spark, sf_dir, "embeddings")
    jobs.build_catalog(catalog, held, "label", "embedding")
    jobs.build_catalog(catalog, held.where("label % 2 = 0"), "label", "embedding", model="other", update=True)
    out = []
    for version in catalog.versions():
        events = catalog.events().select("tag", "action", "signature_after")
        made = catalog.snapshot(version).join(events, ["tag", "signature_after"]).join(catalog.entries(version).select("tag", "update_count"), "tag")
        out.append(made.select(F.lit(version).alias("version"), "tag", "change", "action", "update_count"))
    return out[0].unionByName(out[1])


@query(
    "family_ranks",
    f"""with {_NEAR}, e as (select doc_id, family, distance, case when (doc_id + ascii(family)) % 3 = 0 then (doc_id % 7) / 7.0::double end text_score from d)
select doc_id, family, round(distance, 6) distance, text_score, row_number() over (partition by doc_id order by coalesce(text_score, -1) desc, distance, family)::int rank from e""",
)
def family_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of each page by text score, missing ones last, then by distance."""
    score = lambda c: F.when((F.col("doc_id") + F.ascii(c["family"])) % 3 == 0, (F.col("doc_id") % 7) / F.lit(7.0))
    held = measured(spark, sf_dir).withColumn("texts", F.map_from_entries(F.transform("near", lambda c: F.struct(c["family"], score(c)))))
    out = held.select("doc_id", F.explode(families.ranked(F.col("near"), F.col("texts"))).alias("r")).select("doc_id", "r.*")
    return out.withColumn("distance", F.round("distance", 6))
