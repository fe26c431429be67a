"""Queries that run whole jobs: they write their files to a folder of their own and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import features, text
from pagelore.functions.vectors import dot, doubles, mean_vectors
from pagelore.operators import jobs, supervised
from pagelore.operators.catalog import Catalog
from pagelore.plans.pages import PAGES_SQL, page_rows
from pagelore.plans.registry import query, table
from pagelore.plans.vectors import _CUTOFF, _LINEAR, _PARADIGM, _REPORT
from pagelore.sources import files, pages
from pagelore.sources.store import scratch


@query(
    "embeddings_store",
    "select vec_id item, case when vec_id % 7 = 0 then printf('item_%06d', vec_id) else 'v' || vec_id || '.pdf' end file, len(embedding)::int dim, round(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 6) square, (select count(*) from embeddings) n from embeddings",
)
def embeddings_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, held = scratch(spark, "embeddings"), table(spark, sf_dir, "embeddings")
    named = held.select(F.col("vec_id").alias("item"), F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("v"), F.col("vec_id"), F.lit(".pdf"))).alias("file"), "embedding")
    jobs.write_embeddings(named, path, {"model_name": "hash64", "source_dir": sf_dir})
    back, meta = jobs.read_embeddings(spark, path)
    return back.select("item", "file", F.size("embedding").alias("dim"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("square"), F.lit(meta["count"]).alias("n"))


@query("catalog_build", f"with {_PARADIGM}, {_REPORT}")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the build job."""
    return jobs.build_catalog(Catalog(spark, scratch(spark, "catalog")), table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(
    "catalog_entries",
    f"with {_PARADIGM}, {_CUTOFF} select label::varchar tag, case when label % 2 = 0 then 'other' else 'hash64' end model, 0 page_index, round(t, 6) threshold, 'p05' \"method\", len(p)::int dim, case when label % 2 = 0 then 1 else 0 end update_count, case when label % 2 = 0 then 2 else 1 end events from p join t using (label)",
)
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags built, the even ones once more as an authorized update; read back from the catalog with their histories."""
    catalog, held = Catalog(spark, scratch(spark, "catalog")), table(spark, sf_dir, "embeddings")
    jobs.build_catalog(catalog, held, "label", "embedding", model="  ")
    jobs.build_catalog(catalog, held.where("label % 2 = 0"), "label", "embedding", model="other", update=True)
    seen = catalog.history().groupBy("tag").agg(F.count("*").cast("int").alias("events"))
    return jobs.read_paradigms(catalog).join(seen, "tag").select("tag", "model", "page_index", F.round("threshold", 6).alias("threshold"), "method", F.size("paradigm").alias("dim"), "update_count", "events")


_READY = """u as (select l.doc_id, quality, source, length(trim(regexp_replace(coalesce(text, ''), '[[:space:]]+', ' ', 'g'))) size from labels l join documents using (doc_id)),
r as (select *, row_number() over (partition by quality order by sha1('42:' || doc_id), doc_id) k from u where size >= 20), n as (select min(c) n from (select count(*) c from r group by quality)),
s as (select *, case when k <= floor(n * 0.8) then 'train' when k <= floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end split,
 k - case when k <= floor(n * 0.8) then 0 when k <= floor(n * 0.8) + floor(n * 0.1) then floor(n * 0.8) else floor(n * 0.8) + floor(n * 0.1) end number from r, n where k <= n)"""


def _prepared(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return jobs.prepare_dataset(held, path, "doc_id", "quality", "text", "source")


@query("dataset_summary", f"with {_READY} select split, quality, count(*) n from s group by all union all select 'skipped', quality, count(*) from u where size < 20 group by quality")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, scratch(spark, "dataset"))


@query("dataset_manifest", f"with {_READY} select quality::varchar \"label\", split, source src_name, source || '/' || doc_id src_abs, printf('%05d_%s_%s', number::int, substr(sha1(source || '/' || doc_id), 1, 10), doc_id::varchar) dst_name from s")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as it is read back from the dataset's folder."""
    path = scratch(spark, "dataset")
    _prepared(spark, sf_dir, path)
    return jobs.read_manifest(spark, path).select("label", "split", "src_name", "src_abs", "dst_name")


@query("stored_classifier", f"with {_LINEAR} select vec_id, label, label_id::int label_id, 10 classes, 64 embedding_dim from pr")
def stored_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by weights that were saved and read back."""
    path, held = scratch(spark, "classifier"), table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("x"))
    jobs.save_classifier(supervised.centroid_weights(held, "label", mean_vectors(held, "label", "x")), path, {"embedding_model": "hash64", "page_index": "0"})
    weights, meta = jobs.load_classifier(spark, path)
    out = supervised.predicted(held, weights, "vec_id", "x", "label")
    return out.select("vec_id", "label", "label_id", F.lit(int(meta["classes"])).alias("classes"), F.lit(int(meta["embedding_dim"])).alias("embedding_dim"))


@query("features_file", f"with {PAGES_SQL} select doc_id::varchar file, 0 page_index, chars, token_count, round(fill_percent, 6) fill_percent, spaces, whitespace, non_whitespace, line_count, empty_lines, (case when lang = source then 1 else 2 end)::double font_count, round((500 + doc_id % 100) * 25.4 / 72, 4) width_mm, round(842 * 25.4 / 72, 4) height_mm from f")
def features_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features file as written and read back, with the layout features of pages of several widths."""
    layout = features.layout_features(F.array("lang", "source"), (F.lit(500.0) + F.col("doc_id") % 100), F.lit(842.0))
    rows = page_rows(spark, sf_dir).withColumns(layout).withColumns({"source_dir": F.lit("documents"), "file": F.col("doc_id").cast("string"), "page_index": F.lit(0)})
    path = scratch(spark, "features")
    files.write_features(rows, path)
    return files.features(spark, path).drop("source_dir").withColumns({c: F.round(c, 4) for c in ("width_mm", "height_mm")})


@query("row_texts", "select l.doc_id, case when l.doc_id % 9 = 0 then 'missing' when d.text is null then 'unreadable' else 'ok' end found, case when l.doc_id % 9 = 0 then 0 else coalesce(length(d.text), 0) end chars from labels l left join documents d using (doc_id)")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of catalog rows by their paths, some of which are not there."""
    path = F.concat(F.lit("docs/"), F.col("doc_id")).alias("path")
    texts = table(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select(path, "text")
    held = jobs.row_texts(table(spark, sf_dir, "labels").select("doc_id", path), texts, "path", "text")
    return held.select("doc_id", "found", F.length("text").alias("chars"))


_JSON = "case when json_valid(props) then props end"


@query(
    "update_requests",
    f"""with r as (select event_id, event_type, value, nullif(trim(json_extract_string({_JSON}, '$.k')), '') k, nullif(trim(json_extract_string({_JSON}, '$.page')), '') page from events)
select event_id, case when event_id % 3 = 0 then 'create' when value >= 50 then 'update' else 'refused' end action, coalesce(k, page) signature, coalesce(k, 'hash64') model, event_type catalog_tag_of from r""",
)
def update_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What update requests do, by what is there and authorized, and the signature and model that they fall back on."""
    held = table(spark, sf_dir, "events").withColumn("j", files.lenient_json(F.col("props"), "k string, page string, _corrupt_record string"))
    held = held.withColumn("j", F.when(F.col("j._corrupt_record").isNull(), F.col("j")))
    action = jobs.update_action(F.col("event_id") % 3 != 0, F.col("value") >= 50)
    sign = jobs.signature({"page_signature": F.col("j.page"), "catalog_signature": F.col("j.k")})
    return held.select("event_id", action.alias("action"), sign.alias("signature"), jobs.model_name(F.col("j.k"), F.lit("")).alias("model"), F.col("event_type").alias("catalog_tag_of"))


@query("name_forms", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') utc, strftime(ts, '%Y%m%d_%H%M%S') compact, printf('%05d__%s__cover_p%04d.pdf', event_id::int, event_type, (event_id % 50 + 1)::int) preview from events")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events")
    return held.select("event_id", text.utc_iso(F.col("ts"), zoned=False).alias("utc"), text.compact_time(F.col("ts")).alias("compact"), text.preview_name(F.col("event_id"), F.col("event_type"), F.col("event_id") % 50).alias("preview"))


@query("feature_maps", f"with {PAGES_SQL} select doc_id, 'docs' catalog_tag, 'catalog/docs.json' catalog_path, chars, line_count, 8 fields from f where chars > 0")
def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the pages that have any, by name, annotated with where they belong."""
    held = page_rows(spark, sf_dir).where("chars > 0").select("doc_id", jobs.feature_map(features.TEXT_FIELDS).alias("m"))
    return jobs.annotated(held.select("doc_id", F.col("m")["chars"].alias("chars"), F.col("m")["line_count"].alias("line_count"), F.size("m").alias("fields")), "docs", "catalog/docs.json")


@query("job_payload", "with q as (select lang, count(*) n from documents group by lang) select 'count' job, '{\"source\":\"documents\",\"rows\":[' || string_agg('{\"lang\":\"' || lang || '\",\"n\":' || n || '}', ',' order by lang) || ']}' payload from q")
def job_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return jobs.payload("count", counts, source="documents")


@query(
    "document_pages",
    """with n as (select count(*) // 1000 + 16 n from conversations), p as (select conv_id % n g, conv_id, turn, text, row_number() over (partition by conv_id % n order by conv_id, turn, text) - 1 page_index from conversations, n)
select g::int document, page_index::int page_index, 'ok' status, coalesce(length(text), 0)::int chars from p""",
)
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns written as pages of document files, and read back through the data source."""
    held = table(spark, sf_dir, "conversations")
    count = held.count() // 1000 + 16
    path = scratch(spark, "pages")
    pages.write_page_files(held.withColumn("g", F.pmod("conv_id", F.lit(count))), path, "g", ["conv_id", "turn", "text"], "text", min(count, 200))
    back = pages.pages(spark, path, recursive=True, pattern="*.txt")
    return back.select(F.regexp_extract("path", "of=([0-9]+)", 1).cast("int").alias("document"), "page_index", "status", F.length("text").alias("chars"))
