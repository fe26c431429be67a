"""Queries over texts, features and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import features, scores, text
from pagelore.operators import supervised
from pagelore.operators.catalog import manifest
from pagelore.operators.profiles import profile
from pagelore.plans.registry import quantile_sql, query, table
from pagelore.sources import files

_NORM = "trim(regexp_replace(coalesce(text, ''), '[[:space:]]+', ' ', 'g'))"
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-zÀ-ÿ]+')"
_LINES = "len(string_split(t, chr(10))) - (case when t = '' or t[-1] = chr(10) then 1 else 0 end)"
PAGES_SQL = f"""p as (select doc_id, lang, source, coalesce(text, '') t, length(coalesce(text, ''))::double chars, len({_TOKENS})::double token_count,
 (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::double spaces,
 (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[[:space:]]', '', 'g')))::double whitespace from documents),
f as (select doc_id, lang, source, chars, token_count, case when chars = 0 then 0 else (chars - whitespace) / chars end fill_percent, spaces, whitespace, chars - whitespace non_whitespace,
 ({_LINES})::double line_count, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) = '')) - (case when t = '' or t[-1] = chr(10) then 1 else 0 end)::double empty_lines from p)"""


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", *[c.alias(n) for n, c in features.page_features(F.col("text")).items()])


@query("text_normalize", f"select doc_id, {_NORM} text, substr({_NORM}, 1, 1800) excerpt, substr({_NORM}, 1, 3000) encoded from documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = text.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", held.alias("text"), text.excerpt(F.col("text")).alias("excerpt"), F.substring(held, 1, text.MAX_ENCODED).alias("encoded"))


_TAG = "nullif(trim(regexp_replace(regexp_replace(lower(trim({0})), '[^0-9a-zA-Z_-]+', '_', 'g'), '_+', '_', 'g'), '_'), '')"


@query(
    "tag_label_slug",
    f"""select page_id, {_TAG.format("url")} tag, case when regexp_matches(trim(url), '^[A-Za-z0-9._-]+$') then lower(trim(url)) end strict_tag,
 trim(regexp_replace(regexp_replace(lower(trim(url)), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_+', '_', 'g'), '_') label,
 coalesce(nullif(trim(regexp_replace(url, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), '_'), ''), 'arquivo') slug from pages""",
)
def tag_label_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.tag(url).alias("tag"), text.strict_tag(url).alias("strict_tag"), text.label(url).alias("label"), text.slug(url).alias("slug"))


@query("tokenize_stats", f"select doc_id, len({_TOKENS})::int n_tokens, len(list_distinct({_TOKENS}))::int n_distinct from documents")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(held).alias("n_tokens"), F.size(F.array_distinct(held)).alias("n_distinct"))


@query("page_features", f"with {PAGES_SQL} select doc_id, chars, token_count, round(fill_percent, 6) fill_percent, spaces, whitespace, non_whitespace, line_count, empty_lines from f")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rows(spark, sf_dir).drop("lang", "source").withColumn("fill_percent", F.round("fill_percent", 6))


_PROFILE = " union all ".join(f"select '{f}' field, round(min({f}), 4) \"min\", round({quantile_sql(f'list_sort(list({f}))', 0.5)}, 4) median, round(avg({f}), 4) mean, round(max({f}), 4) \"max\", round(case when stddev_pop({f}) < 1e-9 then 1 else stddev_pop({f}) end, 4) std from f" for f in features.TEXT_FIELDS)


@query("feature_profile", f"with {PAGES_SQL} {_PROFILE}")
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(page_rows(spark, sf_dir), features.TEXT_FIELDS).select("field", *[F.round(c, 4).alias(c) for c in ("min", "median", "mean", "max", "std")])


@query(
    "min_chars_status",
    f"""with n as (select lang, length({_NORM}) n from documents)
select lang, count(*) files_total, count(*) filter (n >= 40) embedded, count(*) filter (n < 40) skipped, min(case when n < 40 then 'cover_text_too_short(' || n || '<40)' end) first_reason from n group by lang""",
)
def min_chars_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("lang", text.row_status(F.col("text")).alias("status"), text.skip_reason(F.col("text")).alias("reason"))
    ok = F.col("status") == "ok"
    return held.groupBy("lang").agg(F.count("*").alias("files_total"), F.count_if(ok).alias("embedded"), F.count_if(~ok).alias("skipped"), F.min("reason").alias("first_reason"))


@query("limit_max_files", "select url from pages order by string_split(url, '/') limit 25")
def limit_max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.first_files(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), 25).select(F.col("path").alias("url"))


@query("dst_names", "select page_id, printf('%05d_%s_%s', row_number() over (partition by page_id % 7 order by url, page_id), substr(sha1(url), 1, 10), string_split(url, '/')[-1]) name from pages")
def dst_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = files.numbered(table(spark, sf_dir, "pages").withColumn("g", F.col("page_id") % 7).withColumn("at", F.struct("url", "page_id")), ("g",), "at")
    return held.select("page_id", text.target_name(F.col("number"), F.col("url"), F.element_at(F.split("url", "/"), -1)).alias("name"))


@query("json_lenient", "with j as (select event_id, case when json_valid(props) then props end p from events) select event_id, coalesce(json_extract_string(p, '$.k'), json_extract_string(p, '$.page'), 'none') k, p is not null as parsed from j")
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("event_id", files.lenient_json(F.col("props"), "k string, page string, _corrupt_record string").alias("j"), "props")
    bad = F.col("props").isNull() | F.col("j._corrupt_record").isNotNull()
    return held.select("event_id", F.when(bad, "none").otherwise(F.coalesce("j.k", "j.page", F.lit("none"))).alias("k"), (~bad).alias("parsed"))


@query("score_normalize", "select event_id, round(case when v between 0 and 1 then v when v >= -1 and v < 0 then (v + 1) / 2 else 1 / (1 + exp(-v)) end, 6) score from (select event_id, value / 50 - 0.5 v from events)")
def score_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(scores.normalized_score(F.col("value") / 50 - 0.5), 6).alias("score"))


_SPLIT = """r as (select l.doc_id, quality, row_number() over (partition by quality order by sha1('42:' || l.doc_id), l.doc_id) k from labels l),
n as (select min(c) n from (select count(*) c from labels group by quality)),
s as (select doc_id, quality, k, case when k <= floor(n * 0.8) then 'train' when k <= floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end split,
 k - case when k <= floor(n * 0.8) then 0 when k <= floor(n * 0.8) + floor(n * 0.1) then floor(n * 0.8) else floor(n * 0.8) + floor(n * 0.1) end number from r, n where k <= n)"""


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised.split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("split_balance", f"with {_SPLIT} select doc_id, quality, split, number::int number from s")
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).select("doc_id", "quality", "split", "number")


@query("split_counts", f"with {_SPLIT} select split, quality, count(*) n from s group by all")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised.split_counts(split_rows(spark, sf_dir), "quality")


@query("manifest", f"with {_SPLIT} select quality::varchar label, split, source src_name, printf('%05d_%s_%s', number::int, substr(sha1(source || '/' || doc_id), 1, 10), doc_id::varchar) dst_name from s join documents using (doc_id)")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = split_rows(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return held.select(F.col("quality").cast("string").alias("label"), "split", F.col("source").alias("src_name"), text.target_name(F.col("number"), path, F.col("doc_id").cast("string")).alias("dst_name"))


@query(
    "manifest_signature",
    """with p as (select turn, count(*) n from conversations group by turn),
l as (select list(turn || ':' || n order by turn) page_counts, sum(n)::bigint "rows" from p), s as (select count(distinct conv_id) sources from conversations)
select array_to_string(page_counts, ',') page_counts, "rows", sources, sha256('{"page_counts":[' || array_to_string(list_transform(page_counts, lambda x: '"' || x || '"'), ',') || '],"rows":' || "rows" || ',"sources":' || sources || '}') signature from l, s""",
)
def manifest_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = manifest(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return held.withColumn("page_counts", F.array_join("page_counts", ","))


@query("best_epoch", "with h as (select turn epoch, round(avg(length(text) % 7), 3) f1 from conversations group by turn) select epoch, f1 from h order by f1 desc, epoch desc limit 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "conversations").groupBy(F.col("turn").alias("epoch")).agg(F.round(F.avg(F.length("text") % 7), 3).alias("f1"))
    return supervised.best_epoch(history, "epoch", "f1")


@query("catalog_guard", "select d.doc_id, case when l.doc_id is null then 'create' else 'update' end action from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def catalog_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("action", F.lit("update"))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").withColumn("action", F.coalesce("action", F.lit("create")))
