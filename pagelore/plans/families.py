"""Queries over families of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions import features, scores
from pagelore.functions.text import tokens
from pagelore.operators import documents, families, kmeans
from pagelore.operators.block_scores import jaccard_block
from pagelore.operators.prototypes import jaccard_of_sets
from pagelore.plans.pages import PAGES_SQL, page_rows
from pagelore.plans.registry import query, table
from pagelore.sources.store import dealt, scratch, stored

FIELDS = features.TEXT_FIELDS
_Z = ", ".join(f"(x.{f} - avg(x.{f}) over ()) / (case when abs(stddev_pop(x.{f}) over ()) < 1e-9 then 1 else stddev_pop(x.{f}) over () end) {f}_z" for f in FIELDS)
_DIST = " + ".join(f"({f}_z - c_{f}) ** 2" for f in FIELDS)
_NEAR = f"""{PAGES_SQL}, z as (select doc_id, lang, {_Z} from f x), c as (select lang, {", ".join(f"avg({f}_z) c_{f}" for f in FIELDS)} from z group by lang),
d as (select doc_id, c.lang family, sqrt({_DIST}) distance from z, c), n as (select doc_id, arg_min(family, (distance, family)) family, min(distance) distance from d group by doc_id),
st as (select family, count(*) members, min(distance) dist_min, avg(distance) dist_mean, max(distance) dist_max from n group by family)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_rows(spark, sf_dir)
    return families.measured(pages, families.fitted(pages, "lang", FIELDS), FIELDS)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.col("near")[0]
    return measured(spark, sf_dir).select("doc_id", best["family"].alias("family"), best["distance"].alias("distance"))


@query("zscore_distance", f"with {_NEAR} select doc_id, family, round(distance, 6) distance, row_number() over (partition by doc_id order by distance, family)::int rank from d")
def zscore_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = measured(spark, sf_dir).select("doc_id", F.posexplode("near").alias("rank", "d"))
    return held.select("doc_id", F.col("d.family").alias("family"), F.round("d.distance", 6).alias("distance"), (F.col("rank") + 1).alias("rank"))


@query("family_scores", f"with {_NEAR} select doc_id, string_agg(family || '=' || printf('%.4f', distance), ';' order by family) scores from d group by doc_id")
def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distances of a page in order of the family."""
    held = families.scores_by_family(F.col("near"))
    said = F.transform(held, lambda c: F.concat(c["family"], F.lit("="), F.format_string("%.4f", c["distance"])))
    return measured(spark, sf_dir).select("doc_id", F.array_join(said, ";").alias("scores"))


@query("nearest_family", f"with {_NEAR} select doc_id, family, round(distance, 6) distance from n")
def nearest_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query("family_stats", f"with {_NEAR} select family, members, round(dist_min, 6) dist_min, round(dist_mean, 6) dist_mean, round(dist_max, 6) dist_max from st")
def family_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = families.family_stats(nearest(spark, sf_dir), "family")
    return held.select("family", "members", *[F.round(c, 6).alias(c) for c in ("dist_min", "dist_mean", "dist_max")])


_CONF = "case when dist_mean > dist_max then 'unknown' when distance <= dist_mean then 'high' when distance <= dist_max then 'medium' else 'low_out_of_family' end"


@query("family_confidence", f"with {_NEAR} select doc_id, family, {_CONF} confidence, case {_CONF} when 'high' then 3 when 'medium' then 2 when 'unknown' then 1 else 0 end rank from n join st using (family)")
def family_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = nearest(spark, sf_dir)
    out = families.with_confidence(held, families.family_stats(held, "family"), "family")
    return out.select("doc_id", "family", "confidence", scores.confidence_rank(F.col("confidence")).alias("rank"))


_SIM = ", ".join(f"round(least(100, greatest(0, 100 * exp(-0.5 * ({f}_z - c_{f}) ** 2))), 2) {f}_pct" for f in FIELDS)


@query("feature_similarity", f"with {_NEAR}, s as (select n.doc_id, n.family, {_SIM} from n join z using (doc_id) join c on c.lang = n.family) select *, floor((round(({' + '.join(f'{f}_pct' for f in FIELDS)}) * 100) * 2 + {len(FIELDS)}) / {2 * len(FIELDS)}) / 100 mean_pct from s")
def feature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", F.col("near")[0]["family"].alias("family"), *families.similarities(FIELDS))


@query("family_examples", f"with {_NEAR} select family, row_number() over (partition by family order by distance, doc_id)::int rank, doc_id, round(distance, 6) distance from n qualify rank <= 5")
def family_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = nearest(spark, sf_dir)
    return families.examples(held, "doc_id", "family").withColumn("distance", F.round("distance", 6))


_HITS = "h as (select conv_id, turn, text, case when length(text) >= 150 then 'high' else 'low_out_of_family' end confidence, 1000.0 / (1 + length(text)) distance from conversations)"
_ENTRIES = "e as (select * from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) prev from h where confidence = 'high') where prev is null or prev <> turn - 1)"


def hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(size >= 150, "high").otherwise("low_out_of_family").alias("confidence"), (F.lit(1000.0) / (1 + size)).alias("distance"))


@query("hit_entries", f"with {_HITS}, {_ENTRIES} select conv_id, turn from e")
def hit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.entries(hit_pages(spark, sf_dir).where("confidence = 'high'"), "conv_id", "turn").select("conv_id", "turn")


_VERDICT = f"""{_HITS}, {_ENTRIES}, k as (select h.*, case when e.turn is null then 0 else 1 end entry from h left join e using (conv_id, turn)),
vd as (select conv_id, case when count(*) filter (confidence = 'high') > 0 then 'detected' else 'not_detected' end status, count(*) pages, count(*) filter (confidence = 'high') hits,
 arg_max(turn, (entry, case confidence when 'high' then 3 else 0 end, -distance, -turn)) best_page, arg_max(confidence, (entry, case confidence when 'high' then 3 else 0 end, -distance, -turn)) best_confidence,
 round(arg_max(distance, (entry, case confidence when 'high' then 3 else 0 end, -distance, -turn)), 6) best_distance from k group by conv_id)"""


@query("document_verdict", f"with {_VERDICT} select * from vd")
def document_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.verdicts(hit_pages(spark, sf_dir), "conv_id", "turn")


@query("search_summary", f"with {_VERDICT} select count(*) total, count(*) filter (status = 'detected') detected, count(*) filter (status <> 'detected') not_detected, round(count(*) filter (status = 'detected') / count(*), 6) ratio from vd")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.batch_summary(families.verdicts(hit_pages(spark, sf_dir), "conv_id", "turn"))


_TOK = "list_distinct(regexp_extract_all(lower({0}), '[0-9A-Za-zÀ-ÿ]+'))"


@query(
    "reference_rerank",
    f"""with q as (select doc_id, doc_id % 10 g, text, length(trim(text)) n from documents), r as (select item_id, item_id % 10 g, text from benchmark where length(trim(text)) >= 20),
s as (select q.doc_id, r.item_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) s from (select *, {_TOK.format("text")} a from q where n >= 20) q join (select *, {_TOK.format("text")} b from r) r using (g)),
a as (select doc_id, max(s) best, avg(s) mean, arg_max(item_id, (s, -item_id)) best_ref, count(*) candidates from s group by doc_id)
select q.doc_id, case when n < 20 then 'unavailable_short_text' when candidates is null then 'unavailable_no_reference' else 'ok' end status, round(best, 6) best, round(mean, 6) mean, best_ref, substr(trim(regexp_replace(b.text, '[[:space:]]+', ' ', 'g')), 1, 220) best_excerpt, coalesce(candidates, 0) candidates from q left join a using (doc_id) left join benchmark b on b.item_id = best_ref""",
)
def reference_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10).alias("g"))
    refs = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("g"), F.col("item_id").alias("ref_id"), F.col("text").alias("ref_text"))
    return families.reranked(docs, refs, "doc_id", "text", "g", jaccard_block, lambda c: F.array_distinct(tokens(c)))


#: Rounds of k-means that the queries take at most, as many as their SQL has.
ROUNDS = 16


def _lloyd_sql(k_min: int, k_max: int) -> str:
    """z, then for each k and start the centers of every round (c0, c1, ...), the last as "best" of each k, and inertia."""
    pick = ", ".join(f"{f}_z" for f in FIELDS)
    mean = ", ".join(f"coalesce(avg(a.{f}_z), any_value(c.{f}_z)) {f}_z" for f in FIELDS)
    apart = " + ".join(f"(z.{f}_z - c.{f}_z) ** 2" for f in FIELDS)
    held = f"""{PAGES_SQL}, z as materialized (select doc_id, {_Z} from f x), st as (select unnest(range(10)) start)"""
    for t in range(k_max):
        u = f"(('0x' || substr(sha256('0:' || start || ':{t // 8}:' || z.doc_id), {8 * (t % 8) + 1}, 8))::bigint + 1) / 4294967296.0"
        drawn = "z, st" if t == 0 else f"(select z.doc_id, c.start, min({apart}) d from z, ({' union all '.join(f'select * from s{i}' for i in range(t))}) c group by all) z"
        weight = "1.0" if t == 0 else "d"
        held += f""",
s{t} as materialized (select start, {t} j, z.* from (select start, arg_min(doc_id, (race, doc_id)) doc_id from (select start, z.doc_id, case when {weight} > 0 then -ln({u}) / {weight} else 'infinity'::double end race from {drawn}) group by start) w join z using (doc_id))"""
    held += f""",
c0 as materialized (select k, start, j, {pick} from ({" union all ".join(f"select * from s{t}" for t in range(k_max))}) join (select unnest(range({k_min}, {k_max + 1})) k) on j < k)"""
    for i in range(ROUNDS):
        held += f""",
a{i} as (select k, start, doc_id, arg_min(j, (d, j)) j from (select c.k, c.start, c.j, z.doc_id, {apart} d from z, c{i} c) group by all),
c{i + 1} as materialized (select c.k, c.start, c.j, {mean} from c{i} c left join (select a{i}.*, {pick} from a{i} join z using (doc_id)) a on a.k = c.k and a.start = c.start and a.j = c.j group by all)"""
    return held + f""",
e as materialized (select k, start, doc_id, arg_min(j, (d, j)) j, min(d) d from (select c.k, c.start, c.j, z.doc_id, {apart} d from z, c{ROUNDS} c) group by all),
i as (select k, start, sum(d) inertia, count(*) n from e group by all), best as (select k, arg_min(start, (round(inertia / n, 9), start)) start from i group by k)"""


@query("kmeans_families", f"with {_lloyd_sql(4, 4)} select doc_id, e.j::int family, round(sqrt(d), 6) distance from e join best using (k, start)")
def kmeans_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _, _, _ = kmeans.families(page_rows(spark, sf_dir), FIELDS, "doc_id", 4, rounds=ROUNDS)
    return held.select("doc_id", "family", F.round("distance", 6).alias("distance"))


@query("elbow", f"with {_lloyd_sql(2, 8)} select k::int k, round(inertia, 4) inertia from i join best using (k, start)")
def elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.elbow(page_rows(spark, sf_dir), FIELDS, "doc_id", 2, 8, rounds=ROUNDS).withColumn("inertia", F.round("inertia", 4))


@query(
    "family_catalog",
    f"""with {_lloyd_sql(4, 4)}, m as (select doc_id, e.j family, sqrt(d) distance from e join best using (k, start)),
x as (select family, doc_id from m qualify row_number() over (partition by family order by distance, doc_id) <= 5)
select 0 page, family::varchar family, count(*) members, round(min(distance), 6) dist_min, round(avg(distance), 6) dist_mean, round(max(distance), 6) dist_max,
 any_value((select string_agg(x.doc_id::varchar, ',' order by m2.distance, x.doc_id) from x join m m2 using (doc_id) where x.family = m.family)) examples from m group by family""",
)
def family_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family catalog of k-means as it was written and read back, with the closest examples of each family."""
    pages = page_rows(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("page", F.lit(0))
    held = kmeans.write_family_catalog(pages, scratch(spark, "families"), "doc_id", "page", "text", FIELDS, (0,), 4, rounds=ROUNDS)
    told = held.select("page", F.explode("families").alias("f")).where("f.members > 0")
    return told.select("page", "f.family", "f.members", *(F.round(f"f.{c}", 6).alias(c) for c in ("dist_min", "dist_mean", "dist_max")), F.array_join(F.transform("f.examples", lambda e: e["doc"]), ",").alias("examples"))


_FEW = ("chars", "words")
_CHATS = "c as (select conv_id, turn, role, length(text)::double chars, len(regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-zÀ-ÿ]+'))::double words from conversations)"
_ZOF = ", ".join(f"(c.{f} - m_{f}) / s_{f} z_{f}" for f in _FEW)
_CATALOG = f"""{_CHATS}, st as (select turn, {", ".join(f"avg({f}) m_{f}, case when stddev_pop({f}) < 1e-9 then 1 else stddev_pop({f}) end s_{f}" for f in _FEW)} from c where turn < 3 group by turn),
z as (select c.*, {_ZOF} from c join st using (turn)), ce as (select turn, role family, {", ".join(f"avg(z_{f}) c_{f}" for f in _FEW)} from z group by all),
ap as (select z.turn, family, count(*) members, avg(sqrt({" + ".join(f"(z_{f} - c_{f}) ** 2" for f in _FEW)})) dist_mean, max(sqrt({" + ".join(f"(z_{f} - c_{f}) ** 2" for f in _FEW)})) dist_max from z join ce on ce.turn = z.turn and family = role group by all)"""
_PAGE_SCORES = f"""{_CATALOG}, d as (select conv_id, z.turn, family, sqrt({" + ".join(f"(z_{f} - c_{f}) ** 2" for f in _FEW)}) distance from z join ce on ce.turn = z.turn),
n as (select conv_id, turn, arg_min(family, (distance, family)) family, min(distance) distance, string_agg(family || '=' || printf('%.4f', distance), ';' order by family) scores from d group by all)"""


def chat_pages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    held = dealt(table(spark, sf_dir, "conversations"))
    return held.select("conv_id", "turn", "role", *more, F.length("text").cast("double").alias("chars"), F.size(tokens(F.col("text"))).cast("double").alias("words"))


@query("page_catalog", f"with {_CATALOG} select turn, family, members, round(c_chars, 6) c_chars, round(c_words, 6) c_words, round(dist_mean, 6) dist_mean, round(dist_max, 6) dist_max from ap join ce using (turn, family)")
def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family catalog of the first three pages of all documents."""
    held = families.page_catalog(chat_pages(spark, sf_dir).where("turn < 3"), "turn", "role", _FEW).select("turn", F.explode("families").alias("f"))
    return held.select("turn", "f.family", "f.members", *(F.round(F.col("f.centroid")[i], 6).alias(f"c_{n}") for i, n in enumerate(_FEW)), F.round("f.dist_mean", 6).alias("dist_mean"), F.round("f.dist_max", 6).alias("dist_max"))


@query(
    "page_scores",
    f"""with {_PAGE_SCORES} select c.conv_id, c.turn, case when st.turn is null then 'uncatalogued' when c.chars is null then 'no_features' else 'ok' end status, n.family, round(distance, 6) distance,
 case when distance is null then null when dist_mean > dist_max then 'unknown' when distance <= dist_mean then 'high' when distance <= dist_max then 'medium' else 'low_out_of_family' end confidence, scores
 from c left join st on st.turn = c.turn left join n on n.conv_id = c.conv_id and n.turn = c.turn left join ap on ap.turn = n.turn and ap.family = n.family""",
)
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the catalog of its page number; pages beyond the catalog are there, uncatalogued."""
    pages = chat_pages(spark, sf_dir)
    held = families.page_scores(pages, families.page_catalog(pages.where("turn < 3"), "turn", "role", _FEW), "turn", _FEW)
    said = F.transform("scores", lambda c: F.concat(c["family"], F.lit("="), F.format_string("%.4f", c["distance"])))
    return held.select("conv_id", "turn", "status", "family", F.round("distance", 6).alias("distance"), "confidence", F.array_join(said, ";").alias("scores"))


@query(
    "example_lists",
    """with l as (select lang, list(doc_id::varchar order by n_chars desc, doc_id)[1:4] a, list(doc_id::varchar order by n_chars desc, doc_id)[3:8] b from documents group by lang),
c as (select lang, list_concat(b, a) x from l) select lang, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:5], ',') examples from c""",
)
def example_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference examples of a family from two lists, in order, each once, five at most."""
    docs = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id"))
    few = docs.select("lang", F.col("doc_id").cast("string").alias("d"), rank.alias("r")).where("r <= 8").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "d"))).alias("l"))
    names = F.transform("l", lambda x: x["d"])
    return few.select("lang", F.array_join(families.merged_examples(F.slice(names, 3, 6), F.slice(names, 1, 4)), ",").alias("examples"))


_LOW = "regexp_extract_all(lower({0}), '[0-9A-Za-zÀ-ÿ]+')"
_SEARCH = f"""{_CHATS.replace("select conv_id, turn, role,", "select conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[[:space:]]+', ' ', 'g')) t, text,")},
st as (select {", ".join(f"avg({f}) m_{f}, case when stddev_pop({f}) < 1e-9 then 1 else stddev_pop({f}) end s_{f}" for f in _FEW)} from c where turn < 3),
z as (select c.*, {_ZOF} from c, st), ce as (select role family, {", ".join(f"avg(z_{f}) c_{f}" for f in _FEW)} from z where turn < 3 group by role),
dd as (select conv_id, turn, role, family, t, text, sqrt({" + ".join(f"(z_{f} - c_{f}) ** 2" for f in _FEW)}) distance from z, ce),
ap as (select family, avg(distance) dist_mean, max(distance) dist_max from dd where turn < 3 and role = family group by family),
ex as (select family, conv_id * 1000 + turn ref, substr(t, 1, 1800) x, row_number() over (partition by family order by distance, conv_id * 1000 + turn) r from dd where turn < 3 and role = family qualify r <= 5),
tx as (select dd.conv_id, dd.turn, dd.family, arg_max(ref, (s, -r)) ref, max(s) s from (select q.*, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) s from (select dd.conv_id, dd.turn, dd.family, ex.ref, ex.r, list_distinct({_LOW.format("dd.text")}) a, list_distinct({_LOW.format("ex.x")}) b from dd join ex using (family) where length(dd.t) >= 20 and length(ex.x) >= 20) q) dd group by all),
k as (select dd.*, s, ref, row_number() over (partition by conv_id, turn order by coalesce(s, -1) desc, distance, dd.family) n from dd left join tx using (conv_id, turn, family)),
sp as (select k.conv_id, k.turn, k.family, distance, case when distance <= dist_mean then 'high' when distance <= dist_max then 'medium' else 'low_out_of_family' end confidence, s, ref, case when s is null then 'distance_only' else 'text_rerank_then_distance' end strategy,
 case when length(t) < 20 then 'unavailable_short_text' when s is null then 'unavailable_no_reference' else 'ok' end text_status from k join ap using (family) where n = 1)"""
_JUDGED = f"""{_SEARCH}, h as (select *, confidence in ('high', 'medium') good from sp),
en as (select conv_id, turn from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) p from h where good) where p is null or p <> turn - 1),
j as (select h.*, case when en.turn is null then 0 else 1 end entry from h left join en using (conv_id, turn)),
w as (select *, row_number() over (partition by conv_id order by entry desc, case when s is null then 0 else 1 end desc, s desc, case confidence when 'high' then 3 when 'medium' then 2 else 0 end desc, distance, turn) n from j),
v as (select conv_id, case when bool_or(good) then 'detected' else 'not_detected' end status, count(*) pages_total, count(*) filter (good) hit_pages, sum(entry)::bigint entry_pages, any_value(turn) filter (n = 1) best_page, any_value(family) filter (n = 1) best_family, any_value(confidence) filter (n = 1) best_confidence,
 round(any_value(s) filter (n = 1), 6) best_text_score, any_value(strategy) filter (n = 1) strategy from w group by conv_id)"""


def searched_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chat_pages(spark, sf_dir, "text")
    few = stored(held.where("turn < 3").withColumn("page", F.lit(0)).withColumn("ref", F.col("conv_id") * 1000 + F.col("turn")))
    catalog = stored(families.page_catalog(few, "page", "role", _FEW))
    own = families.page_scores(few, catalog, "page", _FEW).select("page", "role", "ref", "text", F.filter("scores", lambda s: s["family"] == F.col("role"))[0]["distance"].alias("distance"))
    catalog = stored(documents.with_examples(catalog, own, "page", "role", "ref", "text"))
    return documents.searched(held, catalog, "page", "text", _FEW, jaccard_of_sets, lambda c: F.array_distinct(tokens(c)))


@query("document_pages_searched", f"with {_SEARCH} select conv_id, turn, family, round(distance, 6) distance, confidence, round(s, 6) text_score, ref::varchar text_ref, strategy, text_status from sp")
def document_pages_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every document: family by text and distance, confidence, and the reference text that is most like it."""
    held = searched_chats(spark, sf_dir)
    return held.select("conv_id", "turn", "family", F.round("distance", 6).alias("distance"), "confidence", F.round("text_score", 6).alias("text_score"), "text_ref", "strategy", "text_status")


@query("document_search", f"with {_JUDGED} select * from v")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, as it was written and read back."""
    _, told, _ = documents.write_search(searched_chats(spark, sf_dir), "conv_id", "turn", scratch(spark, "search"))
    return told.select("conv_id", "status", "pages_total", "hit_pages", "entry_pages", "best_page", "best_family", "best_confidence", F.round("best_text_score", 6).alias("best_text_score"), "strategy")


@query("document_search_summary", f"with {_JUDGED} select count(*) total, count(*) filter (status = 'detected') detected, count(*) filter (status <> 'detected') not_detected, round(count(*) filter (status = 'detected') / count(*), 6) ratio from v")
def document_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.write_search(searched_chats(spark, sf_dir), "conv_id", "turn", scratch(spark, "search"))[2]
