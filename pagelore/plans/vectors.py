"""Queries over embeddings: prototypes, search, pairs, the linear classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.vectors import doubles, mean_vectors, unit
from pagelore.operators import block_scores, encoding, paradigm, prototypes, search, supervised, training
from pagelore.plans.registry import quantile_sql, query, table
from pagelore.sources.store import scratch, stored

TRAINED = training.Options(epochs=6, most_steps=8, rate=0.05)
_UNITS = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u from v)"""
_PARADIGM = f"""{_UNITS}, x as (select label, unnest(u) c, unnest(range(len(u))) pos from u),
m as (select label, list(c order by pos) m from (select label, pos, avg(c) c from x group by all) group by label),
p as (select label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) p from m),
s as (select vec_id, label, greatest(-1, least(1, round(list_dot_product(u, p), 12))) s from u join p using (label))"""
_CUTOFF = f"t as (select label, len(l) total, {quantile_sql('l', 0.05)} t, {quantile_sql('l', 0.1)} q1, {quantile_sql('l', 0.5)} q5, {quantile_sql('l', 0.9)} q9 from (select label, list_sort(list(s)) l from s group by label))"
_REPORT = f"""{_CUTOFF},
r as (select label, any_value(total) total, count(*) filter (s >= t) valid, any_value(t) t, min(s) lo, any_value(q1) q1, any_value(q5) q5, avg(s) m, any_value(q9) q9, max(s) hi from s join t using (label) group by label)
select label, total, valid, total - valid invalid, round(valid / total, 6) valid_ratio, case when valid / total >= 0.95 then 'ok' when valid / total >= 0.85 then 'warning' else 'poor' end status, round(t, 6) threshold,
 round(lo * 100, 4) min_pct, round(q1 * 100, 4) p10_pct, round(q5 * 100, 4) median_pct, round(m * 100, 4) mean_pct, round(q9 * 100, 4) p90_pct, round(hi * 100, 4) max_pct from r"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm.self_scores(table(spark, sf_dir, "embeddings"), "label", "embedding", ("vec_id",))


@query("paradigm_vectors", f"with {_PARADIGM} select label, unnest(range(len(p)))::int pos, round(unnest(p), 6) x from p")
def paradigm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm.paradigms(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.posexplode("paradigm").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("paradigm_threshold_p05", f"with {_PARADIGM}, {_CUTOFF} select label, total n, round(t, 6) threshold from t")
def threshold_p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm.thresholds(scores(spark, sf_dir), "label").withColumn("threshold", F.round("threshold", 6))


@query("paradigm_threshold_sigma", f"with {_PARADIGM} select label, count(*) n, round(avg(s) - 2 * stddev_pop(s), 6) threshold from s group by label")
def threshold_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm.thresholds(scores(spark, sf_dir), "label", "mean_std").withColumn("threshold", F.round("threshold", 6))


@query("paradigm_report", f"with {_PARADIGM}, {_REPORT}")
def paradigm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm.report(scores(spark, sf_dir), "label")


@query("paradigm_worst", f"with {_PARADIGM} select vec_id, label, round(s, 6) score from s order by s, vec_id limit 20")
def paradigm_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm.worst(scores(spark, sf_dir), "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


_HASHED = """d as (select doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[[:space:]]+', ' ', 'g')) t from documents),
tok as (select doc_id, lang, unnest(regexp_extract_all(lower(t), '[0-9A-Za-zÀ-ÿ]+')) t from d where length(t) >= 40),
c as (select doc_id, lang, ('0x' || md5(t)[1:8])::bigint % 64 pos, count(*)::double n from tok group by all),
w as (select doc_id, lang, pos, n / sqrt(sum(n * n) over (partition by doc_id)) x from c),
k as (select lang, count(distinct doc_id) k from w group by lang), m as (select lang, pos, sum(x) / any_value(k) x from w join k using (lang) group by all),
g as (select lang, list(coalesce(x, 0) order by pos) g from (select lang, pos, x from (select distinct lang from m) cross join (select unnest(range(64)) pos) left join m using (lang, pos)) group by lang),
p as (select lang, list_transform(g, lambda x: x / sqrt(list_dot_product(g, g))) p from g),
dv as (select doc_id, lang, list(coalesce(x, 0) order by pos) v from (select doc_id, lang, pos, x from (select distinct doc_id, lang from w) cross join (select unnest(range(64)) pos) left join w using (doc_id, lang, pos)) group by all),
s as (select doc_id, lang as label, greatest(-1, least(1, round(list_dot_product(v, p), 12))) s from dv join p using (lang))"""


@query("text_paradigm_report", f"with {_HASHED}, {_REPORT.replace('select label, total, valid', 'select label lang, total, valid')}")
def text_paradigm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = stored(paradigm.embed_covers(docs, "doc_id", "text", carry=("lang",)))
    return paradigm.report(paradigm.self_scores(held, "lang", "vec", ("doc_id",)), "lang")


@query("encoded_covers", f"with {_HASHED.replace('unnest(regexp_extract_all(lower(t)', 'unnest(regexp_extract_all(lower(substr(t, 1, 3000))')} select doc_id, lang, 64 dim, round(sum(pos * x), 6) moment, round(max(x), 6) largest from w group by all")
def encoded_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers through the model stage, with the stand-in encoder."""
    held = encoding.encoded_covers(table(spark, sf_dir, "documents"), "doc_id", "text", carry=("lang",))
    moment = F.aggregate(F.transform("vec", lambda x, i: x * i), F.lit(0.0), lambda t, x: t + x)
    return held.where(F.array_max("vec") > 0).select("doc_id", "lang", F.size("vec").alias("dim"), F.round(moment, 6).alias("moment"), F.round(F.array_max("vec"), 6).alias("largest"))


_FOUND = f"""with {_PARADIGM}, {_CUTOFF}, a as (select p.label, u.vec_id, round(list_dot_product(u, p), 12) s, t from u, p join t using (label))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    return paradigm.paradigms(held, "label", "embedding").join(paradigm.thresholds(scores(spark, sf_dir), "label"), "label")


@query("find_docs", f"{_FOUND} select label, vec_id, round(s * 100, 4) similarity_pct, s >= t pass_threshold from a where s >= t")
def find_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.found(search.find_docs(table(spark, sf_dir, "embeddings"), catalog(spark, sf_dir), "label", "vec_id", "embedding"), "vec_id")


@query("find_docs_override", f"{_FOUND} select label, vec_id, round(s * 100, 4) similarity_pct, s >= 0.5 pass_threshold from a")
def find_docs_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_docs(table(spark, sf_dir, "embeddings"), catalog(spark, sf_dir), "label", "vec_id", "embedding", 50.0)


@query("compare_page", f"with {_PARADIGM}, {_CUTOFF} select d.doc_id, length(trim(d.text))::int chars, case when length(trim(d.text)) >= 40 and u is not null then 'ok' else 'insufficient_text' end status, case when length(trim(d.text)) >= 40 then round(round(list_dot_product(u, p), 12) * 100, 4) end similarity_pct, case when length(trim(d.text)) >= 40 then round(list_dot_product(u, p), 12) >= t end pass_threshold from documents d left join u on vec_id = doc_id, t, p where p.label = 3 and t.label = 3")
def compare_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.compare_page(table(spark, sf_dir, "documents"), vectors, catalog(spark, sf_dir).where("label = 3"), "doc_id", "text", "embedding")


_SCORE = "case when d between 0 and 1 then d when d >= -1 and d < 0 then (d + 1) / 2 else 1 / (1 + exp(-d)) end"
_PAIRS = f"""{_UNITS}, dd as (select a.label, a.vec_id i, b.vec_id j, greatest(-1, least(1, list_dot_product(a.u, b.u))) d from u a join u b using (label)), pr as (select label, i, j, {_SCORE} s from dd),
mn as (select label, i, avg(s) m from pr where i <> j group by all), md as (select label, arg_max(i, (m, -i)) medoid, max(m) medoid_mean from mn group by label),
tp as (select label, j, s, row_number() over (partition by label order by s desc, j) rank from pr join md using (label) where i = medoid qualify rank <= 8),
bl as (select pr.label, pr.i, round((0.7 * max(pr.s) + 0.3 * avg(pr.s)) * 100, 4) score_pct from pr join tp on pr.label = tp.label and pr.j = tp.j group by all)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(doubles(F.col("embedding"))).alias("u"))


def pairs(spark: SparkSession, sf_dir: str, all_pairs: bool = False) -> DataFrame:
    return block_scores.within(units(spark, sf_dir), "label", "vec_id", "u", block_scores.cosine_block, all_pairs)


@query("pairwise_scores", f"with {_PAIRS} select label, i, count(*) n, round(avg(s), 6) mean, round(max(s), 6) best from pr group by all")
def pairwise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, True).select("label", "i", "n", F.round(F.col("sum") / F.col("n"), 6).alias("mean"), F.round("best", 6).alias("best"))


@query("medoid", f"with {_PAIRS} select label, medoid, round(medoid_mean, 6) medoid_mean from md")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.medoid(block_scores.means(pairs(spark, sf_dir), "label"), "label").withColumn("medoid_mean", F.round("medoid_mean", 6))


@query("medoid_by_sums", f"with {_UNITS}, mm as (select a.label, a.vec_id i, avg(list_dot_product(a.u, b.u)) m from u a join u b on a.label = b.label and a.vec_id <> b.vec_id group by all) select label, arg_max(i, (m, -i)) medoid, round(max(m), 6) medoid_mean from mm group by label")
def medoid_by_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = units(spark, sf_dir)
    return prototypes.medoid(prototypes.mean_scores(held, "label", "vec_id", "u"), "label").withColumn("medoid_mean", F.round("medoid_mean", 6))


def chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = units(spark, sf_dir)
    medoids = prototypes.medoid(block_scores.means(pairs(spark, sf_dir), "label"), "label")
    return held, prototypes.top_prototypes(held, medoids, "label", "vec_id", "u", prototypes.cosine)


@query("prototypes_topk", f"with {_PAIRS} select label, rank::int rank, j prototype, round(s, 6) score from tp")
def prototypes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(
    "token_paradigm_report",
    f"with {_PAIRS}, t as (select label, {quantile_sql('l', 0.05)} t from (select label, list_sort(list(score_pct)) l from bl group by label having count(*) >= 3)), r as (select label, count(*) total, count(*) filter (score_pct >= t) valid, any_value(t) t, avg(score_pct) m from bl join t using (label) group by label) select label, total, valid, round(valid / total, 6) valid_ratio, case when valid / total >= 0.95 then 'ok' when valid / total >= 0.85 then 'warning' else 'poor' end status, round(t, 3) threshold_pct, round(m, 4) mean_pct from r",
)
def token_paradigm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, top = chosen(spark, sf_dir)
    return prototypes.token_report(prototypes.prototype_scores(held, top, "label", "vec_id", "u", prototypes.cosine), "label")


_LINEAR = f"""{_UNITS}, x as (select label, unnest(v) c, unnest(range(len(v))) pos from v), m as (select label, list(c order by pos) m from (select label, pos, avg(c) c from x group by all) group by label),
w as (select label, row_number() over (order by label) - 1 label_id, m, -0.5 * list_dot_product(m, m) bias from m),
lg as (select vec_id, v.label truth, w.label, label_id, list_dot_product(v, m) + bias z from v, w),
pb as (select *, exp(z - max(z) over (partition by vec_id)) / sum(exp(z)) over (partition by vec_id) * exp(max(z) over (partition by vec_id)) p from lg),
pr as (select vec_id, any_value(truth) truth, arg_max(label, (z, -label_id)) label, arg_max(label_id, (z, -label_id)) label_id from lg group by vec_id)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("x"))
    weights = supervised.centroid_weights(held, "label", mean_vectors(held, "label", "x"))
    return supervised.predicted(held, weights, "vec_id", "x", "label")


@query("linear_predict", f"with {_LINEAR} select vec_id, label, label_id::int label_id from pr")
def linear_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("vec_id", "label", "label_id")


@query("softmax_probs", f"with {_LINEAR} select vec_id, label, round(p * 100, 4) pct from pb")
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = classified(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip("labels", "probabilities")).alias("z"))
    return held.select("vec_id", F.col("z.labels").alias("label"), F.round(F.col("z.probabilities") * 100, 4).alias("pct"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("vec_id", F.col("label").alias("guess")).join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth")), "vec_id")


@query("confusion", f"with {_LINEAR} select truth, label guess, count(*) n from pr group by all")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised.confusion(judged(spark, sf_dir), "truth", "guess")


@query(
    "macro_metrics",
    f"""with {_LINEAR}, l as (select distinct label from embeddings), c as (select l.label, count(*) filter (truth = l.label and pr.label = l.label) tp, count(*) filter (pr.label = l.label) g, count(*) filter (truth = l.label) s from l, pr group by l.label),
e as (select tp, s, case when g > 0 then tp / g else 0 end p, case when s > 0 then tp / s else 0 end r from c)
select round(sum(tp) / sum(s), 6) accuracy, round(avg(p), 6) "precision", round(avg(r), 6) recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 6) f1 from e""",
)
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return supervised.macro_metrics(judged(spark, sf_dir), "truth", "guess", labels, "label")


@query("fit_model")
def fit_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    model, ids = supervised.fit(held, "embedding", "label")
    return supervised.apply_fit(model, ids, held, "vec_id", "embedding", "label").select("vec_id", "label_pred", "label_id")


def labelled_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return supervised.split(held, "vec_id", "label", balance=False)


@query("fit_history")
def fit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six epochs over all training vectors in at most eight batches each; the best one by macro F1 of val is flagged."""
    return training.fit_history(labelled_splits(spark, sf_dir), scratch(spark, "fit"), "vec_id", "embedding", "label", TRAINED)


@query("fitted_report")
def fitted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored classifier, read back and evaluated on train, val and test."""
    path = scratch(spark, "fit")
    training.fit_history(labelled_splits(spark, sf_dir), path, "vec_id", "embedding", "label", TRAINED)
    return training.fitted_report(spark, path)
