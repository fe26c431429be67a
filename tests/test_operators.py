import pytest
from pyspark.sql import functions as F

from pagelore.operators import families, paradigm, prototypes, search, supervised
from pagelore.operators.catalog import Catalog, CatalogError, contained
from pagelore.sources import files
from pagelore.streaming.live import live_search, write_hits


def test_percentiles_and_cutoffs(spark):
    rows = spark.createDataFrame([("t", float(x)) for x in (1, 2.5, 7, 9, 11.5, 20, 33)], "tag string, score double")
    assert paradigm.thresholds(rows, "tag").first().threshold == pytest.approx(1.45)
    assert paradigm.thresholds(rows, "tag", "mean_std", 1.0).first().threshold == pytest.approx(12.0 - 10.354433)
    assert paradigm.thresholds(rows.limit(1), "tag").count() == 0


def test_vectors_that_cancel_out_raise(spark):
    rows = spark.createDataFrame([("t", [1.0, 0.0]), ("t", [-1.0, 0.0])], "tag string, v array<double>")
    with pytest.raises(Exception, match="zero norm"):
        paradigm.paradigms(rows, "tag", "v").collect()


def test_paradigm_is_a_unit_vector(spark):
    rows = spark.createDataFrame([("t", [3.0, 4.0]), ("t", [0.0, 2.0]), ("u", [1.0, 1.0])], "tag string, v array<double>")
    for r in paradigm.paradigms(rows, "tag", "v").collect():
        assert sum(x * x for x in r.paradigm) == pytest.approx(1)


def test_islands_and_verdicts(spark):
    pages = spark.createDataFrame([(1, p, "high" if p in (10, 11, 12, 20) else "low_out_of_family", 1.0 / p) for p in range(1, 25)], "doc int, page int, confidence string, distance double")
    hits = pages.where("confidence = 'high'")
    assert sorted(r.page for r in families.entries(hits, "doc", "page").collect()) == [10, 20]
    v = families.verdicts(pages, "doc", "page").first()
    assert (v.status, v.pages, v.hits, v.best_page) == ("detected", 24, 4, 20)
    none = families.verdicts(pages.where("page < 5"), "doc", "page").first()
    assert (none.status, none.best_page) == ("not_detected", 4)


def test_splits(spark):
    for n, want in ((10, {"train": 8, "val": 1, "test": 1}), (1, {"test": 1}), (0, {})):
        rows = spark.createDataFrame([(i, "a") for i in range(n)], "k int, label string")
        assert {r.split: r.n for r in supervised.split_counts(supervised.split(rows, "k", "label"), "label").collect()} == want
    with pytest.raises(ValueError):
        supervised.check_shares(0.9, 0.2, 0.1)


def test_metrics_epoch_and_ties(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "t int, g int")
    labels = spark.createDataFrame([(0,), (1,)], "c int")
    assert tuple(supervised.macro_metrics(rows, "t", "g", labels, "c").first()) == (0.666667, 0.333333, 0.5, 0.4)
    epochs = spark.createDataFrame(list(enumerate((0.5, 0.9, 0.9, 0.7), 1)), "epoch int, f1 double")
    assert supervised.best_epoch(epochs, "epoch", "f1").first().epoch == 3
    weights = spark.createDataFrame([(1, "b", [1.0], 0.0), (0, "a", [1.0], 0.0)], "label_id int, label string, weights array<double>, bias double")
    vectors = spark.createDataFrame([(7, [1.0])], "doc int, v array<double>")
    assert supervised.predicted(vectors, weights, "doc", "v", "label").first().label == "a"
    losses = spark.createDataFrame([(i, float(i)) for i in range(5)], "i int, loss double")
    assert tuple(supervised.evaluation_loss(losses, "i", "loss", 2).first()) == ((0.5 + 2.5 + 4.0) / 3, 2.0)


def test_catalog_guards_versions_and_history(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    row = lambda tag, t: spark.createDataFrame([(tag, "hash64", 0, t, "p05", [1.0])], "tag string, model string, page_index int, threshold double, method string, paradigm array<double>")
    assert catalog.entries().count() == 0 and catalog.events().count() == 0
    catalog.put(row("a", 0.5))
    with pytest.raises(CatalogError):
        catalog.put(row("a", 0.6))
    with pytest.raises(CatalogError):
        catalog.put(row("b", 0.6), update=True)
    with pytest.raises(CatalogError):
        catalog.put(row("a", 0.6), update=True, authorize=False)
    catalog.put(row("a", 0.6), update=True)
    held = catalog.resolve("a")
    assert (held["threshold"], held["update_count"]) == (0.6, 1)
    assert [r.action for r in catalog.history().orderBy("action").collect()] == ["create", "update"]
    with pytest.raises(CatalogError):
        catalog.resolve("zz")
    assert contained("/r/io", "in/../x") == "/r/io/x"
    for bad in ("../x", "a/../../x", "/etc/x"):
        with pytest.raises(CatalogError):
            contained("/r/io", bad)


def test_file_sources(spark, tmp_path):
    for name in ("a/z.pdf", "a-b/a.pdf", "a.pdf", "a/n.txt"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(b"one\x0ctwo")
    docs = files.documents(spark, str(tmp_path / "r"), recursive=True)
    assert [r.path.split("/r/")[1] for r in docs.orderBy(files.path_order()).collect()] == ["a/z.pdf", "a-b/a.pdf", "a.pdf"]
    assert files.first_files(docs, 2).count() == 2
    pages = files.page_texts(docs, lambda b: b.decode().split("\x0c"))
    assert sorted({(r.page_index, r.text) for r in pages.collect()}) == [(0, "one"), (1, "two")]
    assert {r.text for r in files.page_of(docs, pages, 5).collect()} == {""}
    tree = files.labelled_tree(spark, str(tmp_path / "r"))
    assert tree.count() == 0
    (tmp_path / "r/train/x/deep").mkdir(parents=True)
    (tmp_path / "r/train/x/deep/q.pdf").write_bytes(b"q")
    tree = files.labelled_tree(spark, str(tmp_path / "r"))
    assert [(r.split, r.label, r.file) for r in tree.collect()] == [("train", "x", "q.pdf")]
    js = spark.createDataFrame([('{"k": "v"}',), ("{bad",), (None,)], "t string").select(files.lenient_json(F.col("t"), "k string").alias("j")).select("j.k")
    assert [r.k for r in js.collect()] == ["v", None, None]


def test_search_override_and_stream(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "doc int, v array<double>")
    catalog = spark.createDataFrame([("t", [1.0, 0.0], 0.5)], "tag string, paradigm array<double>, threshold double")
    found = search.found(search.find_docs(vectors, catalog, "tag", "doc", "v"), "doc").collect()
    assert [(r.doc, r.similarity_pct) for r in found] == [(1, 100.0), (2, 60.0)]
    assert search.find_docs(vectors, catalog, "tag", "doc", "v", 90.0).where("pass_threshold").count() == 1
    assert tuple(search.summary(search.find_docs(vectors, catalog, "tag", "doc", "v")).first()) == (3, 2, 0.666667)
    vectors.write.parquet(f"{tmp_path}/in")
    live = live_search(spark, f"{tmp_path}/in", "doc int, v array<double>", catalog, "tag", "doc", "v")
    write_hits(live, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert sorted(r.doc for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_prototype_scores_like_all_pairs(spark):
    items = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["x", "y", "z"]), ("a", 3, ["q"]), ("a", 4, ["x"]), ("b", 5, ["m"]), ("b", 6, ["m"])], "tag string, id long, t array<string>")
    pairs = prototypes.pair_scores(items, items, "tag", "id", "t", prototypes.jaccard)
    all_ = {(r.tag, r.i, r.j): r.score for r in pairs.collect()}
    medoids = prototypes.medoid(prototypes.mean_from_pairs(pairs, "tag"), "tag")
    middle = {r.tag: r.medoid for r in medoids.collect()}
    assert middle == {"a": 1, "b": 5}
    top = prototypes.top_prototypes(items, medoids, "tag", "id", "t", prototypes.jaccard, 2)
    got = {(r.tag, r.rank): r.prototype for r in top.collect()}
    for tag, m in middle.items():
        best = sorted((j for t, i, j in all_ if t == tag and i == m), key=lambda j: (-all_[tag, m, j], j))[:2]
        assert [got[tag, 1], got[tag, 2]] == best
    scored = prototypes.prototype_scores(items, top, "tag", "id", "t", prototypes.jaccard).collect()
    assert len(scored) == 6
    for r in scored:
        s = [all_[r.tag, r.i, got[r.tag, k]] for k in (1, 2)]
        assert r.score_pct == pytest.approx((0.7 * max(s) + 0.3 * sum(s) / 2) * 100, abs=1e-4)


def test_registered_kmeans_and_elbow_find_planted_families(spark, tmp_path):
    import numpy as np

    from pagelore.functions.features import zscored
    from pagelore.plans.families import FIELDS, page_rows
    from pagelore.plans.registry import QUERIES

    kinds = [(5, 3), (5, 40), (60, 3), (60, 12)]  # words in a text and letters in a word
    texts = [" ".join(["x" * size] * (words + i % 3)) for words, size in kinds for i in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.family for r in QUERIES["kmeans_families"](spark, str(tmp_path)).collect()}
    assert len(found) == 48 and all(len({found[g * 12 + i] for i in range(12)}) == 1 for g in range(4)) and len(set(found.values())) == 4

    x = np.array([[r[f"{f}_z"] for f in FIELDS] for r in zscored(page_rows(spark, str(tmp_path)), FIELDS).collect()], dtype=float)
    rng = np.random.default_rng(0)

    def lloyd(k):
        distinct = np.unique(x, axis=0)
        centers = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(50):
            near = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
            centers = np.array([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(k)])
        return ((x[:, None] - centers) ** 2).sum(2).min(1).sum()

    got = sorted(tuple(r) for r in QUERIES["elbow"](spark, str(tmp_path)).collect())
    assert [k for k, _ in got] == list(range(2, 9))
    for k, inertia in got:
        assert inertia <= 1.1 * min(lloyd(k) for _ in range(200)) + 1e-6
