import corpus_pipeline
from pagelore.llm import language
from tests.llm.fixtures import frame, odd_rows
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_copies import groups
from tests.llm.test_substrings import brute_gone, planted, words


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    rows = planted()
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(f"x{i}" for i in range(30))), (2, rows[9][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(language, "EPOCHS", 2)
    monkeypatch.setattr(language, "LEAST", 0.0)
    out = docs
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    stage = dict(corpus_pipeline.STAGES)
    key = lambda rs: sorted(((r[0], tuple(words(r[1]))) for r in rs), key=str)
    got = language.in_a_language(out, language.trained(out), 0.0)
    assert key(got.collect()) == key(kept)
    got = stage["near_duplicates"](spark, frame(spark, kept), str(tmp_path))
    first = {}  # one row of each group: that of the least id, null last
    for r, g in zip(kept, groups(kept)[0], strict=True):
        first[g] = min(first.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    want = list(first.values())
    assert key(got.collect()) == key(want)
    got = stage["substrings"](spark, frame(spark, want), str(tmp_path))
    gone = brute_gone(want, 20)
    want = [(r[0], " ".join(w.decode() for k, w in enumerate(words(r[1])) if k not in gone[i])) for i, r in enumerate(want)]
    want = [r for r in want if r[1]]
    assert key(got.collect()) == key(want)
    left = got.collect()
    got = stage["decontamination"](spark, frame(spark, [tuple(r) for r in left]), str(tmp_path))
    bad = [r[5] for r in contaminated([], items)]
    assert bad == []
    clean = [r for r in left if not contaminated([tuple(r)], items)[0][5]]
    assert key(got.collect()) == key(clean)


def test_run_writes_every_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 1)
    frame(spark, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == frame(spark).columns
    assert 0 < out.count() < len(odd_rows())
