import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pagelore.functions.scores import defaulted
from pagelore.operators import families, reports
from pagelore.sources.reports import read_head, read_part, write_report


def test_search_report_with_ties_nulls_and_a_hot_tag(spark, tmp_path):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"t{i % 5}", i, round(rng.random(), 1) * 100, rng.choice([True, False, None])) for i in range(400)]
    rows += [(None, 900, 50.0, True), (None, 901, 50.0, True)]
    path = str(tmp_path / "search")
    reports.write_search(spark.createDataFrame(rows, "tag string, id long, similarity_pct double, pass_threshold boolean"), "tag", "id", path, {"job": "x"})
    head = read_head(spark, path)
    assert (head["total_files"], head["found_count"], head["job"]) == (402, sum(bool(r[3]) for r in rows), "x")
    got = {(r.tag, r.id): r.place for r in read_part(spark, path, "found", "tag string, id long, similarity_pct double, place long").collect()}
    want = {}
    for tag in {r[0] for r in rows}:
        hits = sorted((-r[2], r[1]) for r in rows if r[0] == tag and r[3])
        want |= {(tag, i): k + 1 for k, (_, i) in enumerate(hits)}
    assert got == want
    assert read_part(spark, path, "all_results", "tag string, id long, similarity_pct double, pass_threshold boolean").count() == 402
    with pytest.raises(AnalysisException):
        reports.write_search(spark.createDataFrame(rows[:1], "tag string, id long, similarity_pct double, pass_threshold boolean"), "tag", "id", path, {})


def test_validation_judges_no_tag_of_one_and_all_equal_ones_pass(spark, tmp_path):
    rows = [("a", i, 0.7) for i in range(7)] + [("b", 50, 0.2)] + [("c", 60 + i, i / 40) for i in range(40)]
    path = str(tmp_path / "validation")
    reports.write_validation(spark.createDataFrame(rows, "tag string, id long, score double"), "tag", "id", path, {"source": "s"})
    head = read_head(spark, path)
    assert (head["total_covers"], head["valid_count"], head["invalid_count"], head["not_judged"]) == (48, 45, 2, 1)
    held = read_part(spark, path, "rows", "tag string, id long, similarity_pct double, valid boolean, place long").collect()
    assert sorted(r.place for r in held if r.tag == "c") == list(range(1, 41))
    assert sorted(r.id for r in held if r.tag == "c" and not r.valid) == [60, 61]
    assert read_part(spark, path, "metrics", "tag string, total long").count() == 2


def test_predictions_of_short_texts_and_missing_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 50), (2, "short"), (3, None), (4, "y" * 60)], "id long, text string")
    made = spark.createDataFrame([(1, "q", [0.25, 0.75], ["p", "q"]), (2, "p", [1.0, 0.0], ["p", "q"])], "id long, label string, probabilities array<double>, labels array<string>")
    path = str(tmp_path / "predictions")
    reports.write_predictions(reports.prediction_rows(docs, made, "id", "text", "label"), path, {"page_index": "0"})
    head = read_head(spark, path)
    assert (head["total_files"], head["predicted_count"], head["page_index"]) == (4, 1, "0")
    held = {r.id: r for r in read_part(spark, path, "rows", "id long, status string, predicted_label string, confidence_pct double, probs_pct map<string,double>").collect()}
    assert {i: r.status for i, r in held.items()} == {1: "ok", 2: "skipped_short_text", 3: "skipped_short_text", 4: "no_vector"}
    assert held[1].probs_pct == {"p": 25.0, "q": 75.0} and held[1].confidence_pct == 75.0 and held[2].predicted_label is None


def test_a_report_without_a_head_is_not_read(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "cut" / "rows"))
    with pytest.raises(AnalysisException):
        read_part(spark, str(tmp_path / "cut"), "rows", "id long")
    write_report(str(tmp_path / "none"), spark.range(1).select(F.lit(0).alias("n")), rows=spark.range(0))
    assert read_part(spark, str(tmp_path / "none"), "rows", "id long").count() == 0


def test_first_rows_listings_and_counts(spark):
    rows = spark.createDataFrame([(i % 2, i // 3, None if i % 7 == 0 else i % 4) for i in range(300)], "g int, at int, v int")
    assert rows.sparkSession.createDataFrame([], rows.schema).transform(lambda d: reports.first_of_each(d, ("g",), "at", 5)).count() == 0
    first = reports.first_of_each(rows, ("g",), "at", 5)
    assert sorted((r.g, r.place) for r in first.collect()) == [(g, p) for g in (0, 1) for p in range(1, 6)]
    assert "WindowGroupLimit" in first._jdf.queryExecution().toString()
    assert sorted((r.g, r.v, r.place) for r in reports.listing(rows, "g", "v").collect()) == [(0, 0, 1), (0, 2, 2), (1, 1, 1), (1, 3, 2)]
    assert [(r.kept, r.dropped) for r in reports.kept_counts(rows, F.col("v") == 1).collect()] == [(sum(i % 7 != 0 and i % 4 == 1 for i in range(300)), 300 - sum(i % 7 != 0 and i % 4 == 1 for i in range(300)))]


def test_defaults(spark):
    rows = spark.createDataFrame([(0.0, "0", 0), (-0.0, "", 3), (None, None, None), (2.5, " ", -1)], "x double, t string, n int")
    got = rows.select(defaulted(F.col("x"), F.lit(9.0), 0.0), defaulted(F.col("t"), F.lit("d"), ""), defaulted(F.col("n"), F.lit(7))).collect()
    assert [tuple(r) for r in got] == [(9.0, "0", 7), (9.0, "d", 3), (9.0, "d", 7), (2.5, " ", -1)]


def test_ranks_by_text_score_then_distance(spark):
    near = "array<struct<distance double, family string>>".replace(" double", ":double").replace(" string", ":string")
    rows = spark.createDataFrame([([(1.0, "a"), (1.0, "b"), (0.5, "c"), (9.0, "d")], {"d": 0.0, "b": 0.4})], f"near {near}, texts map<string,double>")
    order = lambda c: [(r["family"], r["rank"]) for r in rows.select(c.alias("r")).first().r]
    assert order(families.ranked(F.col("near"), F.col("texts"))) == [("b", 1), ("d", 2), ("c", 3), ("a", 4)]
    assert order(families.ranked(F.col("near"))) == [("c", 1), ("a", 2), ("b", 3), ("d", 4)]
