import pytest
from pyspark.sql import functions as F

from pagelore.operators import families, jobs, supervised


def test_arguments_and_back_off():
    assert jobs.exactly_one(pdf="a", folder=None) == "pdf"
    for given in ({"pdf": None, "folder": ""}, {"pdf": "a", "folder": "b"}):
        with pytest.raises(ValueError):
            jobs.exactly_one(**given)
    jobs.same_fields(["a", "b"], ["a", "b"])
    with pytest.raises(ValueError):
        jobs.same_fields(["a", "b"], ["b", "a"])
    tried = []

    def encode(items, batch):
        tried.append(batch)
        if batch > 3:
            raise MemoryError
        return [i * 2 for i in items]

    assert jobs.backing_off(encode, [1, 2], 16) == [2, 4] and tried == [16, 8, 4, 2]
    with pytest.raises(MemoryError):
        jobs.backing_off(lambda items, batch: encode(items, 9), [1], 4)


def test_unknown_labels_fail(spark):
    known = spark.createDataFrame([("a", 0)], "label string, label_id int")
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    assert supervised.checked_labels(rows.where("label = 'a'"), "label", known).first().label_id == 0
    with pytest.raises(Exception, match="unknown label: b"):
        supervised.checked_labels(rows, "label", known).collect()


def test_repeated_ids_are_scored_each(spark):
    weights = spark.createDataFrame([(0, "a", [1.0, 0.0], 0.0), (1, "b", [0.0, 1.0], 0.0)], "label_id int, label string, weights array<double>, bias double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.5, 0.5])], "doc int, v array<double>")
    out = supervised.predicted(vectors, weights, "doc", "v", "label").collect()
    assert sorted((r.doc, r.label, len(r.logits)) for r in out) == [(1, "a", 2), (1, "a", 2), (1, "b", 2)]


def test_pages_outside_of_the_catalog(spark):
    rows = [(i, 0, "x" if i % 2 else "y", float(i % 2 * 10 + i / 10)) for i in range(10)] + [(20, 0, "x", None), (21, 7, "x", 1.0)]
    pages = spark.createDataFrame(rows, "doc int, page int, kind string, size double")
    catalog = families.page_catalog(pages.where("page = 0 and size is not null"), "page", "kind", ("size",))
    held = {r.doc: r for r in families.page_scores(pages, catalog, "page", ("size",)).collect()}
    assert (held[20].status, held[21].status, held[21].family, held[21].scores) == ("no_features", "uncatalogued", None, None)
    assert held[3].family == "x" and held[4].family == "y" and held[3].confidence in ("high", "medium")
    assert [s.family for s in held[3].scores] == ["x", "y"]


def test_examples_and_measured_families(spark):
    one = spark.range(1).select(families.merged_examples(F.array(F.lit("c"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b"), F.lit("d")), most=3).alias("l"))
    assert one.first().l == ["c", "a", "b"]
    pages = spark.createDataFrame([(1, "a", 0.0), (2, "a", 2.0), (3, "b", 10.0), (3, "b", 12.0)], "doc int, kind string, size double")
    held = families.measured(pages, families.fitted(pages, "kind", ("size",)), ("size",)).collect()
    assert [r.near[0].family for r in sorted(held, key=lambda r: r.size)] == ["a", "a", "b", "b"]
    empty = pages.where("doc > 5")
    assert families.measured(empty, families.fitted(empty, "kind", ("size",)), ("size",)).count() == 0


def test_texts_of_paths(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, " "), (4, "q"), (5, "r"), (6, None)], "id int, path string")
    texts = spark.createDataFrame([("p", "text"), ("q", None)], "path string, text string")
    assert {r.id: (r.found, r.text) for r in jobs.row_texts(rows, texts, "path", "text").collect()} == {1: ("ok", "text"), 2: ("ok", "text"), 3: ("missing", ""), 4: ("unreadable", ""), 5: ("missing", ""), 6: ("missing", "")}
