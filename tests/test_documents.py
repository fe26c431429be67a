import pytest
from pyspark.sql import functions as F

from pagelore.functions.text import tokens
from pagelore.operators import documents, families
from pagelore.operators.prototypes import jaccard, jaccard_of_sets
from pagelore.plans.families import chat_pages
from pagelore.sources.store import stored

CATALOG = "page int, mean array<double>, std array<double>, families array<struct<family:string,centroid:array<double>,dist_mean:double,dist_max:double,examples:array<struct<rank:int,doc:string,distance:double,excerpt:string>>>>, registry array<struct<family:string,dist_mean:double,dist_max:double,examples:array<struct<rank:int,doc:string,distance:double,excerpt:string>>>>"
LONG = "the quick brown fox jumps over the lazy dog"
OTHER = "completely different words stand on this other page"


def catalog(spark):
    families = [("a", [0.0], 0.5, 1.0, [(1, "ra", 0.1, LONG)]), ("b", [5.0], None, None, None), ("c", [9.0], 0.5, 1.0, [(1, "short", 0.1, "tiny")])]
    registry = [("b", 0.2, 2.0, [(1, "rb", 0.1, OTHER), (2, "rb2", 0.2, OTHER)]), ("a", 9.0, 9.0, [])]
    return spark.createDataFrame([(0, [1.0], [2.0], families, registry), (7, [0.0], [1.0], families[:1], [])], CATALOG)


def found(spark, rows, held=None, **options):
    pages = spark.createDataFrame(rows, "doc long, page int, `x.y` double, text string, row string")
    return documents.searched(pages, catalog(spark) if held is None else held, "page", "text", ("x.y",), jaccard, lambda c: F.array_distinct(tokens(c)), **options)


def test_families_by_text_and_distance_and_the_registry(spark):
    rows = [(1, 0, 1.0, LONG, "r"), (1, 1, 1.0, OTHER, "r"), (1, 2, 19.0, "short", "r"), (1, 3, None, LONG, "r"), (1, 4, 11.0, "x" * 30, "r"), (1, 5, 11.5, None, None)]
    held = {r.page: r for r in found(spark, rows).collect()}
    assert (held[0].family, held[0].distance, held[0].confidence, held[0].text_score, held[0].text_ref, held[0].strategy) == ("a", 0.0, "high", 1.0, "ra", documents.BY_TEXT)
    # the text is like family b's reference, which only the registry has, and so are its distances
    assert (held[1].family, held[1].distance, held[1].text_score, held[1].text_ref, held[1].confidence) == ("b", 5.0, 1.0, "rb", "low_out_of_family")
    assert (held[2].family, held[2].text_status, held[2].strategy, held[2].confidence) == ("c", "unavailable_short_text", documents.BY_DISTANCE, "high")
    assert (held[3].status, held[3].family, held[3].confidence, held[3].text_status) == ("no_features", None, None, None)
    assert (held[4].text_status, held[4].text_score, held[4].family) == ("ok", 0.0, "b") or held[4].family == "a"
    assert (held[5].family, held[5].confidence, held[5].text_status) == ("b", "medium", "unavailable_short_text")
    assert held[0].row == "r" and held[0]["x.y"] == 1.0
    off = {r.page: r for r in found(spark, rows, compare=False).collect()}
    assert {r.text_status for r in off.values()} == {"disabled", None} and off[1].family == "a"
    assert {r.status for r in found(spark, rows, catalog(spark).limit(0)).collect()} == {"uncatalogued"}
    assert found(spark, []).count() == 0


def test_scores_that_are_no_numbers(spark):
    pages = spark.createDataFrame([(1, 0, 1.0, LONG)], "doc long, page int, x double, text string")
    held = documents.searched(pages, catalog(spark), "page", "text", ("x",), lambda a, b: F.lit(float("nan"))).first()
    assert (held.text_status, held.text_score, held.family, held.strategy) == ("error", None, "a", documents.BY_DISTANCE)
    none = documents.searched(pages, catalog(spark).drop("registry").withColumn("families", F.transform("families", lambda c: c.withField("examples", F.lit(None).cast(documents.REFERENCES)))), "page", "text", ("x",), jaccard, tokens).first()
    assert none.text_status == "unavailable_no_reference"


def test_verdicts_entries_and_files(spark, tmp_path):
    rows = [(1, p, x, "no", None) for p, x in ((10, 1.0), (11, 1.2), (12, 1.0), (20, 1.0), (30, 60.0))]
    rows += [(2, 0, 90.0, "no", None), (2, 1, 70.0, "no", None), (3, 0, None, "no", None), (4, 0, None, "no", None), (4, 1, 1.0, LONG, None)]
    pages, told, counts = documents.write_search(found(spark, rows), "doc", "page", str(tmp_path / "out"))
    held = {r.doc: r for r in told.collect()}
    assert pages.count() == len(rows) and set(held) == {1, 2, 3, 4}
    one = held[1]
    assert (one.status, one.pages_total, one.hit_pages, one.entry_pages, one.best_page, one.best_confidence) == ("detected", 5, 4, 2, 10, "high")
    assert (held[2].status, held[2].best_page, held[2].best_confidence, held[2].entry_pages) == ("not_detected", 1, "low_out_of_family", 0)
    assert (held[3].status, held[3].pages_scanned, held[3].page_errors, held[3].best_page) == ("no_usable_pages", 0, 1, None)
    assert (held[4].status, held[4].page_errors, held[4].best_page, held[4].best_text_score) == ("detected", 1, 1, 1.0)
    assert tuple(counts.first()) == (4, 2, 2, 0.5)
    with pytest.raises(Exception, match="already exists"):
        documents.write_search(found(spark, rows), "doc", "page", str(tmp_path / "out"))


def test_examples_are_the_closest(spark):
    base = spark.createDataFrame([(0, [0.0], [1.0], [("a", [0.0], 1.0, 1.0), ("b", [1.0], 1.0, 1.0)])], "page int, mean array<double>, std array<double>, families array<struct<family:string,centroid:array<double>,dist_mean:double,dist_max:double>>")
    members = spark.createDataFrame([(0, "a", i, f"text {i}", float(i % 4)) for i in range(12)], "page int, family string, doc int, text string, distance double")
    held = documents.with_examples(base, members, "page", "family", "doc", "text", most=4).first()
    assert [[e.doc for e in f.examples] for f in held.families] == [["0", "4", "8", "1"], []]


def test_references_are_encoded_once_and_not_for_each_page(spark):
    pages = spark.createDataFrame([(1, 0, 1.0, LONG)], "doc long, page int, x double, text string")
    held = documents.searched(pages, catalog(spark), "page", "text", ("x",), jaccard, lambda c: F.array_distinct(F.split(c, "q@q")))
    pages_side, _, catalog_side = held._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftOuter")
    assert pages_side.count("q@q") == 1 and catalog_side.count("q@q") == 1
    assert pages_side.count("array_intersect") == 1  # the score is worked out once, however often it is looked at


def test_scores_of_sets_are_those_of_arrays_and_look_at_a_pair_once(spark):
    pairs = [([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["b", "c", "d"]), (["a", "b"], ["b", "a"]), (["a"], ["b"])]
    held = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert held.where(~jaccard(F.col("a"), F.col("b")).eqNullSafe(jaccard_of_sets(F.col("a"), F.col("b")))).count() == 0
    plan = held.select(F.transform(F.array("b"), lambda b: jaccard_of_sets(F.col("a"), b)).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_intersect") == 1 and "array_union" not in plan


def test_a_table_of_one_file_is_scored_by_more_than_one_task(spark, tmp_path):
    rows = [(i, t, "user", f"text {i} {t}") for i in range(50) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    held = chat_pages(spark, str(tmp_path), "text")
    assert held.count() == 200 and held.select("conv_id", "turn").distinct().count() == 200
    each = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == spark.sparkContext.defaultParallelism and max(each) < 100


def test_pages_are_not_shuffled_by_their_number(spark):
    pages = stored(spark.range(400).select((F.col("id") % 2).alias("page"), F.concat(F.lit("f"), F.col("id") % 3).alias("family"), F.col("id").cast("double").alias("x")))
    catalog = stored(families.page_catalog(pages, "page", "family", ("x",)))
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the pages were many
    try:
        assert joins(families.page_scores(pages, catalog, "page", ("x",))) == 0
        assert joins(families.page_catalog(pages, "page", "family", ("x",))) == 1  # of the catalog's own rows, one a page number
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
