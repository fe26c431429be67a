import numpy as np
import pytest

from pagelore.functions import text
from pagelore.operators import supervised
from pagelore.operators import paradigm, profiles, prototypes, quantiles
from pagelore.operators.quantiles import exact_quantiles, order_statistics
from pyspark.sql import functions as F

SHARES = (0.0, 0.05, 0.1, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("cell_rows", [quantiles.CELL_ROWS, 3])
def test_quantiles_of_groups_of_all_shapes(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(quantiles, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(7)
    groups = {
        "normal": rng.normal(size=3000).tolist(),
        "ties": rng.integers(0, 3, 2000).astype(float).tolist(),
        "skewed": [*np.exp(rng.normal(0, 12, 2500)).tolist(), 1e300, -1e300],
        "one": [2.5],
        "two": [1.0, 4.0],
        "same": [3.0] * 50,
        "none": [None, None],
        "hot": [*([0.125] * 1500), *rng.normal(size=1500).tolist()],
    }
    groups |= {f"small{n}": rng.normal(size=n).tolist() for n in range(3, 13)}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    found = {r.k: r.q for r in exact_quantiles(rows, "k", "v", SHARES).collect()}
    assert set(found) == set(groups) - {"none"}
    for k, q in found.items():
        assert q == pytest.approx(np.quantile(groups[k], SHARES), rel=1e-12), k
    assert exact_quantiles(rows.limit(0), "k", "v", SHARES).count() == 0


def test_ranks_are_those_of_one_sort_of_each_label(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("label"))
    got = supervised.shuffled_ranks(rows, "id", "label", 42).toPandas()
    whole = rows.toPandas()
    import hashlib

    whole["d"] = [hashlib.sha1(f"42:{i}".encode()).hexdigest() for i in whole["id"]]
    whole["want"] = whole.sort_values(["d", "id"]).groupby("label").cumcount() + 1
    held = got.merge(whole[["id", "want"]], on="id")
    assert (held["rank"] == held["want"]).all() and len(held) == 6000
    assert dict(zip(got["label"], got["n_label"], strict=True)) == {"hot": 4000, "cold": 2000}


def test_required_fails_on_null(spark):
    rows = spark.createDataFrame([("Some Tag",), ("///",)], "t string")
    assert rows.where("t like 'S%'").select(text.required(text.tag(F.col("t")), "tag").alias("t")).first().t == "some_tag"
    with pytest.raises(Exception, match="no valid tag"):
        rows.select(text.required(text.tag(F.col("t")), "tag")).collect()


def test_all_equal_scores_are_wholly_valid(spark):
    rows = [(n, v) for n in range(2, 61) for v in [[0.6, 0.9, 0.3, 0.1, 0.7][n % 5]] * n] + [(1000 + n, 60.3 + n / 7) for n in range(3) for _ in range(5)]
    scores = spark.createDataFrame(rows, "tag int, score double")
    assert {(r.valid, r.status) for r in paradigm.report(scores, "tag").collect() if r.total != r.valid} == set()
    held = {r.tag: r for r in prototypes.token_report(scores.withColumnRenamed("score", "score_pct"), "tag").collect()}
    assert len(held) == 61 and all(r.valid == r.total and r.status == "ok" for r in held.values())


def test_proportional_vectors_score_alike(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(1, 9, 16).astype(float)
    rows = [(i, "t", (base * i).tolist()) for i in range(1, 30)] + [(i, "t", rng.normal(size=16).tolist()) for i in range(30, 34)]
    vectors = spark.createDataFrame(rows, "id int, tag string, v array<double>")
    scores = {r.id: r.score for r in paradigm.self_scores(vectors, "tag", "v", ("id",)).collect()}
    assert len({scores[i] for i in range(1, 30)}) == 1


def test_columns_at_once_and_whole_tables(spark):
    rng = np.random.default_rng(3)
    data = [("a" if i % 4 else None if i % 8 else "b", float(rng.integers(0, 5)), None if i % 3 else float(rng.normal()), None) for i in range(4000)]
    rows = spark.createDataFrame(data, "`g.h` string, x double, `y.z` double, w double")
    held = {r["g.h"]: r for r in order_statistics(rows, "g.h", ["x", "y.z", "w"], (0.1, 0.5)).collect()}
    assert set(held) == {"a", "b"}
    for g, r in held.items():
        for at, c in ((1, "x"), (2, "y.z")):
            values = [d[at] for d in data if d[0] == g and d[at] is not None]
            assert r[c].n == len(values) and r[c].q == pytest.approx(np.quantile(values, (0.1, 0.5)))
        assert (r["w"].n, r["w"].q) == (0, [None, None])
    whole = order_statistics(rows, None, ["x", "y.z"], (0.5,)).collect()
    assert len(whole) == 1 and whole[0].x.q == [np.median([d[1] for d in data])]
    assert order_statistics(rows.limit(0), None, ["x"], (0.5,)).collect() == []
    told = {r.field: r for r in profiles.profile(rows, ("x", "y.z", "w")).collect()}
    assert told["x"].median == np.median([d[1] for d in data]) and told["w"].n == 0 and told["w"].median is None
    assert told["y.z"].mean == pytest.approx(np.mean([d[2] for d in data if d[2] is not None]))


def test_a_cell_holds_a_like_share_of_all_rows_whatever_the_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CELL_ROWS", 100)
    rng = np.random.default_rng(5)
    data = [("hot", float(x)) for x in rng.normal(size=6000)] + [("tied", 0.5)] * 3000 + [(f"k{i % 500}", float(x)) for i, x in enumerate(rng.normal(3, 0.01, 3000))]
    rows = spark.createDataFrame(data, "k string, v double")
    count = 12000 // 100
    bounds = rows.agg(F.percentile_approx("v", F.array(*(F.lit((i + 0.5) / count) for i in range(count))), 4 * count).alias("b"))
    placed = rows.crossJoin(bounds).select("k", "v", quantiles._cell(F.col("b"), F.col("v"), count).alias("cell"))
    sizes = {r.cell: r["count"] for r in placed.where("cell % 2 = 0").groupBy("cell").count().collect()}
    assert max(sizes.values()) <= 200
    assert {r.v for r in placed.where("cell % 2 = 1 and v = 0.5").collect()} == {0.5}
    b = bounds.first().b
    for r in placed.select("v", "cell").distinct().collect():
        assert r.cell == 2 * sum(x < r.v for x in b) + (r.v in b)
