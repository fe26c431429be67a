import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelore.operators import block_scores, families, prototypes


def vectors(spark, n=70):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        v = rng.normal(size=4)
        rows.append(("hot" if i % 4 else "cold", i, (v / np.linalg.norm(v)).tolist()))
    rows += [("hot", 500, rows[1][2]), ("alone", 600, rows[0][2]), ("hot", 601, None), (None, 602, rows[0][2])]
    return spark.createDataFrame(rows, "tag string, id long, v array<double>")


@pytest.mark.parametrize("block", [7, 1024])
def test_within_like_all_pairs(spark, block):
    items = vectors(spark)
    pairs = prototypes.pair_scores(items, items, "tag", "id", "v", prototypes.cosine)
    best = F.max_by("j", F.struct("score", -F.col("j")))
    want = {(r.tag, r.i): r for r in pairs.groupBy("tag", "i").agg(F.count_if(F.expr("i <> j")).alias("n"), F.sum(F.when(F.expr("i <> j"), F.col("score"))).alias("sum"), F.max("score").alias("best"), best.alias("item")).collect()}
    got = {(r.tag, r.i): r for r in block_scores.within(items, "tag", "id", "v", block_scores.cosine_block, block=block).collect()}
    assert got.keys() == want.keys() and (None, 602) not in got
    for at, r in got.items():
        assert r.n == want[at].n and r.sum == pytest.approx(want[at].sum or 0.0) and r.best == pytest.approx(want[at].best)
    assert got["alone", 600].n == 0 and got["alone", 600].best_item == 600
    middle = lambda means: {r.tag: r.medoid for r in prototypes.medoid(means, "tag").collect()}
    assert middle(block_scores.means(block_scores.within(items, "tag", "id", "v", block_scores.cosine_block, block=block), "tag")) == middle(prototypes.mean_from_pairs(pairs, "tag"))
    whole = block_scores.within(items, "tag", "id", "v", block_scores.cosine_block, True, block).where("tag = 'hot'").select("n").distinct().collect()
    assert [r.n for r in whole] == [items.where("tag = 'hot'").count()]


def test_equal_items_tie(spark):
    rows = [("a", i, [0.6, 0.8]) for i in (9, 4, 7, 5)]
    items = spark.createDataFrame(rows, "tag string, id long, v array<double>")
    for block in (1, 2, 1024):
        totals = block_scores.within(items, "tag", "id", "v", block_scores.cosine_block, block=block)
        assert {r.best_item for r in totals.collect()} == {4}
        assert prototypes.medoid(block_scores.means(totals, "tag"), "tag").first().medoid == 4


def test_jaccard_block_by_postings():
    rng = random.Random(1)
    a, b = ([[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))] for _ in range(n)] for n in (40, 25))
    a += [None, [], ["w1", "w1"]]
    got = block_scores.jaccard_block(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            x_, y_ = set(x or ()), set(y)
            assert got[i, j] == (len(x_ & y_) / len(x_ | y_) if x_ | y_ else 0)


@pytest.mark.parametrize("block", [2, 1024])
def test_between_takes_the_first_of_equal_bests(spark, block):
    items = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["x", "y"]), ("a", 2, ["q"]), ("b", 3, ["x"]), (None, 4, ["x"])], "tag string, id long, t array<string>")
    refs = spark.createDataFrame([("a", 30, ["x"]), ("a", 20, ["x"]), ("a", 10, ["z"]), ("c", 5, ["x"])], "tag string, ref long, t array<string>")
    got = {(r.tag, r.i): r for r in block_scores.between(items.where("not array_contains(t, 'q')"), refs, "tag", "id", "t", "ref", "t", block_scores.jaccard_block, block).collect()}
    assert got.keys() == {("a", 1), ("a", 2)}
    assert (got["a", 1].n, got["a", 1].sum, got["a", 1].best, got["a", 1].best_item) == (3, 2.0, 1.0, 20)
    assert block_scores.between(items.limit(0), refs, "tag", "id", "t", "ref", "t", block_scores.jaccard_block).count() == 0


def test_statuses_of_text_comparison(spark):
    pages = spark.createDataFrame([(1, "some words that are long enough", "a"), (2, "short", "a"), (3, None, "a"), (4, "some words that are long enough", "b"), (5, "some words that are long enough", "c")], "id long, text string, g string")
    refs = spark.createDataFrame([("a", 7, "some words  that are long enough too"), ("c", 8, "some words that are long enough"), ("b", 9, "tiny")], "g string, ref_id long, ref_text string")

    def scorer(a, b):
        out = block_scores.jaccard_block(a, b)
        return np.where(out == 1, np.inf, out)

    ask = lambda **kw: {r.id: r for r in families.reranked(pages, refs, "id", "text", "g", scorer, lambda c: F.split(c, " +"), **kw).collect()}
    got = ask()
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "unavailable_short_text", 3: "unavailable_short_text", 4: "unavailable_no_reference", 5: "error"}
    assert (got[1].best_ref, got[1].candidates, got[1].best_excerpt) == (7, 1, "some words that are long enough too")
    assert {r.status for r in ask(compare=False).values()} == {"disabled"}
