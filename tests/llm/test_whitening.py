import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(count, size, seed=1):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(size, size))
    return [(i, [float(np.float32(x)) for x in rng.normal(size=size) @ mixing / 8], i % 3) for i in range(count)]


def brute(vectors, components=8):
    """Everything in whole numbers, fractions or one dense matrix."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return n, deviations, apart @ axes / np.sqrt(values), values / np.trace(apart.T @ apart / n)


def check(out, kept, components):
    n, deviations, scores, shares = brute([v for _, v, _ in kept], components)
    held = {}
    for r in out:
        held.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(held) == list(range(1, components + 1))
    for c, by_id in held.items():
        got = [by_id[i].pop() for i, _, _ in kept]
        assert all(not left for left in by_id.values())
        turn = np.sign(sum(r.whitened * s for r, s in zip(got, scores[:, c - 1], strict=True)))
        assert [r.whitened * turn for r in got] == pytest.approx(scores[:, c - 1].tolist(), abs=1e-9)
        assert [r.deviation for r in got] == deviations and {r.n for r in got} == {n}
        assert got[0].explained == pytest.approx(shares[c - 1], rel=1e-9) and got[0].identity_error < 1e-9


def test_query_against_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    good = [*rows_of(300, 12), (600, rows_of(1, 12, 3)[0][1], 0), (600, rows_of(1, 12, 3)[0][1], 0), (None, rows_of(1, 12, 4)[0][1], None)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 11 + [None], 1), (903, [0.0] * 11 + [nan], 1), (904, [-inf] + [0.0] * 11, 1)]
    out = whitening.op11_whitening(spark.createDataFrame(good + bad, SCHEMA).repartition(5)).collect()
    check(out, good, 8)


def test_few_dimensions_lengths_and_degenerate_vectors(spark):
    few = rows_of(40, 3)
    check(whitening.op11_whitening(spark.createDataFrame(few, SCHEMA)).collect(), few, 3)
    assert whitening.op11_whitening(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.op11_whitening(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    flat = [(i, [float(i), 5.0, 5.0], 0) for i in range(20)]
    out = whitening.op11_whitening(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in out} == {(1, False), (2, True), (3, True)}
    assert {r.identity_error < 1e-9 for r in out} == {True}
    one = whitening.op11_whitening(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, SCHEMA)).collect()
    assert {(r.component, r.whitened, r.explained, r.deviation) for r in one} == {(1, None, None, 0), (2, None, None, 0)} and len(one) == 6
    both = whitening.op11_whitening(spark.createDataFrame(few + [(100 + i, v, x) for i, v, x in rows_of(30, 5, 9)], SCHEMA)).collect()
    assert {(r.n, r.component) for r in both} == {(40, c) for c in (1, 2, 3)} | {(30, c) for c in (1, 2, 3, 4, 5)}


def test_numbers_beyond_a_long(spark):
    huge = spark.createDataFrame([(1, [1e300, 3.0]), (2, [-1e300, 4.0]), (3, [5.0, 1e9])], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in whitening.op11_whitening(huge).where("component = 1").collect()}
    assert len(out) == 3 and {r.deviation for r in out.values()} == {None} and all(math.isfinite(r.whitened) for r in out.values())
    x = np.array([[2**62, 5], [-(2**61), 7], [3, -(2**62)]])
    sums = whitening.exact_sums(x)
    assert sums == [2**62 - 2**61 + 3, 12 - 2**62]
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.exact_deviations(x, 3, sums) == want
    large = [(i, [float(i * 10**6), float(i)]) for i in range(2000)]
    out = whitening.op11_whitening(spark.createDataFrame(large, "vec_id long, embedding array<double>")).where("component = 1 and vec_id = 0").first()
    sums = [sum(math.floor(1024 * v[k]) + 100_000 for _, v in large) for k in (0, 1)]
    want = sum((2000 * 100_000 - s) ** 2 for s in sums)
    assert want > 2**63 and out.deviation is None and out.deviation_digits == Decimal(want)


def test_extra_columns_stay(spark):
    df = spark.createDataFrame(rows_of(30, 4), SCHEMA)
    for name in ("white", "vector_of_white", "put_white", "PUT_WHITE", "a.b", "v"):
        df = df.withColumn(name, F.lit("clash"))
    out = whitening.whitened(df)
    assert sorted(out.columns) == sorted(df.columns)
    row = out.first()
    assert row["a.b"] == row["PUT_WHITE"] == row["vector_of_white"] == "clash" and len(row["white"].components) == 4
