import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators import families, kmeans

FIELDS = ("a", "b.c")


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 0, *(rng.normal(size=2) + [(0, 0), (9, 0), (0, 9)][i % 3]).tolist(), f"text {i}") for i in range(240)]
    rows += [(1000 + i, 0, 1.0, 2.0, "copy") for i in range(20)]
    rows += [(2000 + i, 3, *rng.normal(size=2).tolist(), "other page") for i in range(30)] + [(3000, 5, 1.0, 1.0, "alone"), (3001, 0, None, 1.0, "no feature")]
    return rows, spark.createDataFrame(rows, "id long, page int, a double, `b.c` double, text string")


def brute(rows, ks, starts, rounds):
    x = np.array([r[2:4] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    out = {}
    for k in ks:
        ended = []
        for s in range(starts):
            c = np.zeros((0, 2))
            for t in range(k):
                u = [(int(hashlib.sha256(f"0:{s}:{t // 8}:{r[0]}".encode()).hexdigest()[8 * (t % 8) :][:8], 16) + 1) / 2**32 for r in rows]
                d = ((x[:, None] - c[None]) ** 2).sum(2).min(1) if t else np.ones(len(x))
                c = np.vstack((c, x[min(range(len(rows)), key=lambda i: (-np.log(u[i]) / d[i] if d[i] else np.inf, rows[i][0]))]))
            for _ in range(rounds):
                near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            ended.append((round(d.min(1).mean(), 9), s, d.min(1).sum(), d.argmin(1)))
        out[k] = min(ended, key=lambda e: e[:2])
    return out


def test_all_runs_at_once_against_a_loop(spark, pages):
    rows, df = pages
    of = [r for r in rows if r[1] == 0 and r[2] is not None]
    want = brute(of, range(2, 6), 4, 30)
    got = {r.k: r.inertia for r in kmeans.elbow(df.where("page = 0").repartition(5), FIELDS, "id", 2, 5, starts=4, rounds=30).collect()}
    assert got == pytest.approx({k: w[2] for k, w in want.items()})
    held, run, _, _ = kmeans.families(df.where("page = 0"), FIELDS, "id", 3, starts=4, rounds=30)
    found = {r.id: r.family for r in held.collect()}
    assert found == {r[0]: int(f) for r, f in zip(of, want[3][3], strict=True)} and run.start == want[3][1]
    assert len({tuple(found[i] for i in range(240) if i % 3 == g) for g in range(3)}) == 3


def test_rows_alike_and_too_few_rows(spark):
    same = spark.createDataFrame([(i, 2.0) for i in range(9)], "id long, a double")
    assert [(r.k, r.inertia) for r in kmeans.elbow(same, ("a",), "id", 2, 3, starts=2).collect()] == [(2, 0.0), (3, 0.0)]
    held, _, _, stds = kmeans.families(same, ("a",), "id", 3, starts=2)
    assert {(r.family, r.distance) for r in held.collect()} == {(0, 0.0)} and stds == [1.0]
    for rows in (same.limit(2), same.limit(0)):
        with pytest.raises(ValueError, match="fewer than 3"):
            kmeans.families(rows, ("a",), "id", 3, starts=2)


def test_the_stored_catalog_scores_pages(spark, pages, tmp_path):
    _, df = pages
    plain = df.withColumnRenamed("b.c", "b")
    path = str(tmp_path / "families")
    catalog = kmeans.write_family_catalog(plain, path, "id", "page", "text", ("a", "b"), (0, 3, 5), 3, starts=3, rounds=30)
    held = {r.page: r for r in catalog.collect()}
    assert set(held) == {0, 3}  # page 5 has one page only
    for r in held.values():
        assert sum(f.members for f in r.families) == (260 if r.page == 0 else 30)
        for f in r.families:
            assert len(f.examples) == min(5, f.members) and [e.rank for e in f.examples] == list(range(1, len(f.examples) + 1))
            assert f.examples[0].distance == pytest.approx(f.dist_min) and f.examples[0].excerpt
    scored = {r.id: r for r in families.page_scores(plain, kmeans.read_family_catalog(spark, path, ("a", "b")), "page", ("a", "b")).collect()}
    assert (scored[3000].status, scored[3001].status) == ("uncatalogued", "no_features")
    assigned, _, _, _ = kmeans.families(plain.where("page = 0"), ("a", "b"), "id", 3, starts=3, rounds=30)
    for r in assigned.collect():
        assert scored[r.id].family == str(r.family) and scored[r.id].distance == pytest.approx(r.distance)
        assert scored[r.id].confidence in ("high", "medium")
    with pytest.raises(ValueError, match="features"):
        kmeans.read_family_catalog(spark, path, ("b", "a"))


def test_fields_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def field(i):
        made.add(1)
        return float(i) if i != 5 else None

    rows, _, _ = kmeans.standard(spark.range(0, 40, 1, 4).select("id", field("id").alias("a")), ("a",), "id")
    assert rows.count() == 39 and made.value == 40  # with the filter on null fields below them they were made twice


def test_runs_at_rest_are_left_out_of_rounds(spark, pages, monkeypatch):
    rows, _, _ = kmeans.standard(pages[1].where("page = 0"), FIELDS, "id")
    want, sent, plain = {r.k: r for r in kmeans.lloyd(rows, (2, 3, 8), starts=4)}, [], kmeans._round
    monkeypatch.setattr(kmeans, "_round", lambda df, centers: sent.append(len(centers)) or plain(df, centers))
    got = kmeans.lloyd(rows, (2, 3, 8), starts=4)
    assert all(r.start == want[r.k].start and r.inertia == pytest.approx(want[r.k].inertia) for r in got)
    assert sent[0] == sent[-1] == 12 and sent[:-1] == sorted(sent[:-1], reverse=True) and sent[-2] < 12  # all in the last one, for its sums
