import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm.toxicity import COST, LOWEST, STEP, STEPS, maximal_segments, op3_toxicity, scale, taught, toxicity
from tests.llm.fixtures import frame, odd_rows, row


def brute_segments(scores, lo=0, hi=None):
    """The segment of greatest score (shortest, then leftmost), then the same left and right of it."""
    hi = len(scores) if hi is None else hi
    best = None
    for a in range(lo, hi):
        for b in range(a + 1, hi + 1):
            key = (sum(scores[a:b]), -(b - a), -a)
            if key[0] > 0 and (best is None or key > best[0]):
                best = (key, a, b)
    if best is None:
        return []
    return [*brute_segments(scores, lo, best[1]), (best[1], best[2], best[0][0]), *brute_segments(scores, best[2], hi)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-6, 6).map(lambda x: x + 0.125 * (x % 3)), max_size=14), st.integers(0, 9))
def test_all_maximal_segments(scores, salt):
    scores = [s + (i * 37 % 101 + salt) / 1024 for i, s in enumerate(scores)]  # no ties
    got = maximal_segments(np.array(scores))
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def planted():
    rng = random.Random(2)
    plain, bad = [f"w{i}" for i in range(200)], ["grimble", "snorf", "vexo"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "", "ing"]))
        rows.append(row(1000 + i, " ".join(words)))
        labels.append((1000 + i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = planted()
    marks = spark.createDataFrame([*labels, (1, 0, None), (None, 1, 1), (1000, 1, 1)], "doc_id long, quality int, toxic int")
    out = op3_toxicity(frame(spark, rows + odd_rows(), ("score", "toxic", "id")), marks).collect()
    assert len(out) == len(rows) + len(odd_rows())
    truth = {d: t for d, _, t in labels}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert not any(r.predicted for r in out if r.doc_id is not None and r.doc_id < 1000)


def test_passages_and_no_labels(spark):
    rows, labels = planted()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity(frame(spark, [*rows, row(1, "w1 w2 w3 grimble snorf vexo w4 w5 " * 1)]), marks).where("doc_id = 1").first()
    assert [(p.start, p.end) for p in found.passages] == [(3, 6)]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in op3_toxicity(frame(spark), empty).collect()] == [0] * len(odd_rows())
    assert op3_toxicity(frame(spark, []), marks).count() == 0


def test_bounded_sample(spark):
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(4000)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    some, all_ = ({(r.id, r.toxic) for r in taught(marks, 5, most).collect()} for most in (500, 10_000))
    assert some < all_ == {(i, i % 2) for i in range(4000) if zlib.crc32(str(i).encode()) % 5}
    assert 400 < len(some) < 600


def test_scan_is_linear():
    scores = np.tile([1.0, -3.0], 1_000_000)
    start = time.time()
    assert len(maximal_segments(scores)) == 1_000_000
    rng = np.random.default_rng(1)
    maximal_segments(rng.normal(-0.1, 1, 4_000_000))
    assert time.time() - start < 60


def test_scale_of_the_extreme_value_law():
    rng = np.random.default_rng(3)
    steps = np.zeros(STEPS)
    steps[round((1 + COST - LOWEST) / STEP)], steps[round((-2 + COST - LOWEST) / STEP)] = 0.2, 0.8
    root = scale(steps)
    assert abs(0.2 * np.exp(root) + 0.8 * np.exp(-2 * root) - 1) < 1e-9
    best = []
    for _ in range(400):
        s = np.where(rng.random(2000) < 0.2, 1.0, -2.0)
        best.append(max(x[2] for x in maximal_segments(s)))
    expected = [-np.log(1 - np.mean(np.array(best) >= k)) for k in (5, 7)]  # number of segments so good
    assert abs(np.log(expected[0] / expected[1]) / 2 - root) < 0.25
    assert scale(np.zeros(STEPS)) == 1.0
