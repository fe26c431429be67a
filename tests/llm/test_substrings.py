import hashlib
import random

import numpy as np
import pytest

from pagelore.llm.substrings import deep_nodes, repeats_removed, without_repeats
from tests.llm.fixtures import frame, odd_rows, row


def words(text):
    return (text or "").encode().split()


def order_of(rows):
    return sorted(range(len(rows)), key=lambda i: -(2**63) if rows[i][0] is None else rows[i][0])


def brute_gone(rows, window):
    first: dict[tuple, list] = {}
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    for i in order_of(rows):
        w = words(rows[i][1])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), []).append((ids[i], i, s))
    gone = {i: set() for i in range(len(rows))}
    for key, places in first.items():
        least = min(d for d, _, _ in places)
        for d, i, s in places:
            if d > least or any(j == i and t < s for _, j, t in places):
                gone[i] |= set(range(s, s + window))
    return gone


def planted():
    rng = random.Random(8)
    rows = odd_rows()
    passage = [f"p{i}" for i in range(45)]
    for i in range(60):
        body = [f"x{rng.randrange(40)}" for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = passage[rng.randint(0, 15) : rng.randint(25, 45)]
        rows.append(row(200 + rng.randrange(90), " ".join(body)))
    rows.append(row(400, " ".join(["z"] * 70)))
    rows.append(row(150, "\n".join(passage)))
    return rows


@pytest.mark.parametrize(("window", "block", "places"), [(20, None, 256), (20, 4000, 1), (10, 2500, 256)])
def test_like_brute_force(spark, window, block, places):
    rows = planted()
    gone = brute_gone(rows, window)
    want = []
    for i, r in enumerate(rows):
        w = words(r[1])
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone[i])
        want.append((r[0], len(w), len(gone[i]), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in repeats_removed(frame(spark, rows, ("BLK", "part", "body")), window, block, places).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_texts_without_repeats(spark):
    rows = planted()
    docs = frame(spark, rows, ("BLK", "kind"))
    out = without_repeats(docs, block=4000)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    gone = brute_gone(rows, 20)
    want = [(r[0], [x for k, x in enumerate(words(r[1])) if k not in gone[i]]) for i, r in enumerate(rows) if not gone[i] or len(gone[i]) < len(words(r[1]))]
    got = out.collect()
    assert sorted(((r.doc_id, words(r.text)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None and r.n_chars is not None)
    assert repeats_removed(frame(spark, [])).count() == 0


def test_groups_of_any_size_find_the_same_nodes():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(0, 3, 400), np.full(30, 9), rng.integers(0, 3, 200)])
    at = np.arange(len(text) - 6)
    want = sorted(map(tuple, (np.flatnonzero([text[i : i + 6].tolist() == text[j : j + 6].tolist() for j in at]).tolist() for i in at)))
    for most in (5, 50, 10_000):
        suffix, node = deep_nodes(text, at, 6, most)
        groups = {}
        for s, n in zip(suffix.tolist(), node.tolist(), strict=True):
            groups.setdefault(n, []).append(s)
        assert sorted(tuple(sorted(groups[n])) for n, s in zip(node.tolist(), suffix.tolist(), strict=True)) == want


def test_long_words_that_differ_are_not_one(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [row(i, " ".join([f"w{k}" for k in range(12)] + [w] + [f"v{k}" for k in range(12)])) for i, w in enumerate((one, two))]
    assert [r.n_removed for r in repeats_removed(frame(spark, rows)).collect()] == [0, 0]
    assert sorted(r.n_removed for r in repeats_removed(frame(spark, rows + [row(7, rows[0][1].replace(" ", "\t"))])).collect()) == [0, 0, 25]


def test_a_text_far_longer_than_a_block_and_null_ids(spark):
    rng = random.Random(2)
    long = " ".join(f"q{rng.randrange(4000)}" for _ in range(300_000))
    rows = [row(1, long), row(2, "start " + long[1_000_003:1_001_003] + " end")] + [row(None, long[i * 1000 : i * 1000 + 900]) for i in range(9)]
    gone = brute_gone(rows, 20)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in repeats_removed(frame(spark, rows), block=2000).collect()), key=str)
    assert got == sorted(((r[0], len(words(r[1])), len(gone[i])) for i, r in enumerate(rows)), key=str)
