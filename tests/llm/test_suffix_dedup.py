import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm.induced_sort import common_prefixes, suffix_order
from pagelore.llm.suffix_dedup import bytes_removed, classes, spans
from tests.llm.fixtures import frame, odd_rows, row


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.sampled_from([3, 4 << 20]))
def test_suffix_order_and_common_prefixes(letters, memory):
    text = np.array(letters, np.uint8)
    order = suffix_order(text, 200, memory)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    got = common_prefixes(text + 1, order, 9)
    want = [next((k for k in range(9) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or a + k >= len(raw)), 9) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert got.tolist() == want


def test_long_runs_and_all_byte_values():
    text = np.concatenate((np.full(3000, 7, np.uint8), np.arange(256, dtype=np.uint8), np.full(3000, 7, np.uint8), np.arange(256, dtype=np.uint8)))
    begin, size = np.array([0, 3256]), np.array([3256, 3256])
    string, kind = classes(text, begin, size, 50)
    groups = {}
    for s, k in zip(string.tolist(), kind.tolist(), strict=True):
        groups.setdefault(text[s : s + 50].tobytes(), set()).add(k)
    assert len(string) == 2 * (3256 - 49) and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(kind.tolist()))


def planted():
    rng = random.Random(8)
    rows = odd_rows()
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    for i in range(60):
        body = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(5, 400)))
        if i % 3 == 0:
            body = body[:100] + passage[rng.randint(0, 120) : rng.randint(150, 300)] + body[100:]
        rows.append(row(200 + rng.randrange(90), body))
    rows += [row(400, "z" * 500), row(401, "z" * 120 + "y" * 60), row(150, passage)]
    return rows


def brute_gone(rows, length):
    least = {}
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    raw = [(r[1] or "").encode() for r in rows]
    for d, t in zip(ids, raw, strict=True):
        for s in range(len(t) - length + 1):
            key = t[s : s + length]
            least[key] = min(least.get(key, d), d)
    gone = []
    for d, t in zip(ids, raw, strict=True):
        flags = [False] * len(t)
        for s in range(len(t) - length + 1):
            if least[t[s : s + length]] < d:
                flags[s : s + length] = [True] * length
        gone.append(flags)
    return raw, gone


@pytest.mark.parametrize(("length", "block", "memory", "crowded"), [(50, None, 4 << 20, 256), (50, 6000, 2000, 1), (30, 3000, 4 << 20, 256)])
def test_like_brute_force(spark, length, block, memory, crowded):
    rows = planted()
    raw, gone = brute_gone(rows, length)
    want = []
    for r, t, g in zip(rows, raw, gone, strict=True):
        runs = sum(g[i] and (i == 0 or not g[i - 1]) for i in range(len(g)))
        want.append((r[0], len(t), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    got = [tuple(r) for r in bytes_removed(frame(spark, rows, ("blk", "body")), length, block, memory, crowded).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_spans_and_empty_table(spark):
    rows = [row(1, "q" * 10 + "abcdefghij" * 6), row(2, "x" + "abcdefghij" * 6 + "y")]
    assert [tuple(r) for r in spans(frame(spark, rows)).collect()] == [(2, 1, 61)]
    assert bytes_removed(frame(spark, [])).count() == 0
