import numpy as np
import pytest
import xxhash

from pagelore.llm.simhash import components, near_duplicates, one_of_each_group, op10_simhash
from tests.llm.fixtures import frame, odd_rows, row


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", names.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


@pytest.mark.parametrize("extra", [(), ("print", "first", "root", "node", "component_id", "member")])
def test_like_brute_force(spark, extra):
    got = sorted((tuple(r) for r in op10_simhash(frame(spark, extra=extra)).collect()), key=str)
    assert got == brute(odd_rows())


@pytest.mark.parametrize(("segments", "crowded"), [(2, 64), (2, 3), (4, 2), (4, 64)])
def test_links_at_two_bits_through_chains(spark, monkeypatch, segments, crowded):
    from pagelore.llm import simhash

    monkeypatch.setattr(simhash, "SEGMENTS", segments)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(1)
    values = {0, 3, 15, 63 << 56}
    for base in rng.integers(-(2**62), 2**62, 40).tolist():
        for _ in range(6):
            base ^= sum((1 << int(b)) - (1 << 64 if b == 63 else 0) for b in rng.choice(64, 2, replace=False))
            values.add(base)
    values = sorted(values)
    found = {tuple(r) for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "print long"))).collect()}
    mask = (1 << 64) - 1
    group = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & mask).bit_count() <= 2 and group[a] > group[b]:
                    group[a], changed = group[b], True
    linked = {v for v in values if any(v != w and ((v ^ w) & mask).bit_count() <= 2 for w in values)}
    assert found == {(v, group[v]) for v in linked}


def test_empty_table_and_kept_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    kept = one_of_each_group(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r[0] for r in brute(odd_rows()) if r[0] is not None and r[0] == r[2]})


def test_repeated_ids_and_other_columns(spark):
    p, q = "one two three four five six", "seven eight nine ten eleven"
    rows = [row(10, p), row(31, p), row(31, q), row(31, q), row(None, q), row(None, "twelve"), row(None, "twelve"), row(8, None), row(9, "")]
    docs = frame(spark, rows, ("PRINT", "copies", "Root"))
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(10, p), (31, q), (None, "twelve"), (8, None)], key=str)
