import random

import corpus_pipeline
from pagelore.llm import near_copies as near_copies_module
from pagelore.llm.near_copies import near_copies
from tests.llm.fixtures import frame, odd_rows, row


def rows():
    """Texts with a few words changed, some in chains, and many that share a common passage only."""
    rng = random.Random(11)
    out, passage = odd_rows(), [f"p{i}" for i in range(12)]
    for i in range(40):
        body = [f"v{rng.randrange(500)}" for _ in range(rng.randint(4, 120))] + passage * (i % 2)
        out.append(row(1000 + 10 * i, " ".join(body)))
        for j in range(1, rng.randint(1, 4)):
            for _ in range(rng.randint(1, 3)):
                body[rng.randrange(len(body))] = f"new{rng.randrange(50)}"
            out.append(row(1000 + 10 * i + j, " ".join(body).upper()))
    return out


def groups(docs):
    """A number for the group of each row, and how many pairs are close but not equal."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in docs]
    group, close = list(range(len(docs))), 0
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                close += sets[i] != sets[j]
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group, close


def brute(docs):
    group, close = groups(docs)
    assert close > 20
    names = {}
    for r, g in zip(docs, group, strict=True):
        if r[0] is not None:
            names[g] = min(names.get(g, r[0]), r[0])
    return sorted(((r[0], names.get(g)) for r, g in zip(docs, group, strict=True)), key=str)


def test_stage_finds_all_pairs_of_similarity_four_fifths(spark, tmp_path):
    docs = rows()
    want = brute(docs)
    assert sorted(((r.doc_id, r.component_id) for r in near_copies(frame(spark, docs)).collect()), key=str) == want
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame(spark, docs), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, c in want if d is not None and d == c)
    assert near_copies(frame(spark, [])).count() == 0


def test_variants_of_one_text_and_of_a_passage_make_few_pairs(spark, monkeypatch):
    """Copies of one text that are each changed elsewhere, unlike each other, and texts that share a passage: what is compared
    pair by pair grows with the texts, and no link is lost, in blocks of any size."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = [row(1, " ".join(base))]
    for i in range(2, 62):
        body = list(base)
        body[(at := rng.randrange(115)) : at + 5] = [f"c{i}", f"d{i}", f"e{i}", f"f{i}", f"g{i}"]
        docs.append(row(i, " ".join(body)))
    passage = [f"q{i}" for i in range(30)]
    docs += [row(i, " ".join([*passage, *(f"w{i}-{j}" for j in range(90 if i % 3 else 5))])) for i in range(100, 160)]
    compared = []
    whole = near_copies_module.verified
    monkeypatch.setattr(near_copies_module, "verified", lambda pairs, *a: compared.append(pairs.count()) or whole(pairs, *a))
    monkeypatch.setattr(near_copies_module, "BLOCK", 7)
    monkeypatch.setattr(near_copies_module, "SAMPLE", 1)  # no shingle is known to be common
    got = sorted(((r.doc_id, r.component_id) for r in near_copies(frame(spark, docs)).collect()), key=str)
    group = groups(docs)[0]
    assert got == sorted(((r[0], min(q[0] for q, g in zip(docs, group, strict=True) if g == mine)) for r, mine in zip(docs, group, strict=True)), key=str)
    assert sum(compared) <= 4 * len(docs)


def test_fingerprints_link_what_sets_confirm(spark, tmp_path, monkeypatch):
    long = [f"b{i}" for i in range(200)]
    docs = [row(1, " ".join(long * 10)), row(2, " ".join(long * 11)), row(3, "a a a a a a a a"), row(4, "a a a a"), row(5, None), row(6, "  ")]
    seen = []
    found = near_copies_module.fingerprint_links
    monkeypatch.setattr(near_copies_module, "fingerprint_links", lambda *a: seen.append(found(*a)) or seen[-1])
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame(spark, docs), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert seen[0].count() == 1  # 3 and 4 share a fingerprint, not a shingle of five words


def test_facts_of_texts_come_from_one_pass(spark, monkeypatch):
    """Fingerprints, sizes and parities are worked out once; what is read again are the texts of pairs."""
    made, told = [], near_copies_module.facts
    monkeypatch.setattr(near_copies_module, "facts", lambda docs, size: made.append(1) or told(docs, size))
    docs = rows()
    assert sorted(((r.doc_id, r.component_id) for r in near_copies(frame(spark, docs)).collect()), key=str) == brute(docs)
    assert len(made) == 1
    by_text = {}
    for r, f in zip(docs, told(frame(spark, docs).coalesce(1), 5).collect(), strict=True):
        words = (r[1] or "").encode().lower().split()
        assert f.doc_id == r[0] and f.n == (len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else 0)
        assert by_text.setdefault(tuple(words), (f.print, bytes(f.bits))) == (f.print, bytes(f.bits))
