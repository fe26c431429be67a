import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagelore.llm import language_model
from pagelore.llm.common import span_hashes
from pagelore.llm.language_model import op4_language_model, scored
from tests.llm.fixtures import frame, odd_rows, row


def rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    out = odd_rows()
    for i in range(120):
        word, text = "w0", []
        for _ in range(rng.randint(3, 60)):
            word = rng.choice(vocabulary) if rng.random() < 0.4 else f"w{(int(word[1:]) * 7 + 1) % 60}"
            text.append(word.upper() if rng.random() < 0.1 else word)
        out.append(row(500 + i, " ".join(text)))
    return out


def brute(docs, history=1 / 2000, weight=500.0):
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in docs]
    out = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 == 0 for r in docs]
    c, pair = Counter(), Counter()
    for t, held in zip(tokens, out, strict=True):
        if not held:
            c.update(t)
            pair.update(zip([None, *t], t))  # noqa: B905
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    want = []
    for r, t, held in zip(docs, tokens, out, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip([None, *t], t):  # noqa: B905
            below = max((c[w] or once) / (n + once), 0.5 / n)
            score += math.log10((pair[h, w] + weight * below) / (c[h] + weight) if c[h] >= max(1, history * n) else below)
        want.append((r[0], held, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return want, n, c, once


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_like_brute_force(spark, block):
    docs = rows()
    want, *_ = brute(docs, 1 / 100)
    got = [tuple(r) for r in scored(frame(spark, docs, ("blk", "score")), block=block, history=1 / 100).collect()]
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)
    held = [r for r in got if r[1] and r[0] and r[0] >= 500]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_probabilities_sum_to_one():
    docs = rows()
    _, n, c, once = brute(docs)
    below = [x / (n + once) for x in c.values()]
    assert sum(below) + once / (n + once) == pytest.approx(1)


def test_empty_table(spark):
    assert scored(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_every_history_of_two_words_is_a_state(spark, block):
    docs = rows() + [row(2000 + i, f"rare{i} next{i} last{i} w1") for i in range(400)] + [row(5001, "rare7 next7 last7"), row(5000 + 2, "next7 last7 w2")]
    tokens = {i: [*(r[1] or "").encode().lower().split(), None] for i, r in enumerate(docs)}
    c, pair, three = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if zlib.crc32(b"" if docs[i][0] is None else str(docs[i][0]).encode()) % 10:
            c.update(t)
            pair.update(zip([None, *t], t))  # noqa: B905
            three.update(zip([None, *t], t, t[1:]))  # noqa: B905
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    assert n > 4000  # a word seen once is less than 1/2000 of the tokens
    want = []
    for i, t in tokens.items():
        score = 0.0
        for k, w in enumerate(t):
            chance, h = max((c[w] or once) / (n + once), 0.5 / n), t[k - 1] if k else None
            if c[h]:
                chance = (pair[h, w] + 500 * chance) / (c[h] + 500)
            if k and pair[g := (t[k - 2] if k > 1 else None, h)]:
                chance = (three[*g, w] + 500 * chance) / (pair[g] + 500)
            score += math.log10(chance)
        want.append((str(docs[i][0]), len(t), score))
    got = op4_language_model(frame(spark, docs)) if block > 3000 else scored(frame(spark, docs), block=block, order=3)
    for a, b in zip(sorted((str(r[0]), r[2], r[6]) for r in got.collect()), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)


def test_chunks_of_the_same_documents(spark):
    docs = [row(i % 2, f"a b c{i % 2}") for i in range(8)]
    alone = {(r[0], r[6]) for r in scored(frame(spark, docs).coalesce(1), order=3).collect()}
    got = [(r[0], r[6]) for r in scored(frame(spark, docs).coalesce(1), block=14, order=3).collect()]
    assert len(got) == 8 and {(d, round(s, 9)) for d, s in got} == {(d, round(s, 9)) for d, s in alone}


def test_words_made_to_share_a_hash_are_told_apart(spark):
    one, other = b"a9cn3k6c!(!@@'!!", b"hye9ofrx9[<ta@[w"
    hashes = lambda key: [span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), key)[0] for w in (one, other)]
    assert len(set(hashes(0))) == 1 and all(len(set(hashes(k))) == 2 for k in range(1, 200))
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:1]
    docs = [row(i, one.decode()) for i in range(20) if i not in out] + [row(out[0], other.decode())]
    got = {r.doc_id: r for r in scored(frame(spark, docs), order=3).collect()}
    assert got[out[0]].n_known == 1 and {r.n_known for i, r in got.items() if i not in out} == {2}


def walked(docs, stretch, order=3):
    """Scores of ``docs`` as one chunk that is the whole corpus, and the automaton."""
    held = language_model.Tokens(pa.table({"doc_id": [r[0] for r in docs], "text": pa.array([r[1] for r in docs], pa.string())}), key=5)
    ngrams = [(numbers, place, np.bincount(numbers[numbers >= 0], weights=held.teaches[numbers >= 0], minlength=len(place)).astype(np.int64)) for numbers, place in language_model.numbered_ngrams(held, order)]
    count = ngrams[0][2]
    automaton = language_model.Automaton(iter(ngrams), order, held.first[1] - 1, int(count.sum()), int((count == 1).sum()))
    return automaton.walk(held, order, stretch), automaton


def test_a_stretch_comes_to_the_same_states():
    rng = random.Random(8)
    docs = rows() + [row(9000 + i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(500))) for i in range(3)]
    whole, _ = walked(docs, 1 << 20)
    for stretch in (1, 2, 7, 64):
        assert np.allclose(walked(docs, stretch)[0], whole, atol=1e-9)


def test_chances_of_a_state_sum_to_one():
    docs = [row(i, t) for i, t in enumerate(["a b a c", "b a", "c c b a", "a b b", "d a"] * 4)]
    _, automaton = walked(docs, 100)
    words, states = np.arange(automaton.symbols), len(automaton.fail_to)
    assert states > 10  # empty, words, pairs
    chances = [10 ** automaton.step(np.full(len(words), s), words)[1] for s in range(states)]
    held = 10 ** automaton.weight_of_word
    for c in chances:
        assert c.sum() == pytest.approx(held.sum())
