import hashlib
import random
import re

import pytest

from pagelore.llm.decontaminate import contamination, longest_matches, without_contaminated
from tests.llm.fixtures import frame, odd_rows, row

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items):
    out = []
    for d, text, *_ in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            for win in [v] if 0 < len(v) < 13 else [v[k : k + 13] for k in range(len(v) - 12)]:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add("" if i is None else str(i))
        named = ",".join(sorted(ids))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(named.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def planted():
    rows = odd_rows()
    rng = random.Random(3)
    body = lambda n: [rng.choice("alpha beta gamma delta épsilon 42 zeta eta".split()) for _ in range(n)]
    items = [(7, " ".join(body(40))), (12, " ".join(body(13)).upper()), (3, "Short, unusual item!"), (4, None), (None, " ".join(body(20))), (5, ""), (100, rows[8][1]), (7, " ".join(body(15)))]
    rows += [row(60, "x " * 30 + items[0][1].replace(" ", ", ") + " y" * 10), row(61, " ".join(items[0][1].split()[5:18])), row(62, "a short unusual item is here, short unusual item"), row(63, items[1][1] + " " + items[4][1])]
    rows += [row(64, "w " * 400 + items[1][1]), row(65, " ".join(items[0][1].split()[:12]))]
    return rows, items


@pytest.mark.parametrize("item_bytes", [8 << 20, 150, 40])
def test_like_brute_force(spark, item_bytes):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, rows, ("HITS", "match", "Items")), bench, item_bytes=item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)
    kept = without_contaminated(frame(spark, rows, ("HITS", "match", "Items")), bench, item_bytes=item_bytes)
    assert kept.columns == frame(spark, rows, ("HITS", "match", "Items")).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(rows, items) if not r[5]), key=str)


def test_longest_matches(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = {r[0]: words(r[1]) for r in rows if r[0] is not None}
    found = longest_matches(frame(spark, [r for r in rows if r[0] == 60]), bench).collect()
    assert any(r.item_id == "7" and r.item_word == 0 and r.doc_word == 30 and r.n_words == 40 for r in found)
    for r in found:
        assert any(words(t)[r.item_word : r.item_word + r.n_words] == text[r.doc_id][r.doc_word : r.doc_word + r.n_words] for i, t in items if str(i or "") == r.item_id)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(frame(spark, []), bench).count() == 0
    assert contamination(frame(spark), bench).where("contaminated or n_hit > 0").count() == 0


def test_long_words_that_differ_are_not_one(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    text = [" ".join([f"w{k}" for k in range(6)] + [w] + [f"v{k}" for k in range(6)]) for w in (one, two)]
    bench = spark.createDataFrame([(1, text[0])], "item_id long, text string")
    assert [r.n_hit for r in contamination(frame(spark, [row(1, text[1]), row(2, text[0])]), bench).orderBy("doc_id").collect()] == [0, 13]


def test_equal_windows_and_texts_above_a_piece(spark):
    items = [(1, "a " * 1500), (2, "a " * 20), (3, "b c d")]
    rows = [row(1, "a " * 100_000), row(2, "x " * 700_000 + "a " * 14), row(3, "e " * 30)]
    got = contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [(100_000, 100_000, 2), (700_014, 14, 2), (30, 0, 0)]
