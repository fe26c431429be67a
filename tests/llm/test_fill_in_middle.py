import hashlib

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.llm import fill_in_middle as fim
from tests.llm.fixtures import frame, odd_rows, row


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha("<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]), sha(text))
    return (doc_id, n, "psm", a, b - a, sha("<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]), sha(text))


def test_query_against_brute_force(spark):
    rows = odd_rows() + [row(100 + i, t * (1 + i % 3)) for i, t in enumerate(["a<P>b", "<S>", "x <M", "<", "é☃😀\r\n\x00", "<P", "S>", "a b\x85"] * 8)]
    rows += [row(900, "long \n 😀" * 200_000), row(-5, "negative id")]
    out = fim.op13_fill_in_middle(frame(spark, rows, ("fim", "FORM", "a.b"))).collect()
    assert sorted(map(tuple, out), key=str) == sorted((brute(r[0], r[1]) for r in rows), key=str)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.op13_fill_in_middle(frame(spark, [])).collect() == []


def test_outputs_and_other_units(spark):
    rows = [row(i, f"one two  three, four {i} five") for i in range(60)]
    docs = frame(spark, rows, ("fim", "a.b"))
    out = fim.filled_in_middle(docs, unit=r"\S+\s*").collect()
    assert len(out[0]) == len(docs.columns) and out[0]["a.b"] == "clash"
    for r in out:
        assert fim.restored(r.fim.output, r.fim.form) == r.text and r.fim.n == 6
        if r.fim.form != "plain":
            assert r.fim.prefix_chars == 0 or regex.match(r"\S", r.text[r.fim.prefix_chars :] or "x")
    assert {r.fim.form for r in fim.filled_in_middle(docs, changed=0).collect()} == {"plain"}
    assert {r.fim.form for r in fim.filled_in_middle(docs, changed=100, suffix_first=100).collect()} == {"spm"}
    assert fim.filled_in_middle(docs.select(F.col("doc_id").alias("k"), F.col("text").alias("x.y")), text="x.y", doc="k").count() == 60


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM aé😀\n", max_size=30), st.integers(-3, 400))
def test_every_text_comes_back(text, doc_id):
    n, form, prefix, middle, output = fim.transformed(text, str(doc_id), regex.compile(fim.CODE_POINT))
    assert fim.restored(output, form) == text and n == len(text)
    assert (doc_id, n, form, prefix, middle, sha(output), sha(text)) == brute(doc_id, text)
