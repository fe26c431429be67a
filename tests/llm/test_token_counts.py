import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelore.llm.token_counts import Merger, default_vocabulary, op6_token_counts
from tests.llm.fixtures import frame, odd_rows, row


def test_like_the_library(spark):
    whole = Tokenizer.from_file(default_vocabulary())
    rows = odd_rows() + [row(50, "a<|endoftext|>b <|endoftext|><|endoftext|>"), row(51, "I'll  don't x 12345 \U0001f600!!?\n\n  end "), row(52, "z" * 5000), row(53, "x" + "abcd" * 400 + " " + "é" * 300 + " " * 700)]
    got = sorted((tuple(r) for r in op6_token_counts(frame(spark, rows, ("n_tokens", "n_bytes"))).collect()), key=str)
    count = [len(whole.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == sorted(((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, count, strict=True)), key=str)


def test_empty_table(spark):
    assert op6_token_counts(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abeinorst é", min_size=1, max_size=40), min_size=1, max_size=20))
def test_merging_of_any_strings(words):
    merger = Merger(default_vocabulary())
    bpe = Tokenizer.from_file(default_vocabulary()).model
    letters = dict(enumerate(__import__("pagelore.llm.token_counts", fromlist=["x"])._byte_letters()))
    assert merger.count_long([w.encode() for w in words]).tolist() == merger.count([w.encode() for w in words]).tolist()
    assert merger.count([w.encode() for w in words]).tolist() == [len(bpe.tokenize("".join(letters[b] for b in w.encode()))) for w in words]


def test_a_word_of_a_million_letters():
    rng = random.Random(1)
    word = "".join(rng.choice("ABCDabcdefghijklmnop") for _ in range(1_000_000))
    start = time.time()
    got = Merger(default_vocabulary()).count_long([word.encode()])
    assert time.time() - start < 60
    assert got.tolist() == [len(Tokenizer.from_file(default_vocabulary()).encode(word, add_special_tokens=False).ids)]
