import duckdb
import pandas as pd

from pagelore.llm import mixing
from tests.llm.fixtures import frame, odd_rows, row


def test_like_sql(spark):
    rows = odd_rows() + [row(70, "a | b | c"), row(71, "Copyright x"), row(72, "call 555-1234 now", None, None), row(73, "m@x.org", "de", "s9")]
    got = mixing.op7_mixing(frame(spark, rows)).toPandas()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(mixing.oracle_sql()).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype({"doc_id": "Int64"}).round(6).values.tolist()))
    assert key(got) == key(want)


def cells(spark):
    rows = [(a, b, c, 7 * i * i % 90 + 10) for i, (a, b, c) in enumerate((a, b, c) for a in "stu" for b in "xy" for c in "pq")]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def gaps(out):
    share = out.tokens * out.rate / out.tokens.sum()
    for margin, power in mixing.TARGETS.items():
        had = (out.groupby(margin).tokens.sum() / out.tokens.sum()) ** power
        yield (share.groupby(out[margin]).sum() - had / had.sum()).abs().max()


def test_margins_meet_their_targets_and_sweeps_end(spark):
    out = mixing.raked(cells(spark), tolerance=1e-9).toPandas()
    assert max(gaps(out)) < 1e-8 and out.sweeps.max() < mixing.MOST


def test_what_a_full_cell_cannot_give_others_do(spark):
    free = mixing.raked(cells(spark), keep=1e-6).toPandas()
    keep = 1 / (free.rate.max() * 0.9)  # the cell wanted most is over its bound
    assert (free.rate * keep).max() > 1
    out = mixing.raked(cells(spark), keep=keep, tolerance=1e-9).toPandas()
    assert (out.rate * keep).max() <= 1 + 1e-12 and max(gaps(out)) < 1e-7


def test_margins_of_the_drawn_sample(spark):
    rows = [row(i, " ".join(["w"] * (5 + i % 11)) + (" | x" if i % 5 == 0 else ""), "de" if i % 4 == 0 else "en", "hot" if i % 3 else f"s{i % 2}") for i in range(12000)]
    out = mixing.op7_mixing(frame(spark, rows)).toPandas()
    kept = out[out.kept]
    for margin, power in mixing.TARGETS.items():
        had = out.groupby(margin).n_tokens.sum() / out.n_tokens.sum()
        want = had**power / (had**power).sum()
        got = kept.groupby(margin).n_tokens.sum() / kept.n_tokens.sum()
        assert (got - want).abs().max() < 0.02 and (had - want).abs().max() > 0.02
    assert abs(kept.n_tokens.sum() / out.n_tokens.sum() - mixing.KEEP) < 0.02


def test_kept_rows_and_empty_table(spark):
    docs = frame(spark, extra=("mix", "tokens", "rate"))
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    want = mixing.op7_mixing(frame(spark)).where("kept").count()
    assert kept.count() == want
    assert mixing.op7_mixing(frame(spark, [])).count() == 0
