"""Stages bear extra columns of any name, and hot repeated rows."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from pagelore.llm import decontaminate, language, mixing, near_copies, simhash, substrings
from tests.llm.fixtures import frame, odd_rows, row

EXTRA = ("print", "copies", "id_of_copies", "print_of_copies", "PRINT_OF_COPIES_", "root", "member", "row", "count", "first", "block", "mix", "cell_of_mix", "match", "word", "a.b", "extra0", "extra1", "v")


@pytest.fixture(scope="module")
def model(spark):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language, "EPOCHS", 1)
        return language.trained(frame(spark))


def stages(spark, model):
    items = spark.createDataFrame([(1, " ".join(odd_rows()[8][1].split()[:20]))], "item_id long, text string")
    held = {
        "near_duplicates": partial(simhash.one_of_each_group, near=near_copies.near_copies, prints_of=near_copies.with_prints),
        "simhash": simhash.one_of_each_group,
        "substrings": substrings.without_repeats,
        "decontamination": lambda d: decontaminate.without_contaminated(d, items),
        "mixing": mixing.sampled,
        "language": lambda d: language.in_a_language(d, model, 0.0),
    }
    return held


def test_extra_columns_of_any_name_change_nothing(spark, model):
    plain, wide = frame(spark), frame(spark, extra=EXTRA)
    for name, stage in stages(spark, model).items():
        out = stage(wide)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert all(r[c] == "clash" for r in rows for c in EXTRA), name
        assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, map(tuple, stage(plain).collect()))), name


def test_a_hot_group_of_repeated_rows_leaves_one(spark):
    rows = [row(None, "")] * 3000 + [row(7, "the same words again and again here")] * 2000 + [row(8, "others are quite different from those")]
    docs = frame(spark, rows).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id").cast("string"))).withColumn("n", F.monotonically_increasing_id() % 2)
    out = simhash.one_of_each_group(docs.repartition(8)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, ""), (7, rows[3000][1]), (8, rows[-1][1])]
