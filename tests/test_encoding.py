import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators import encoding, paradigm


def texts(spark):
    rows = [(i, " ".join(f"wört{(i * j) % 37} x{j}" for j in range(10 + i % 50)), f"k{i % 3}") for i in range(300)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "short", "a"), (903, "." * 60, "a"), (0, "twice " * 20, "b"), (0, "twice " * 20, "b")]
    return spark.createDataFrame(rows, "id int, text string, kind string").withColumn("a.b", F.lit(1)).repartition(4)


def fragile(folder, most):
    """An encoder that takes ``most`` texts at once and tells of every load and call."""

    def load():
        open(f"{folder}/load-{os.getpid()}-{len(os.listdir(folder))}", "w").close()
        whole = encoding.hash_counts()

        def encode(batch):
            if len(batch) > most:
                raise MemoryError
            return whole(batch)

        return encode

    return load


def test_backing_off_changes_no_vector(spark, tmp_path):
    docs = texts(spark)
    want = sorted((r.id, r.kind, tuple(np.round(r.vec, 12))) for r in paradigm.embed_covers(docs, "id", "text", carry=("kind",)).collect())
    for most in (1000, 5, 1):
        folder = tmp_path / str(most)
        folder.mkdir()
        out = encoding.encoded_covers(docs, "id", "text", fragile(str(folder), most), carry=("kind",)).collect()
        assert sorted((r.id, r.kind, tuple(np.round(r.vec, 12))) for r in out if max(r.vec) > 0) == want
        assert len(out) == len(want) + 1  # 903 has no token, so its vector is zero
        assert {r.batch_used for r in out} == {{1000: 32, 5: 4, 1: 1}[most]}
        assert 0 < len(os.listdir(folder)) <= 4


def test_what_an_encoder_may_not_do(spark, tmp_path):
    docs = texts(spark)
    with pytest.raises(Exception, match="MemoryError"):
        encoding.encoded(docs, "text", fragile(str(tmp_path), 0)).collect()
    for bad in (lambda: lambda b: np.zeros((len(b) - 1, 64)), lambda: lambda b: np.zeros((len(b), 3)), lambda: lambda b: np.full((len(b), 9), np.nan)):
        with pytest.raises(Exception, match="the encoder gave"):
            encoding.encoded(docs, "text", bad).collect()


def test_other_columns_and_empty_tables(spark):
    docs = texts(spark)
    out = encoding.encoded(docs, "text", encoding.hash_counts)
    assert out.columns == ["id", "kind", "a.b", "vec", "batch_used"] and out.count() == 306
    assert encoding.encoded(docs.limit(0), "text", encoding.hash_counts).count() == 0
    twice = paradigm.embed_covers(docs.where("id = 0 and kind = 'b'"), "id", "text").collect()
    assert len(twice) == 2  # repeated rows are rows each
