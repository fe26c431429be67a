"""Small documents with the cases that every operator must bear."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def odd_rows():
    """Null, empty and blank texts, repeated rows, a null id, non-ASCII letters, a long text, near and exact copies."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiouéü" for c in ("n", "st", "rk", "ß")]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(12)]
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "Two words"), row(None, prose[0]), row(6, None, None, None)]
    rows += [row(10 + i, p, "fr" if i % 2 else "en", f"s{i % 3}") for i, p in enumerate(prose)]
    rows += [row(30, prose[0]), row(31, prose[1] + " tail"), row(31, prose[1] + " tail"), row(32, prose[2][:200] + " X " + prose[3]), row(33, prose[4] + "\n" + prose[4])]
    rows += [row(34, "aaaa" * 60), row(35, "ab" * 200), row(36, "ab" * 150 + "c"), row(40, "É" + prose[5].upper()), row(41, " ".join(prose) * 3)]
    return rows


def frame(spark, rows=None, extra=()):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'clash' as `{name}`")
    return df
