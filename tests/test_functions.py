import math

from pyspark.sql import functions as F

from pagelore.functions import features, scores, text
from pagelore.functions.vectors import distance, norm, unit


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(column(*[F.col(n) for n in names]).alias("x")).first().x


def column_of(spark, kind, column, values):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(column(F.col("v")).alias("x")).collect()]


def test_white_space_and_null(spark):
    odd = "a\u001c\u0085  \u000b b​"
    assert column_of(spark, "string", text.normalized, [odd, None, " x 　y "]) == ["a b​", "", "x y"]
    assert column_of(spark, "string", text.row_status, [None, "x" * 40]) == ["skipped_short_text", "ok"]


def test_lines(spark):
    pages = ["", "\n", "a\nb\n", "a\r\nb", "a\n\n b\n \n"]
    f = lambda name: column_of(spark, "string", lambda c: features.page_features(c)[name], pages)
    assert f("line_count") == [0, 1, 2, 2, 4]
    assert f("empty_lines") == [0, 1, 0, 0, 2]


def test_tokens_tags_labels(spark):
    assert column_of(spark, "string", text.tokens, ["ÀÉ×÷ÿŒ İx 😀"]) == [["àé×÷ÿ", "i", "x"]]
    assert column_of(spark, "string", text.tag, [" Despacho Nº 1 ", "a__b--", "É"]) == ["despacho_n_1", "a_b--", None]
    assert column_of(spark, "string", text.strict_tag, ["A.b-1", "a b"]) == ["a.b-1", None]
    assert column_of(spark, "string", text.label, [" Não-Despacho!! __x 1 "]) == ["não-despacho_x_1"]
    assert column_of(spark, "string", text.slug, ["a b?.pdf", "??"]) == ["a_b_.pdf", "arquivo"]


def test_scores(spark):
    raw = [0.0, 0.5, -0.5, 3.0, -3.0, math.nan, math.inf, None, -1000.0]
    got = column_of(spark, "double", lambda c: F.round(scores.normalized_score(c), 6), raw)
    assert got == [0.0, 0.5, 0.25, 0.952574, 0.047426, None, None, None, 0.0]
    assert column_of(spark, "double", scores.status_from_ratio, [0.95, 0.85, 0.8499]) == ["ok", "warning", "poor"]
    conf = lambda d: scores.family_confidence(d, F.lit(1.0), F.lit(2.0))
    assert column_of(spark, "double", conf, [1.0, 1.5, 2.0, 2.1, None]) == ["high", "medium", "medium", "low_out_of_family", "unknown"]
    assert column_of(spark, "array<double>", lambda c: F.transform(scores.softmax(c), lambda x: F.round(x, 6)), [[0.0, 0.0], [1000.0, 0.0]]) == [[0.5, 0.5], [1.0, 0.0]]


def test_vectors(spark):
    assert column_of(spark, "array<double>", norm, [[3.0, 4.0]]) == [5.0]
    assert column_of(spark, "array<double>", unit, [[3.0, 4.0], [0.0, 0.0]]) == [[0.6, 0.8], [0.0, 0.0]]
    assert one(spark, distance, [0.0, 0.0], [3.0, 4.0]) == 5.0


def test_page_features_of_odd_characters(spark):
    texts = ["a\x1cb\x1d\x1e\n", " x 　\n\r\n", "İ K Ÿ\x85ß\x1f \xa0", "\x0b\x0c", "a​b᠎ c", "𝒳 é́", ""]
    held = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", *[c.alias(n) for n, c in features.page_features(F.col("t")).items()])
    want = held.sparkSession.createDataFrame([(i, t or "") for i, t in enumerate([*texts, None])], "i int, t string").select(
        "i", F.length("t"), F.size(text.tokens(F.col("t"))), F.regexp_count("t", F.lit(text.WHITESPACE)), F.size(F.filter(F.split("t", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), lambda x: F.regexp_replace(x, text.WHITESPACE, "") == ""))
    )
    got = [(r.i, r.chars, r.token_count, r.whitespace, r.empty_lines + (r.line_count == 0 or not t or t[-1:].splitlines() == [""])) for r, t in zip(held.orderBy("i").collect(), [*texts, None], strict=True)]
    assert got == [tuple(r) for r in want.orderBy("i").collect()]
