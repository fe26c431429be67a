"""Mixing sources to target weights by iterative proportional fitting of source, language and topic marginals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm.common import checkpointed

#: Margins and the power to which the token share of each of their values is raised (and made to sum to 1) as its target.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Probability at which documents of a cell that needs no correction are kept; seed of the draw.
KEEP, SEED = 0.5, "mix"
#: Raking ends when four sweeps' last one moved no rate by this or more, or after so many sweeps; sweeps between two tests.
TOLERANCE, MOST, STEP = 1e-6, 400, 4
#: Cells, by their count, up to which the sweeps of one test are one task without an exchange; more are spread by margin.
ONE_TASK = 100_000

#: Words whose notices make a document a "notice"; a fixed list.
NOTICE = ("copyright", "licen", "all rights reserved")
_WORDS = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """Kind of text: table rows, legal notices, contact data, none, or prose."""
    low = F.lower(text)
    notice = F.lit(False)
    for word in NOTICE:
        notice = notice | F.contains(low, F.lit(word))
    return (
        F.when(text.isNull() | (text == ""), "none")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(notice, "notice")
        .when(F.contains(text, F.lit("@")) | text.rlike("[0-9]{3}[-. ][0-9]{4}"), "contact")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``mix``: source, lang, topic, n_tokens. Nulls of a margin are the value "(none)"."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    size = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("n_tokens")
    return docs.withColumn("mix", F.struct(*filled, topic(F.col("text")).alias("topic"), size))


def raked(cells: DataFrame, keep: float = KEEP, targets: dict[str, float] | None = None, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """``cells`` (margins, tokens) with ``rate``, the fitted share of tokens over the share that a cell has, and ``sweeps``.

    Each step multiplies a cell by the target of its value of one margin over that value's present share, up to 1 / ``keep``
    of what the cell has: more can't be drawn, so the cells that are left make up for it in the sweeps that follow. Sweeps go
    on until they move nothing. A value wanted more than 1 / ``keep`` as much as it has can't be met and is taken whole; the
    margins are then as near to their targets as the last step leaves them. Cells are sums over documents, so their number
    follows the combinations of values; checkpoints cut the sweeps off from the first ones, and one number of each group of
    sweeps, the largest move, comes to the driver.
    """
    targets = targets or TARGETS
    cells = checkpointed(cells.where("tokens > 0"))
    total, count = cells.agg(F.sum("tokens"), F.count("*")).first()
    total, near = total or 1, (lambda df: df.coalesce(1)) if count <= ONE_TASK else (lambda df: df)
    cells = cells.withColumn("start", F.col("tokens") / F.lit(float(total))).withColumn("share", F.col("start"))
    wanted = {}
    for margin, power in targets.items():
        sums = cells.groupBy(margin).agg(F.sum("start").alias("had")).withColumn("raised", F.pow("had", F.lit(power)))
        whole = sums.agg(F.sum("raised")).first()[0] or 1.0
        wanted[margin] = sums.select(margin, (F.col("raised") / F.lit(whole)).alias(f"target_{margin}"))
    for margin, target in wanted.items():
        cells = cells.join(target, margin)
    cells, done = checkpointed(cells), 0
    while done < most:
        cells = near(cells)
        for _ in range(STEP):
            cells = cells.withColumn("old", F.col("share"))
            for margin in targets:
                now = F.sum("share").over(Window.partitionBy(margin))
                cells = cells.withColumn("share", F.least(F.col("share") * F.col(f"target_{margin}") / now, F.col("start") / F.lit(keep)))
        cells, done = checkpointed(cells), done + STEP
        if (cells.agg(F.max(F.abs(F.col("share") - F.col("old")) / F.col("start"))).first()[0] or 0.0) < tolerance:
            break
    return cells.select(*targets, "tokens", (F.col("share") / F.col("start")).alias("rate"), F.lit(done).alias("sweeps"))


def drawn(ids: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(ids.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed_in(docs: DataFrame, keep: float = KEEP, seed: str = SEED, targets: dict[str, float] | None = None, most: int = MOST) -> DataFrame:
    """``docs`` with the struct column ``mix``: source, lang, topic, n_tokens, rate, keep_prob, kept.

    A document is kept with probability ``keep`` times the rate of its cell, which raking holds to 1; equal ids are drawn
    alike, so repeated rows stay or go together. One without tokens (a null or empty text) has rate 0 and is not kept. Long
    texts are counted whole, an empty table gives an empty one, and columns of any other name stay, but ``mix`` is replaced.
    """
    held = described(docs)
    cells = held.groupBy("mix.source", "mix.lang", "mix.topic").agg(F.sum("mix.n_tokens").alias("tokens"))
    rates = raked(cells, keep, targets, most=most).select(F.struct("source", "lang", "topic").alias("cell_of_mix"), F.col("rate").alias("rate_of_mix"))
    out = held.withColumn("cell_of_mix", F.struct("mix.source", "mix.lang", "mix.topic")).join(rates, "cell_of_mix", "left")
    rate = F.when(F.col("mix.n_tokens") > 0, F.coalesce("rate_of_mix", F.lit(0.0))).otherwise(F.lit(0.0))
    chance = F.least(F.lit(1.0), F.lit(keep) * rate)
    full = F.struct("mix.source", "mix.lang", "mix.topic", "mix.n_tokens", rate.alias("rate"), chance.alias("keep_prob"), (drawn(F.col("doc_id"), seed) < chance).alias("kept"))
    return out.withColumn("mix", full).drop("cell_of_mix", "rate_of_mix")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the draw keeps; see ``mixed_in``. Columns other than the four that it reads may have any name."""
    names = docs.columns
    held = mixed_in(docs.toDF(*[n if n in ("doc_id", "text", "source", "lang") else f"extra{i}" for i, n in enumerate(names)]), **options)
    return held.where("mix.kept").drop("mix").toDF(*names)


def op7_mixing(docs: DataFrame) -> DataFrame:
    """Each document's margins, tokens, rate, probability and whether the draw keeps it."""
    held = mixed_in(docs.select("doc_id", "text", "source", "lang"))
    return held.select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", F.round("mix.rate", 6).alias("rate"), F.round("mix.keep_prob", 6).alias("keep_prob"), "mix.kept")


def oracle_sql(docs: str = "documents", keep: float = KEEP, seed: str = SEED, tolerance: float = TOLERANCE, most: int = MOST) -> str:
    """The same rows in DuckDB SQL; a recursion step is a sweep, with the same test for the last one."""
    notice = " or ".join(f"contains(lower(text), '{w}')" for w in NOTICE)
    targets = "".join(f", t_{m} as (select {m}, pow(sum(start), {p}) / sum(pow(sum(start), {p})) over () target_{m} from c group by {m})" for m, p in TARGETS.items())
    step, cell = "select *, share old from r where sweep < " + f"{most} and (sweep % {STEP} <> 0 or moved >= {tolerance})", "source, lang, topic, start, target_source, target_lang, target_topic, sweep"
    for margin in TARGETS:
        step = f"select {cell}, old, least(share * target_{margin} / sum(share) over (partition by {margin}), start / {keep}) share from ({step})"
    return f"""with recursive d as (select doc_id, coalesce(source, '(none)') source, coalesce(lang, '(none)') lang,
 case when text is null or text = '' then 'none' when contains(text, ' | ') then 'table' when {notice} then 'notice'
 when contains(text, '@') or regexp_matches(text, '[0-9]{{3}}[-. ][0-9]{{4}}') then 'contact' else 'prose' end topic,
 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint n_tokens from {docs}),
c0 as (select source, lang, topic, sum(n_tokens)::double tokens from d group by all having sum(n_tokens) > 0),
c as (select source, lang, topic, tokens / (select sum(tokens) from c0) start from c0){targets},
r as (select source, lang, topic, start, target_source, target_lang, target_topic, 0 sweep, start share, 1.0::double moved
 from c join t_source using (source) join t_lang using (lang) join t_topic using (topic)
 union all select {cell} + 1 sweep, share, max(abs(share - old) / start) over () moved from ({step})),
e as (select source, lang, topic, share / start rate from r where sweep = (select max(sweep) from r)),
x as (select d.*, case when n_tokens > 0 then coalesce(rate, 0) else 0 end rate from d left join e using (source, lang, topic))
select doc_id, source, lang, topic, n_tokens, round(rate, 6) rate, round(least(1.0, {keep} * rate), 6) keep_prob,
 ('0x' || md5(coalesce(doc_id::varchar, '') || ':{seed}')[1:8])::bigint / 4294967296.0 < least(1.0, {keep} * rate) kept from x"""
