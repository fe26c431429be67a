"""Scores of all pairs of a key in blocks: a pair is never a row, and a hot key spreads over as many tasks as it has pairs
of blocks.

Items of a key are dealt to blocks of about ``block`` rows by a hash; each pair of blocks meets in one task, which gives of
each item the number, sum and best of its scores there. A scorer is a function of two lists of features that returns a
matrix of normalized scores, NaN where there is none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.scores import blended

BlockScorer = Callable[[pa.Array, pa.Array], np.ndarray]

#: Rows of a block. A task holds two; a key of n rows sends each row n / BLOCK times.
BLOCK = 1024


def _sizes(vectors: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def cosine_block(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Normalized products of unit vectors, as ``prototypes.cosine``; vectors that are null or of another length have none."""
    left, right = _sizes(a), _sizes(b)
    out = np.full((len(a), len(b)), np.nan)
    for size in np.intersect1d(left[left > 0], right[right > 0]):
        rows, columns = np.flatnonzero(left == size), np.flatnonzero(right == size)
        x, y = (pc.fill_null(v.take(pa.array(at)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size) for v, at in ((a, rows), (b, columns)))
        product = np.clip(x @ y.T, -1.0, 1.0)
        out[np.ix_(rows, columns)] = np.where(product < 0, (product + 1) / 2, product)
    return out


def jaccard_block(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard index of sets of tokens by an inverted index of ``b``: only postings of a row's own tokens are read."""
    postings: dict[str, list[int]] = {}
    sets = [set(t or ()) for t in b.to_pylist()]
    for j, tokens in enumerate(sets):
        for t in tokens:
            postings.setdefault(t, []).append(j)
    index = {t: np.array(at) for t, at in postings.items()}
    sizes, out = np.array([len(s) for s in sets]), np.zeros((len(a), len(b)))
    for i, tokens in enumerate(a.to_pylist()):
        mine = set(tokens or ())
        lists = [index[t] for t in mine if t in index]
        if lists:
            common = np.bincount(np.concatenate(lists), minlength=len(b))
            out[i] = common / (len(mine) + sizes - common)
    return out


def _tallied(rows: pa.Table, against: pa.Table, scores: np.ndarray, all_pairs: bool = True) -> pa.Table:
    """Per row: how many scores it has, their sum, the best and the first item that has it. Without ``all_pairs`` the
    scores of equal ids are left out of number and sum, not of the best."""
    names, others = rows.column("i"), against.column("i").combine_chunks()
    order = pc.sort_indices(others).to_numpy()
    scores = scores[:, order]
    known = np.isfinite(scores)
    ranked = np.where(known, scores, -np.inf)
    at = ranked.argmax(axis=1)
    none = pa.array(~known.any(axis=1))
    if not all_pairs:
        codes = pa.chunked_array([*names.chunks, others]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        known &= codes[: len(names), None] != codes[len(names) :][order][None, :]
    best = pc.if_else(none, None, pa.array(ranked[np.arange(len(at)), at]))
    item = pc.if_else(none, pa.scalar(None, others.type), others.take(pa.array(order[at])))
    return pa.table({"key": rows.column("key"), "i": names, "n": pa.array(known.sum(axis=1)), "sum": pa.array(np.where(known, scores, 0.0).sum(axis=1)), "best": best, "best_item": item})


def _dealt(rows: DataFrame, key: str, doc: str, feature: str, block: int) -> DataFrame:
    """(key, i, feature, blocks, mine): how many blocks the row's key has, and the number of the row's own."""
    held = rows.select(F.col(key).alias("key"), F.col(doc).alias("i"), F.col(feature).alias("feature")).where("key is not null")
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return held.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("i", "feature"), F.col("blocks")).cast("int"))


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _totals(parts: DataFrame, key: str) -> DataFrame:
    item = F.min_by("best_item", F.struct(F.coalesce(-F.col("best"), F.lit(float("inf"))), "best_item"))
    return parts.groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("best").alias("best"), item.alias("best_item")).withColumnRenamed("key", key)


def within(items: DataFrame, key: str, doc: str, feature: str, scorer: BlockScorer, all_pairs: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, i, n, sum, best, best_item) of each item over the items of its key: number and sum over those of other ids, or
    with ``all_pairs`` over its own too; the best always over its own too.

    ``scorer`` is symmetric, so a pair of blocks is scored once. A score that is missing counts as 0. Of equal bests the
    least id comes first. Rows without a key are no items; null ids are one id.
    """
    held = _dealt(items, key, doc, feature, block)
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "i", "feature", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def score(group: tuple, table: pa.Table) -> pa.Table:
        low, high = group[1].as_py(), group[2].as_py()
        a, b = (table.filter(pc.equal(table.column("mine"), x)) for x in (low, high))
        found = np.nan_to_num(scorer(a.column("feature").combine_chunks(), b.column("feature").combine_chunks()), nan=0.0)
        sides = [(a, b, found), (b, a, found.T)] if low != high else [(a, b, found)]
        done = [_tallied(*side, all_pairs) for side in sides if len(side[0]) and len(side[1])]
        return pa.concat_tables(done) if done else pa.table({n: pa.array([], t) for n, t in (("key", table.schema.field("key").type), ("i", table.schema.field("i").type), ("n", pa.int64()), ("sum", pa.float64()), ("best", pa.float64()), ("best_item", table.schema.field("i").type))})

    return _totals(met.groupBy("key", "low", "high").applyInArrow(score, f"key {_kind(held, 'key')}, i {_kind(held, 'i')}, n long, sum double, best double, best_item {_kind(held, 'i')}"), key)


def between(items: DataFrame, others: DataFrame, key: str, doc: str, feature: str, other_doc: str, other_feature: str, scorer: BlockScorer, block: int = BLOCK) -> DataFrame:
    """(key, i, n, sum, best, best_item) of each item over all ``others`` of its key; scores that are missing are left out.

    Items of a key that has no others give no row. Of equal bests the least id comes first.
    """
    left, right = _dealt(items, key, doc, feature, block), _dealt(others, key, other_doc, other_feature, block)
    blocks_of = lambda rows: rows.groupBy("key").agg(F.first("blocks").alias("there"))
    spread = lambda rows, there, mine, other: rows.join(blocks_of(there), "key").select("key", "i", "feature", F.col("mine").alias(mine), F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias(other))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], t) for n, t in (("key", a.schema.field("key").type), ("i", a.schema.field("i").type), ("n", pa.int64()), ("sum", pa.float64()), ("best", pa.float64()), ("best_item", b.schema.field("i").type))})
        return _tallied(a, b, scorer(a.column("feature").combine_chunks(), b.column("feature").combine_chunks()))

    at = ("key", "low", "high")
    met = spread(left, right, "low", "high").groupBy(*at).cogroup(spread(right, left, "high", "low").groupBy(*at))
    return _totals(met.applyInArrow(score, f"key {_kind(left, 'key')}, i {_kind(left, 'i')}, n long, sum double, best double, best_item {_kind(right, 'i')}"), key)


def means(totals: DataFrame, key: str) -> DataFrame:
    """(key, i, mean) of ``within``, to 12 places, so that equal items are equal whatever the order of their sums; single
    items of a key have none."""
    return totals.where("n > 0").select(key, "i", F.round(F.col("sum") / F.col("n"), 12).alias("mean"))


def blended_totals(totals: DataFrame, key: str) -> DataFrame:
    """(key, i, score_pct) of ``between``: the blend of the best and the mean score."""
    return totals.where("n > 0").select(key, "i", blended(F.col("best"), F.col("sum") / F.col("n")).alias("score_pct"))
