"""Toxic passages: all maximal scoring segments over token log-odds, judged by their extreme-value significance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.blocks import pack, unpack
from pagelore.llm.common import ALNUM, LOWER, checkpointed, crc32_of_id, pieces, span_hashes, word_bounds

#: Cells of the hashed counts of words and of word beginnings, bytes in a beginning, ranges the counts are summed in.
CELLS, STEM, RANGES = 1 << 18, 5, 64
#: Dirichlet weights, in tokens: of the even prior on a beginning, and of a beginning's odds on its words.
STEM_PRIOR, WORD_PRIOR = 2.0, 2.0
#: What a token costs, so that clean text drifts down; bounds of a token's score; least score of a reported segment.
COST, LOWEST, HIGHEST, FLOOR = 1.0, -4.0, 6.0, 2.0
#: Labelled rows that the classifier learns from, at most about, the seed by which they are chosen beyond that,
#: and the parts they are dealt to, of which each is calibrated by log-odds of the others.
TAUGHT, SEED, CROSS = 200_000, 7, 4
#: Width of the calibration bins of the log significance, and the e-value below which a passage is called significant.
BIN, SIGNIFICANT = 1.0, 0.05


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each word, cell of its beginning, and the rows' first words."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    cut = np.uint64(64 - (CELLS - 1).bit_length())
    return (span_hashes(data, starts, ends) >> cut).astype(np.int64), (span_hashes(data, starts, np.minimum(ends, starts + STEM)) >> cut).astype(np.int64), first


def class_counts(labelled: DataFrame, folds: int = 1) -> np.ndarray:
    """int64 counts [fold][toxic or not][beginning or word][cell] over the tokens of ``labelled`` (text, toxic, fold).

    Each partition sums its tokens into arrays of a fixed size; ranges of them are added up in tasks of their own. What
    the driver gets has that fixed size, however many texts and words there are.
    """
    wide = folds * 4 * CELLS // RANGES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((folds, 2, 2, CELLS), dtype=np.int64)
        for batch in batches:
            toxic, fold = batch.column("toxic").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch.column("text")):
                words, stems, first = _cells(data, offsets)
                kinds = fold[lo:hi] * 2 + (toxic[lo:hi] > 0)
                label = np.repeat(kinds, np.diff(first))
                for kind in np.unique(kinds).tolist():
                    for which, cells in enumerate((stems, words)):
                        counts[kind // 2, kind % 2, which] += np.bincount(cells[label == kind], minlength=CELLS)
        flat = counts.reshape(RANGES, wide)
        used = [i for i in range(RANGES) if flat[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pack(flat[i]) for i in used], pa.binary())], ["part", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(wide, dtype=np.int64)
        for b in rows.column("counts").to_pylist():
            total += unpack(b)[0]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([pack(total)], pa.binary())})

    summed = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), "fold").mapInArrow(gather, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    out = np.zeros((RANGES, wide), dtype=np.int64)
    for part, counts in summed.collect():
        out[part] = unpack(bytes(counts))[0]
    return out.reshape(folds, 2, 2, CELLS)


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of beginnings, counts of toxic and of clean words at equal class sizes): see ``token_scores``."""
    total = np.maximum(counts[:, 1].sum(axis=1), 1).astype(np.float64)
    even = counts * (total.min() / total)[:, None, None]
    stem = np.log((even[1, 0] + STEM_PRIOR / 2) / (even[0, 0] + STEM_PRIOR / 2))
    return stem.astype(np.float32), even[1, 1].astype(np.float32), even[0, 1].astype(np.float32)


def token_scores(words: np.ndarray, stems: np.ndarray, model: tuple) -> np.ndarray:
    """Log-odds of each token less its cost. A word's counts have a Dirichlet prior with the odds of its beginning."""
    stem, toxic, clean = model
    share = 1 / (1 + np.exp(-stem[stems]))
    odds = np.log((toxic[words] + WORD_PRIOR * share) / (clean[words] + WORD_PRIOR * (1 - share)))
    return np.clip(odds, LOWEST, HIGHEST) - np.float32(COST)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass from the left.

    A list of disjoint candidates is kept with the sums of all before their left and up to their right ends, and with the
    nearest candidate to the left that has a lower left sum. A new positive token joins back over candidates while that
    one has a lower right sum. Looking along those links skips what an earlier look has passed, so the scan is linear.
    Tokens that don't score are only summed, so the loop runs over the others.
    """
    up = np.flatnonzero(scores > 0)
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    lefts, rights = sums[up].tolist(), sums[up + 1].tolist()
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    lower: list[int] = []
    for i, low, high in zip(up.tolist(), lefts, rights, strict=True):
        begin, j = i, len(start) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= high:
                break
            begin, low = start[j], left[j]
            del start[j:], end[j:], left[j:], right[j:]
            j, _ = lower[j], lower.__delitem__(slice(j, None))
        start.append(begin)
        end.append(i + 1)
        left.append(low)
        right.append(high)
        lower.append(j)
    return [(a, b, r - m) for a, b, m, r in zip(start, end, left, right, strict=True)]


#: Bins of token scores, for the scale of the extreme-value law.
STEP = 0.05
STEPS = int(round((HIGHEST - LOWEST) / STEP)) + 1


def segments(docs: DataFrame, models: list[tuple], *more: str) -> DataFrame:
    """(doc_id, n_tokens, passages, scores, more) of each row: passages are its maximal segments of FLOOR or more (start,
    end, score), in tokens; with more than one model the column ``fold`` says which, and ``scores`` counts the scores of the
    tokens by steps, those of clean rows of a batch together. Null and empty texts have none."""
    sent, kinds = docs.sparkSession.sparkContext.broadcast(models), dict(docs.dtypes)
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ["doc_id", "n_tokens", "passages", "scores", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, held = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)]
            fold = batch.column("fold").to_numpy() if len(sent.value) > 1 else np.zeros(batch.num_rows, np.int64)
            clean = batch.column("toxic").to_numpy() == 0 if len(sent.value) > 1 else np.zeros(batch.num_rows, bool)
            steps = np.zeros(STEPS, np.int64)
            for lo, hi, data, offsets in pieces(batch.column("text")):
                words, stems, first = _cells(data, offsets)
                size[lo:hi] = np.diff(first)
                scores = np.empty(len(words), np.float32)
                of = np.repeat(fold[lo:hi], np.diff(first))
                for f in np.unique(fold[lo:hi]).tolist():
                    scores[of == f] = token_scores(words[of == f], stems[of == f], sent.value[f])
                if clean[lo:hi].any():
                    steps += np.bincount(np.rint((scores[np.repeat(clean[lo:hi], np.diff(first))] + COST - LOWEST) / STEP).astype(np.int64), minlength=STEPS)
                some = np.r_[0, np.cumsum(scores > 0)]
                for row in np.flatnonzero(some[first[1:]] > some[first[:-1]]).tolist():
                    part = scores[first[row] : first[row + 1]]
                    held[lo + row] = [{"start": a, "end": b, "score": s} for a, b, s in maximal_segments(part) if s >= FLOOR]
            counted = [steps.tolist()] + [[]] * (batch.num_rows - 1) if len(sent.value) > 1 else [[]] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(held, shape), pa.array(counted[: batch.num_rows], pa.list_(pa.int64())), *(batch.column(c) for c in more)], names)

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return held.mapInArrow(run, "doc_id long, n_tokens long, passages array<struct<start:long,end:long,score:double>>, scores array<long>" + "".join(f", {c} {kinds[c]}" for c in more))


def scale(steps: np.ndarray) -> float:
    """Of the extreme-value law of segment scores: the positive root of the mean of exp(scale * score) = 1 over the tokens
    of clean text, as counted in steps; 1, as for pure log-odds, if there are no such tokens or they don't drift down."""
    score = LOWEST - COST + STEP * np.arange(STEPS)
    share = steps / max(1, steps.sum())
    if (share * score).sum() >= 0 or not share[score > 0].any():
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * score)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * score)).sum() < 1 else (low, middle)
    return high


def significance(rate: float, scale: float) -> Column:
    """-log of the expected number of segments so good in clean text of that length: scale * score - log(rate * tokens).

    The best passage counts whole, each other one by half of what it has above the least score that is reported.
    """
    tokens = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
    best = F.array_max(F.transform("passages", lambda p: p["score"]))
    others = F.aggregate("passages", F.lit(0.0), lambda t, p: t + p["score"] - F.lit(FLOOR)) - (best - F.lit(FLOOR))
    return F.when(F.size("passages") > 0, F.lit(scale) * (best + others / 2) - F.log(F.lit(rate) * tokens)).otherwise(F.lit(-30.0))


def calibration(rows: list[tuple[float, int, int]]) -> tuple[list[float], list[float]]:
    """Places and probabilities of a rising line through (bin, clean, toxic) counts: pooled adjacent violators."""
    pools: list[list[float]] = []
    for place, clean, toxic in sorted(rows):
        pools.append([place, place, toxic + 0.1, clean + toxic + 0.2])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    at, chance = [], []
    for lo, hi, toxic, all_ in pools:
        for place in dict.fromkeys((lo, hi)):
            at.append(place)
            chance.append(toxic / all_)
    return at, chance


def line_through(x: Column, at: list[float], chance: list[float]) -> Column:
    """The calibrated probability, with a slight rise everywhere so that better scores never tie."""
    if not at:
        return F.lit(0.0) * x
    out = F.lit(chance[0])
    for (x0, y0), (x1, y1) in zip(zip(at, chance, strict=True), zip(at[1:], chance[1:], strict=True), strict=False):
        out = F.when(x >= x0, F.lit(y0) + (x - x0) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out) if x1 > x0 else out
    out = F.when(x >= at[-1], F.lit(chance[-1])).otherwise(out)
    rise = 1 / (1 + F.exp(-x / 50.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out * 0.999 + rise * 0.001))


def taught(labels: DataFrame, folds: int, most: int) -> DataFrame:
    """(id, toxic) of the labelled ids that teach: about ``most`` of them, those of the least hashes, or all if fewer.

    The sample has that bound at every size, so it is broadcast and no text is shuffled to its label.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    teach = checkpointed(marks.where(crc32_of_id("id") % folds != 0))
    share = most / max(1, teach.count())
    if share < 1:
        teach = teach.where(F.abs(F.xxhash64("id", F.lit(SEED))) < F.lit(int(share * 2.0**63)))
    return F.broadcast(teach)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = TAUGHT) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, passages) of each row of ``docs``.

    Learns from about ``most`` labelled rows whose crc32 of the id modulo ``folds`` is not 0; of several labels of an id
    the highest counts, rows with a null label or id teach nothing. The scale and rate of the extreme-value law and the
    calibration are fitted on rows of each of CROSS parts, as log-odds of the other parts score them. Passages have start,
    end (tokens), score and e-value. Empty and null texts get the score of a text without passages. Without any labels all
    scores are 0. Rows are scored one by one, whole however long, repeated ones alike; an empty table gives no rows, other
    columns of any name play no part.
    """
    teach = taught(labels, folds, most)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(CROSS)).cast("int").alias("fold")
    taught_by = held.join(teach, held["doc_id"] == teach["id"]).select("doc_id", "text", "toxic", fold)
    counts = class_counts(taught_by, CROSS)
    known = checkpointed(segments(taught_by, [log_odds(counts.sum(axis=0) - c) for c in counts], "toxic", "fold").drop("fold"))
    good, tokens, *steps = known.agg(F.sum(F.when(F.col("toxic") == 0, F.size("passages"))), F.sum(F.when(F.col("toxic") == 0, F.col("n_tokens"))), *(F.sum(F.get("scores", F.lit(i))) for i in range(STEPS))).first()
    law = scale(np.array([s or 0 for s in steps], dtype=np.float64))
    rate = (float(good or 0) + 0.5) / (float(tokens or 0) + 1.0) * float(np.exp(law * FLOOR))
    binned = known.select((F.floor(F.least(F.lit(60.0), significance(rate, law)) / BIN) * BIN).alias("bin"), "toxic")
    bins = binned.groupBy("bin").agg(F.sum(F.expr("int(toxic = 0)")), F.sum(F.expr("int(toxic > 0)"))).collect()
    at, chance = calibration([(float(b), int(c), int(t)) for b, c, t in bins])
    score = line_through(significance(rate, law), at, chance)
    told = F.transform("passages", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["score"].alias("score"), (F.lit(rate) * F.col("n_tokens") * F.exp(F.lit(-law) * p["score"])).alias("e_value")))
    found = segments(held, [log_odds(counts.sum(axis=0))])
    out = found.select("doc_id", (crc32_of_id() % folds == 0).alias("held_out"), score.alias("score"), "n_tokens", F.filter(told, lambda p: p["e_value"] <= SIGNIFICANT).alias("passages"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How likely each document is toxic, by its passages; see ``toxicity``."""
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
