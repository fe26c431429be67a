"""k-means for all numbers of families and all starts at once: each round is one aggregation over the rows."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.text import excerpt
from pagelore.functions.vectors import distance
from pagelore.sources.store import stored

#: Rows that distances are worked out for at once; places of the mean squared distance by which runs are compared.
ROWS, PLACES = 4096, 9


class Run(NamedTuple):
    """A number of families, a start, the centers it ended with, their members, and the sum of squared distances."""

    k: int
    start: int
    centers: np.ndarray
    members: np.ndarray
    inertia: float


def standard(pages: DataFrame, fields: tuple[str, ...], key: str) -> tuple[DataFrame, list[float], list[float]]:
    """((key, z), means, deviations), stored: fields less their mean over the population deviation, which is taken as 1 where
    it is below 1e-9. Rows with a null field are left out, as they have no place."""
    # stored before the filter, which Spark would else move below the fields and work them out twice
    held = stored(pages.select(F.col(f"`{key}`").alias("key"), F.array(*(F.col(f"`{f}`").cast("double") for f in fields)).alias("v"))).where(~F.exists("v", lambda x: x.isNull()))
    stats = held.agg(*(f(F.col("v")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(fields)))).first()
    means, raw = (list(stats)[: len(fields)], list(stats)[len(fields) :])
    if means[0] is None:
        return held.select("key", F.col("v").alias("z")), [0.0] * len(fields), [1.0] * len(fields)
    stds = [1.0 if abs(s) < 1e-9 else s for s in raw]
    z = F.array(*((F.col("v")[i] - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(means, stds, strict=True))))
    return stored(held.select("key", z.alias("z"))), means, stds


def seeds(rows: DataFrame, most: int, starts: int, seed: int) -> list[np.ndarray]:
    """The first centers of each start, one after the other: a row is drawn with a probability in proportion to its squared
    distance from those that are there, the first one evenly.

    The draw is a race: of -ln(u) / squared distance the least wins, the least key of equals, where u comes from a digest of
    seed, start and key. All starts draw in the same pass; what meets is a row a partition and start.
    """
    chosen: list[list[list[float]]] = [[] for _ in range(starts)]
    for t in range(most):
        sent = rows.sparkSession.sparkContext.broadcast([np.array(c) for c in chosen])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, t=t) -> Iterator[pa.RecordBatch]:
            best: list[tuple | None] = [None] * starts
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                names, fields = [b"" if k is None else f":{k}".encode() for k in batch.column(2).to_pylist()], np.ascontiguousarray(x.T)
                for s in range(starts):
                    there = sent.value[s]
                    apart = assigned(fields, there)[1] if len(there) else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        race = np.where(apart > 0, -np.log(_drawn(f"{seed}:{s}:{t // 8}", names, t % 8)) / np.where(apart > 0, apart, 1), np.inf)
                    first = np.flatnonzero(race == race.min())
                    won = min(first.tolist(), key=lambda i: batch.column(0)[i].as_py()) if len(first) > 1 else int(first[0])
                    best[s] = _first(best[s], (float(race[won]), batch.column(0)[won].as_py(), x[won].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(best)], pa.binary())], ["best"])

        parts = rows.select("key", "z", F.col("key").cast("string").alias("name")).mapInArrow(run, "best binary")
        both = lambda a, b: [_first(p, q) for p, q in zip(a, b, strict=True)]
        found = parts.rdd.treeAggregate([None] * starts, lambda held, row: both(held, pickle.loads(row[0])), both, depth=2)
        if found[0] is None:
            return []
        for c, (_, _, z) in zip(chosen, found, strict=True):
            c.append(z)
    return [np.array(c) for c in chosen]


def _first(a: tuple | None, b: tuple | None) -> tuple | None:
    return a if b is None else b if a is None else min(a, b, key=lambda w: w[:2])


def _drawn(of: str, names: list[bytes], place: int) -> np.ndarray:
    """A number above 0 and up to 1 for each name: the 32 bits at ``place`` of the SHA-256 of ``of`` and the name."""
    first, digests = hashlib.sha256(of.encode()), []
    for name in names:
        held = first.copy()
        held.update(name)
        digests.append(held.digest())
    return (np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8)[:, place].astype(float) + 1) / 2.0**32


def assigned(fields: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest center, the first of equals; squared distance) of each row, terms added in order of the fields. ``fields``
    has a line for each field, so that each step runs over numbers that lie side by side."""
    best = np.zeros(fields.shape[1], np.intp)
    least = np.full(fields.shape[1], np.inf)
    for j, center in enumerate(centers):
        d = np.zeros(fields.shape[1])
        for values, at in zip(fields, center, strict=True):
            apart = values - at
            apart *= apart
            d += apart
        np.copyto(best, j, where=d < least)
        np.minimum(least, d, out=least)
    return best, least


def _added(a: list | None, b: list | None) -> list | None:
    return a if b is None else b if a is None else [tuple(x + y for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]


def _round(rows: DataFrame, centers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(sums, members, squared distances) for each set of centers, which are a few numbers sent to all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for lo in range(0, len(whole), ROWS):
                x, each = np.ascontiguousarray(whole[lo : lo + ROWS].T), []
                for c in sent.value:
                    best, d = assigned(x, c)
                    each.append((np.stack([np.bincount(best, values, len(c)) for values in x], 1), np.bincount(best, minlength=len(c)), float(d.sum())))
                total = _added(total, each)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["total"])

    parts = rows.select("z").mapInArrow(run, "total binary")
    return parts.rdd.treeAggregate(None, lambda held, row: _added(held, pickle.loads(row[0])), lambda a, b: b if a is None else _added(a, b), depth=2)


def lloyd(rows: DataFrame, ks: tuple[int, ...], starts: int = 10, rounds: int = 100, seed: int = 0) -> list[Run]:
    """The best run for each k over (key, z) rows: least mean squared distance to PLACES places, first start of equals.

    All k and starts move together, so a round reads the rows once; a run whose centers no longer move is at its end and
    left out of further rounds, of which there are ``rounds`` at most. A center that loses all its members stays where it is.
    Fewer rows than the largest k are an error.
    """
    if len(rows.limit(max(ks)).collect()) < max(ks):
        raise ValueError(f"fewer than {max(ks)} rows")
    first = seeds(rows, max(ks), starts, seed)
    runs = [(k, s) for k in ks for s in range(starts)]
    centers = [first[s][:k] for k, s in runs]
    going = list(range(len(runs)))
    for _ in range(rounds):
        for i, (sums, n, _) in zip(list(going), _round(rows, [centers[i] for i in going]), strict=True):
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers[i])
            if np.abs(moved - centers[i]).max() <= 1e-12:
                going.remove(i)
            centers[i] = moved
        if not going:
            break
    ended = [Run(k, s, c, n, d) for (k, s), c, (_, n, d) in zip(runs, centers, _round(rows, centers), strict=True)]
    return [min((r for r in ended if r.k == k), key=lambda r: (round(r.inertia / r.members.sum(), PLACES), r.start)) for k in ks]


def elbow(pages: DataFrame, fields: tuple[str, ...], key: str, k_min: int = 2, k_max: int = 8, **options) -> DataFrame:
    """(k, inertia) of the best run for each number of families."""
    rows, _, _ = standard(pages, fields, key)
    found = lloyd(rows, tuple(range(k_min, k_max + 1)), **options)
    return pages.sparkSession.createDataFrame([(r.k, float(r.inertia)) for r in found], "k int, inertia double")


def _nearest(z, centers: np.ndarray):
    """(squared distance, family) of the nearest center, from 0, the first of equals; the centers are literals."""
    each = F.array(*(F.struct(F.lit(0.0).alias("d"), F.lit(i).alias("family"), F.array(*(F.lit(float(v)) for v in c)).alias("c")) for i, c in enumerate(centers)))
    return F.array_sort(F.transform(each, lambda s: F.struct(distance(z, s["c"]).alias("distance"), s["family"].alias("family"))))[0]


def families(pages: DataFrame, fields: tuple[str, ...], key: str, k: int, **options) -> tuple[DataFrame, Run, list[float], list[float]]:
    """((key, family, distance), the run, means, deviations) of the best of all starts."""
    rows, means, stds = standard(pages, fields, key)
    run = lloyd(rows, (k,), **options)[0]
    near = rows.select(F.col("key").alias(key), _nearest(F.col("z"), run.centers).alias("n"))
    return near.select(key, "n.family", "n.distance"), run, means, stds


CATALOG = "page int, fields array<string>, k int, mean array<double>, std array<double>, families array<struct<family:string,centroid:array<double>,members:bigint,dist_min:double,dist_mean:double,dist_max:double,examples:array<struct<rank:int,doc:string,distance:double,excerpt:string>>>>"


def write_family_catalog(pages: DataFrame, path: str, key: str, page: str, text: str, fields: tuple[str, ...], numbers: tuple[int, ...], k: int, most: int = 5, **options) -> DataFrame:
    """Families of the stated page numbers, with their distances and closest examples (``most`` each, a report), written under
    ``path`` and read back as ``families.page_scores`` takes them. Page numbers without k pages have no row."""
    spark = pages.sparkSession
    for number in numbers:
        of = pages.where(F.col(page) == number)
        try:
            found, run, means, stds = families(of, fields, key, k, **options)
        except ValueError:
            continue
        found = stored(found)
        stats = found.groupBy("family").agg(F.count("*").alias("members"), F.min("distance").alias("dist_min"), F.avg("distance").alias("dist_mean"), F.max("distance").alias("dist_max"))
        rank = F.row_number().over(Window.partitionBy("family").orderBy("distance", key))
        close = found.withColumn("rank", rank).where(F.col("rank") <= most)
        shown = of.select(key, excerpt(F.col(text)).alias("excerpt")).join(F.broadcast(close), key)  # k * most rows
        listed = shown.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("doc"), "distance", "excerpt"))).alias("examples"))
        centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(run.centers)], "family int, centroid array<double>")
        each = centers.join(stats, "family", "left").join(listed, "family", "left").withColumn("members", F.coalesce("members", F.lit(0)))
        row = each.agg(F.array_sort(F.collect_list(F.struct(F.col("family").cast("string").alias("family"), "centroid", "members", "dist_min", "dist_mean", "dist_max", "examples"))).alias("families"))
        facts = [F.lit(number).alias("page"), F.array(*(F.lit(f) for f in fields)).alias("fields"), F.lit(k).alias("k"), *(F.array(*(F.lit(float(v)) for v in vs)).alias(n) for n, vs in (("mean", means), ("std", stds)))]
        row.select(*facts, "families").write.mode("append").parquet(path)
    return read_family_catalog(spark, path, fields)


def read_family_catalog(spark, path: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The stored catalog; an error if it was made of other features, or in another order."""
    held = spark.read.schema(CATALOG).parquet(path)
    other = held.where(F.col("fields") != F.array(*(F.lit(f) for f in fields or ()))).select("fields").first() if fields else None
    if other:
        raise ValueError(f"the catalog has the features {other.fields}, not {list(fields)}")
    return held
