"""Whitening of embeddings: exact integer sums, a second pass of centred products, and a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of a vector's entry to one, and what is added to their number; components that are kept.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries that numpy works on at once; the depth of the tree in which partial sums meet.
ENTRIES, DEPTH = 1 << 20, 2
_LONG = np.iinfo(np.int64)


class Space(NamedTuple):
    """What the vectors of one length are projected with: their number, sums, eigenvalues and components (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float


def steps(entries: np.ndarray) -> np.ndarray:
    """Entries as numbers of steps, floor(SCALE * c) + SHIFT; those beyond the range of a long stay at its ends."""
    with np.errstate(over="ignore"):
        low = np.floor(SCALE * entries)
    held = np.clip(low, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(held > _LONG.max - SHIFT, _LONG.max, np.minimum(held, _LONG.max - SHIFT) + SHIFT)


def usable(column: pa.Array) -> np.ndarray:
    """Flags of the vectors that aren't null, have an entry and have neither null nor non-finite ones."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    bad = ~np.isfinite(pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    return (size > 0) & (np.diff(np.r_[0, np.cumsum(bad)][np.r_[0, np.cumsum(size)]]) == 0)


def matrices(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in steps, a row each) of the usable vectors, by length, at most ENTRIES entries at a time."""
    column = batch.column(at)
    rows = np.flatnonzero(usable(column))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(size[rows]).tolist():
        of = rows[size[rows] == length]
        most = max(1, ENTRIES // length)
        for lo in range(0, len(of), most):
            part = of[lo : lo + most]
            flat = pc.list_flatten(column.take(pa.array(part))).cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield part, steps(flat.reshape(len(part), length))


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns as whole numbers of any size: halves of 32 bits are summed apart."""
    high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
    return [(h << 32) + w for h, w in zip(high, low, strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in doubles: the whole part of the mean goes while all are whole numbers."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    if np.abs(x).max(initial=0) < 2**62 and max(map(abs, whole), default=0) < 2**62:
        return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest
    return (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64) - rest


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row, the sum over its entries of (n * x - sum) squared, as whole numbers of any size."""
    largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums))
    if largest < 2**62:
        y = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            return np.einsum("ij,ij->i", y, y).tolist()
        y = y.astype(object)
    else:
        y = n * x.astype(object) - np.array(sums, dtype=object)
    return (y * y).sum(1).tolist()


def _merged(parts: DataFrame, add) -> dict:
    """One value a vector length from the partial ones of all partitions, merged in a tree."""
    import pickle

    def seen(held: dict, row) -> dict:
        return both(held, pickle.loads(row[0]))

    def both(a: dict, b: dict) -> dict:
        for length, value in b.items():
            a[length] = add(a[length], value) if length in a else value
        return a

    return parts.rdd.treeAggregate({}, seen, both, depth=DEPTH)


def _partials(vectors: DataFrame, of, add) -> DataFrame:
    """A row a partition: ``of(length, x)`` of its vectors, added up by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        held: dict = {}
        for batch in batches:
            for _, x in matrices(batch):
                value = of(x.shape[1], x)
                held[x.shape[1]] = add(held[x.shape[1]], value) if x.shape[1] in held else value
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["held"])

    return vectors.mapInArrow(run, "held binary")


def _spread_of(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of centred products)."""
    mean = w.mean(0)
    apart = w - mean
    return len(w), mean, apart.T @ apart


def _spreads_added(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fitted(df: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each vector length: three scans of one column, from which the driver gets length squared numbers.

    The first sums the steps exactly; the second sums products of what is left of them by the mean; symmetric eigenvectors
    follow. The third measures how far the covariance of the whitened vectors is from the identity.
    """
    vectors, sc = df.select(F.col(f"`{vec}`").cast("array<double>").alias("v")), df.sparkSession.sparkContext

    def sums_added(a: tuple, b: tuple) -> tuple[int, list[int]]:
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]

    totals = _merged(_partials(vectors, lambda _, x: (len(x), exact_sums(x)), sums_added), sums_added)
    if not totals:
        return {}
    sent = sc.broadcast(totals)

    def products(length: int, x: np.ndarray) -> np.ndarray:
        apart = centred(x, *sent.value[length])
        return apart.T @ apart

    outer = _merged(_partials(vectors, products, np.add), np.add)
    spaces = {}
    for length, (n, sums) in totals.items():
        cov = outer[length] / n
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        most = min(components, length)
        spaces[length] = Space(n, sums, values[::-1][:most].copy(), axes[:, ::-1][:, :most].copy(), float(np.trace(cov)), 0.0)
    sent = sc.broadcast(spaces)

    def whitened_spread(length: int, x: np.ndarray) -> tuple:
        return _spread_of(_projected(x, sent.value[length], kept_only=True))

    measured = _merged(_partials(vectors, whitened_spread, _spreads_added), _spreads_added)
    return {k: s._replace(error=float(np.abs(measured[k][2] / measured[k][0] - np.eye(len(measured[k][1]))).max(initial=0.0))) for k, s in spaces.items()}


def _kept(space: Space) -> np.ndarray:
    """Flags of the components along which the vectors differ by more than rounding."""
    return space.values > max(space.trace, 0.0) * len(space.sums) * np.finfo(float).eps


def _projected(x: np.ndarray, space: Space, kept_only: bool = False) -> np.ndarray:
    kept = _kept(space)
    scores = centred(x, space.n, space.sums) @ space.axes[:, kept] / np.sqrt(space.values[kept])
    if kept_only:
        return scores
    out = np.full((len(x), len(kept)), np.nan)
    out[:, kept] = scores
    return out


def whitened(df: DataFrame, vec: str = "embedding", components: int = COMPONENTS, name: str = "white") -> DataFrame:
    """The rows of ``df`` whose vector is usable, with the struct column ``name``: n, deviation, identity_error and the array
    components of (component, whitened, explained).

    Usable are vectors that aren't null or empty and have no null or non-finite entry. Vectors of each length are fitted
    on their own, repeated rows as often as they are there. Entries of equal eigenvalues may be turned within their space.
    A component without variance (all vectors alike, say, or just one) has null as its whitened value and is left out of
    identity_error; explained is null where no component has any. deviation is a decimal of 38 digits,
    null where it has more. An empty table, or
    one without a usable vector, gives no rows. All other columns stay as they are, null ids included; one that is called
    like the new column is replaced by it.
    """
    spaces = fitted(df, vec, components)
    sent = df.sparkSession.sparkContext.broadcast(spaces)
    parts = "array<struct<component:int,whitened:double,explained:double>>"
    held = df.drop(name) if name != vec else df
    names = [n for n in held.columns if name != vec or n != vec]
    # numbers stand for names, which may have dots
    held = held.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), F.col(f"`{vec}`").cast("array<double>").alias("v"))
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("white", T._parse_datatype_string(f"struct<n:bigint,deviation:decimal(38,0),identity_error:double,components:{parts}>"))])
    place = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())])
        for batch in batches:
            for rows, x in matrices(batch, place):
                space = sent.value[x.shape[1]]
                scores, count = _projected(x, space), len(space.values)
                shares = space.values / space.trace if space.trace > 0 else np.full(count, np.nan)
                flat = pa.StructArray.from_arrays(
                    [pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(scores.ravel(), from_pandas=True), pa.array(np.tile(shares, len(x)), from_pandas=True)], fields=list(each)
                )
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * count), flat)
                deviation = pa.array([Decimal(d) if d < 10**38 else None for d in exact_deviations(x, space.n, space.sums)], pa.decimal128(38, 0))
                white = pa.StructArray.from_arrays(
                    [pa.array(np.full(len(x), space.n, np.int64)), deviation, pa.array(np.full(len(x), space.error)), lists], ["n", "deviation", "identity_error", "components"]
                )
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns[:-1], white], schema.names)

    return held.mapInArrow(run, schema).toDF(*names, name)


def op11_whitening(embeddings: DataFrame) -> DataFrame:
    """Per usable vector and component: see ``whitened``. deviation is null where it is beyond a long, which
    deviation_digits, a decimal of 38 digits, is not."""
    held = whitened(embeddings.select("vec_id", "embedding")).select("vec_id", "white.n", "white.deviation", "white.identity_error", F.explode("white.components").alias("c"))
    digits = F.col("deviation")
    long = F.when(digits <= F.lit(2**63 - 1).cast("decimal(38,0)"), digits.cast("long"))
    return held.select("vec_id", "c.component", "n", long.alias("deviation"), "c.whitened", "c.explained", "identity_error", digits.alias("deviation_digits"))
