"""What several operators of this subpackage share: Arrow text as numpy arrays, words, hashes, document blocks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bytes of text that numpy works on at once; a longer document is a piece of its own.
PIECE = 1 << 20
#: Bytes of text in a block of documents, the unit that a task holds whole.
BLOCK = 4 << 20

#: Lower-cases A-Z and nothing else, as a table over bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words parted by ASCII white space: all but 20 and 09-0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of alphanumeric words in lower-cased text: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def with_checkpoints(spark: SparkSession) -> None:
    """Leaves the folder of ``spark.checkpoint.dir`` as it is; sets one only where there is none, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


def small_or_shuffled(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``df``, checkpointed, to be joined with: broadcast if it is known to have ``most`` rows or fewer, else shuffled. For
    rows of a few numbers only."""
    held = checkpointed(df)
    return F.broadcast(held) if held.count() <= most else held


def give_back() -> None:
    """Hands freed memory back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the int64 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most ``most`` bytes, or of one longer row."""
    data, offsets = utf8(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of its first word (one more entry: all words)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    before[:-1], before[-1] = inside[1:], False
    ends = np.flatnonzero(inside & (~before | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = 0x9E3779B97F4A7C15
#: Spans longer than this are hashed one by one, with another function.
LONG = 256
#: For 0 to 8 bytes: the bits of a lane that hold them.
_HELD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit, and different inputs have different outputs."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (and from the end) as one number, zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, the same for the same bytes and key anywhere.

    Eight bytes at a time are mixed into the hash, not summed, so there are no families of spans of one hash; spans of one
    length of 8 bytes or less never share a hash. Longer ones may by chance: see ``numbered`` for an exact answer. The steps
    can be inverted, so who knows the key can make spans of one hash; with a secret one that is left to chance.
    """
    size = ends - starts
    out, held = mixed(size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64((_ODD + key) % (1 << 64))), lanes(data)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), (int(size[i]) & 0xFFFF) ^ key)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        out[live] = mixed((out[live] ^ (held[starts[live] + at] & _HELD[np.minimum(left, 8)])) * np.uint64(_ODD))
        live, at = live[left > 8], at + 8
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Flags of the spans whose bytes are those from ``other`` on, in ``data`` or in ``against``."""
    size, held = ends - starts, lanes(data)
    there = held if against is None else lanes(against)
    same, live, at = other + size <= len(there) - 1, np.arange(len(starts)), 0
    live = live[same & (size > 0)]
    while len(live) and at <= LONG:
        mask = _HELD[np.minimum(size[live] - at, 8)]
        equal = ((held[starts[live] + at] ^ there[other[live] + at]) & mask) == 0
        same[live[~equal]] = False
        live = live[equal]
        live, at = live[size[live] > at + 8], at + 8
    whole = data if against is None else against
    for i in live.tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], whole[other[i] : other[i] + size[i]])
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span, one span of each number): equal numbers if and only if the bytes are equal."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like = first[which]
    if ((ends - starts == ends[like] - starts[like]) & same_spans(data, starts, ends, starts[like])).all():
        return which, first
    known: dict[bytes, int] = {}
    spans = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    which = np.array([known.setdefault(s, len(known)) for s in spans], dtype=np.int64)
    return which, np.unique(which, return_index=True)[1]


def spans_of(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans end to end, and where each begins."""
    begin = np.cumsum(size) - size
    return data[np.arange(size.sum()) + np.repeat(at - begin, size)], begin


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive unit hashes, by doubling."""
    if len(units) < size:
        return np.zeros(0, np.uint64)
    have, done, at, n = units, None, 0, len(units) - size + 1
    width, left = 1, size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = have[at : at + n]
                done = part.copy() if done is None else done * np.uint64(pow(_ODD, width, 1 << 64)) + part
                at += width
            left >>= 1
            if left:
                have = have[:-width] * np.uint64(pow(_ODD, width, 1 << 64)) + have[width:]
                width *= 2
    return mixed(done)


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def starts_within(first: np.ndarray, size: int) -> np.ndarray:
    """Flags of the places in [0, first[-1]) from which ``size`` units stay inside one row; first: row bounds."""
    change = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(change, first[:-1], 1)
    np.add.at(change, np.maximum(first[:-1], first[1:] - size + 1), -1)
    return np.cumsum(change[:-1]) > 0


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - have : width - have + len(values) - width + 1])


def anchors(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """For each window start that ``valid`` flags, the place of its anchor: of the ``width`` grams that start in the
    window's first places, the one of the least hash, leftmost among equals. Equal windows have equal anchors.

    Returns -1 where a start isn't valid.
    """
    at = np.full(len(valid), -1, dtype=np.int64)
    if len(grams) < width:
        return at
    bits = np.uint64(max(1, len(grams).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_minimum(packed, width) & ((np.uint64(1) << bits) - np.uint64(1))
    n = min(len(valid), len(low))
    at[:n] = np.where(valid[:n], low[:n].astype(np.int64), -1)
    return at


class Blocks:
    """Blocks of documents in order of doc_id, of about ``block`` bytes of text each or of one longer document.

    Ids are put in order by ranges, with the bytes that each has, and cut where a block is full; the cuts, 16 bytes for
    each block, are what the driver holds. An id that has more than two blocks of text, as null may, is dealt over
    several blocks by its texts: rows of equal ids don't remove each other's text, so they needn't lie together.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK) -> None:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, room, last, total = [], 0, None, 0
            for batch in batches:
                for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if last is not None and room + size > block:
                        cuts.append((last, 1, room))
                        room = 0
                    room, last = room + size, name
                    if size > 2 * block:
                        cuts.append((name, size // block, size))
                        room, last = 0, None
            if last is not None:
                cuts.append((last, 1, room))
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cuts], pa.int64()) for i in range(3)], ["last", "pieces", "bytes"])

        sizes = docs.select(_id().alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
        sizes = sizes.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        # a document alone is never split
        sizes = sizes.select("id", F.when(F.col("n") > 1, F.col("size")).otherwise(F.least("size", F.lit(2 * block))).alias("size"))
        found = sorted(tuple(r) for r in sizes.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(cut, "last long, pieces long, bytes long").collect())
        self.last, pieces, size = (np.array([r[i] for r in found], dtype=np.int64) for i in range(3))
        self.first = np.r_[0, np.cumsum(pieces)]
        self.bytes = int(size.sum())

    def of(self, docs: DataFrame) -> Column:
        """The number of the block of each row."""
        if self.first[-1] < 2:
            return F.lit(0)
        sent = docs.sparkSession.sparkContext.broadcast((self.last, self.first))

        def place(ids: pd.Series, salt: pd.Series) -> pd.Series:
            last, first = sent.value
            at = np.searchsorted(last, ids.to_numpy(), "left")
            return pd.Series((first[at] + salt.to_numpy() % (first[at + 1] - first[at])).astype(np.int32))

        return pandas_udf(place, "int")(_id(), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)))


def _id() -> Column:
    """doc_id as a number, null first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def free_name(name: str, docs: DataFrame) -> str:
    """``name``, with underscores where ``docs`` has such a column in any case."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def plainly(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns called extra0, extra1, ..., and what gives a frame of these columns their names back:
    names with dots, or those of helper columns in any case, then meet nothing."""
    names = docs.columns
    return docs.toDF(*(n if n in keep else f"extra{i}" for i, n in enumerate(names))), lambda out: out.toDF(*names)


def grouped(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Splits sorted 64-bit hashes into ``parts`` ranges of hash space: (number, slice) of those that aren't empty."""
    edges = np.searchsorted(keys, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
    for i, (a, b) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True)):
        if b > a:
            yield i, slice(int(a), int(b))
