"""Benchmark decontamination: suffix arrays of training shards, searched for every suffix of the benchmark's items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.llm.common import ALNUM, LOWER, checkpointed, free_name, numbered, pieces, plainly, same_spans, span_hashes, utf8, word_bounds

#: Words in a window; bytes of benchmark text that one pass over the training text searches for; share of words hit;
#: passes between which what was found is written, so that no more of them are in memory at once.
WINDOW, ITEM_BYTES, SHARE, PASSES = 13, 8 << 20, 20, 4


class Items:
    """Benchmark items as numbers of their own words, with their suffixes and windows. Words are numbered from 1.

    Windows of the same words are searched for once; those with the same items share a set of items.
    """

    def __init__(self, rows: list[tuple[str, str]], window: int) -> None:
        self.ids = [i for i, _ in rows]
        data, offsets = utf8(pa.array([t for _, t in rows], pa.large_string()))
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, ALNUM)
        number, one = numbered(data, starts, ends)
        self.text, self.starts, self.ends = data, starts[one], ends[one]  # of each number
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.by_hash = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[self.by_hash]
        self.words = number + 1
        size = np.diff(first)
        self.item = np.repeat(np.arange(len(rows)), size)
        self.start = np.arange(len(number)) - first[self.item]
        self.rest = first[self.item + 1] - np.arange(len(number))
        windows = np.flatnonzero((self.rest >= window) | (self.start == 0))
        lengths = np.minimum(self.rest[windows], window)
        self.shortest = int(lengths.min()) if len(windows) else 0
        self.longest = int(size.max()) if len(size) else 0
        # equal windows, by their words, zeros after the shorter ones
        padded = np.append(self.words, np.zeros(window, np.int64))
        table = np.where(np.arange(window) < lengths[:, None], padded[windows[:, None] + np.arange(window)], 0)
        _, one, kind = np.unique(table, axis=0, return_index=True, return_inverse=True) if len(windows) else (None, windows, windows)
        self.window_at, self.window_len = windows[one], lengths[one]
        held: dict[int, set[int]] = {}
        for k, item in zip(kind.ravel().tolist(), self.item[windows].tolist(), strict=True):
            held.setdefault(k, set()).add(item)
        sets: dict[frozenset[int], int] = {}
        self.set_of = np.array([sets.setdefault(frozenset(held[k]), len(sets)) for k in range(len(one))], dtype=np.int64)
        self.sets = [{self.ids[i] for i in s} for s in sets]

    def numbers_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word of a text, 0 for those that no item has; words are compared by their bytes."""
        hashes, out = span_hashes(data, starts, ends), np.zeros(len(starts), np.int64)
        if not len(self.hashes):
            return out
        at = np.searchsorted(self.hashes, hashes)
        while True:  # once, but for words of one hash
            at = np.minimum(at, len(self.hashes) - 1)
            alike = np.flatnonzero((self.hashes[at] == hashes) & (out == 0))
            word = self.by_hash[at[alike]]
            equal = self.ends[word] - self.starts[word] == ends[alike] - starts[alike]
            equal &= same_spans(data, starts[alike], ends[alike], self.starts[word], self.text)
            out[alike[equal]] = word[equal] + 1
            more = alike[~equal]
            more = more[at[more] + 1 < len(self.hashes)]
            if not len(more) or not (self.hashes[at[more] + 1] == hashes[more]).any():
                return out
            at[more] += 1


class SuffixArray:
    """Suffixes of a shard's words that could match: ``words`` are numbers, 0 matches nothing. Sorted to ``depth`` words
    by doubling, so that a query of up to that many words finds all its places as one range."""

    def __init__(self, words: np.ndarray, depth: int) -> None:
        rank, k = words, 1
        while k < depth:
            later = np.zeros(len(rank), dtype=np.int64)
            later[: len(rank) - k] = rank[k:] + 1
            pair = rank * (len(rank) + int(rank.max(initial=0)) + 2) + later
            found, rank = np.unique(pair, return_inverse=True)
            k *= 2
            if len(found) == len(rank):
                break
        order = np.argsort(rank, kind="stable")
        self.order = order[words[order] > 0]
        self.words = np.append(words, np.zeros(depth + 1, dtype=words.dtype))

    def compare(self, rank: np.ndarray, query: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of the suffixes at ``rank`` against queries ``query[at : at + size]`` as prefixes, and the common length."""
        sign, common = np.zeros(len(rank), np.int8), np.zeros(len(rank), np.int64)
        place, live, k = self.order[rank], np.arange(len(rank)), 0
        while len(live := live[size[live] > k]):
            here, there = self.words[place[live] + k], query[at[live] + k]
            sign[live] = np.sign(here - there)
            live = live[here == there]
            k += 1
            common[live] = k
        return sign, common

    def bound(self, query: np.ndarray, at: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """By binary search, of all queries at once: the first rank not below the query, or above all it prefixes."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            sign, _ = self.compare(mid, query, at[open_], size[open_])
            right = sign <= 0 if upper else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    def longest(self, query: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of each query's longest prefix in the shard, one place of it, and the first rank not below the query."""
        rank = self.bound(query, at, size, upper=False)
        best, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for near in (rank, rank - 1):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            _, common = self.compare(near[ok], query, at[ok], size[ok])
            more = common > best[ok]
            best[ok[more]], place[ok[more]] = common[more], self.order[near[ok[more]]]
        return best, place, rank


class Shard:
    """The words of a piece of training text, those runs of them that could hold a window, and their suffix array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, items: Items) -> None:
        data = LOWER[data]
        starts, ends, self.first = word_bounds(data, offsets, ALNUM)
        number = items.numbers_of(data, starts, ends)
        known = number > 0
        # runs of known words within a document, at least as long as the shortest window
        cut = np.zeros(len(number) + 1, dtype=bool)
        cut[self.first] = True
        begin = np.flatnonzero(known & (~np.r_[False, known[:-1]] | cut[:-1])) if len(number) else np.zeros(0, np.int64)
        end = np.flatnonzero(known & (~np.r_[known[1:], False] | cut[1:])) + 1 if len(number) else np.zeros(0, np.int64)
        long = end - begin >= max(1, items.shortest)
        begin, end = begin[long], end[long]
        size = end - begin + 1  # each run ends in a 0
        self.place = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        words = np.zeros(len(self.place), dtype=np.int64)
        keep = np.ones(len(words), dtype=bool)
        keep[np.cumsum(size) - 1] = False
        words[keep] = number[self.place[keep]]
        self.suffixes = SuffixArray(words, max(1, items.longest)) if len(words) else None

    def document(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, "right") - 1

    def windows(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, set of items) of each place where a window occurs: of the suffixes that begin with windows
        the longest matches are searched for, and where they are whole windows, the range of all their places."""
        none = np.zeros(0, np.int64)
        if self.suffixes is None or not len(items.window_at):
            return none, none, none
        best, _, lo = self.suffixes.longest(items.words, items.window_at, items.window_len)
        found = np.flatnonzero(best == items.window_len)
        count = self.suffixes.bound(items.words, items.window_at[found], items.window_len[found], upper=True) - lo[found]
        which = found[np.repeat(np.arange(len(count)), count)]
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        return self.place[self.suffixes.order[rank]], items.window_len[which], items.set_of[which]


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``most`` bytes; only one block at a time comes to the driver."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // most) + 1
    for i in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i) if count > 1 else rows
        yield Items(sorted(tuple(r) for r in part.collect()), window)


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: a struct of ``words`` and those ``hit``, their numbers; the
    sorted ids of the ``items`` that have windows there; and ``flags`` of the words hit, packed eight to a byte.

    Each block of the benchmark is one map over the documents, so nothing is shuffled, whatever the size of either table.
    A null item id counts as the empty id; equal ids are one item. Null and empty texts have no words. Rows are judged
    one by one: repeated ones alike, and ids and other columns, whatever their names, play no part. An empty table of
    documents gives no rows, an empty benchmark no hits. A text longer than a piece is a shard of its own.
    """
    name, at_text, columns = free_name("match", docs), docs.columns.index("text"), docs.columns
    shape = pa.struct([("words", pa.int64()), ("hit", pa.int64()), ("items", pa.list_(pa.string())), ("flags", pa.binary())])
    kind = T.StructType([T.StructField("words", T.LongType()), T.StructField("hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("flags", T.BinaryType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    spark, out = docs.sparkSession, docs
    for number, block in enumerate(_blocks(benchmark, window, item_bytes)):
        if number and number % PASSES == 0:
            out = checkpointed(out)
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                rows: list[dict] = []
                for lo, hi, data, offsets in pieces(batch.column(at_text)):
                    shard = Shard(data, offsets, items)
                    at, size, which = shard.windows(items)
                    cover = np.zeros(int(shard.first[-1]) + 1, dtype=np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    hit = np.cumsum(cover)[:-1] > 0
                    named: dict[int, set[str]] = {}
                    many = max(1, len(items.sets))
                    for pair in np.unique(shard.document(at) * many + which).tolist():
                        named.setdefault(pair // many, set()).update(items.sets[pair % many])
                    for i in range(hi - lo):
                        mine = hit[shard.first[i] : shard.first[i + 1]]
                        rows.append({"words": len(mine), "hit": int(mine.sum()) if i in named else 0, "items": sorted(named.get(i, ())), "flags": np.packbits(mine).tobytes() if i in named else b""})
                if batch.num_columns > len(columns):  # an earlier block's matches
                    for row, before in zip(rows, batch.column(len(columns)).to_pylist(), strict=True):
                        if before["flags"]:
                            both = np.frombuffer(before["flags"], np.uint8)
                            both = both | np.frombuffer(row["flags"], np.uint8) if row["flags"] else both
                            row |= {"flags": both.tobytes(), "hit": int(np.bitwise_count(both).sum()), "items": sorted({*row["items"], *before["items"]})}
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(rows, shape)], [*columns, name])

        out = out.mapInArrow(run, schema)
    return out, name


def _bad(match: str) -> Column:
    return (F.col(f"{match}.hit") > 0) & (F.col(f"{match}.hit") * SHARE >= F.col(f"{match}.words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``; see ``with_matches``."""
    marked, match = with_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, item_bytes)
    digest = F.sha2(F.array_join(f"{match}.items", ",").cast("binary"), 256)
    return marked.select("doc_id", F.col(f"{match}.words").alias("n_words"), F.col(f"{match}.hit").alias("n_hit"), F.size(f"{match}.items").cast("long").alias("n_items"), digest.alias("items_sha256"), _bad(match).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` of whose words fewer than a twentieth lie in windows of benchmark items; see ``with_matches``."""
    docs, renamed = plainly(docs)
    marked, match = with_matches(docs, benchmark, window, item_bytes)
    return renamed(marked.where(~_bad(match)).drop(match))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, item_word, doc_word, n_words): for each suffix of each item, by shard, its longest verbatim match
    of ``window`` words or more (shorter items: whole) and where one such match lies. Words are counted from 0."""
    found, schema = None, "doc_id long, item_id string, item_word long, doc_word long, n_words long"
    for block in _blocks(benchmark, window, item_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, _, data, offsets in pieces(batch.column(1)):
                    shard = Shard(data, offsets, items)
                    if shard.suffixes is None or not len(items.words):
                        continue
                    best, place, _ = shard.suffixes.longest(items.words, np.arange(len(items.words)), items.rest)
                    ok = np.flatnonzero((best >= window) | ((best == items.rest) & (items.start == 0)))
                    word = shard.place[place[ok]]
                    doc = shard.document(word)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[lo + d] for d in doc.tolist()], pa.int64()), pa.array([items.ids[i] for i in items.item[ok].tolist()], pa.string()), pa.array(items.start[ok]), pa.array(word - shard.first[doc]), pa.array(best[ok])],
                        ["doc_id", "item_id", "item_word", "doc_word", "n_words"],
                    )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def op1_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What of each document is benchmark text, in windows of 13 words; see ``contamination``."""
    return contamination(docs, benchmark)
