"""Suffix-array dedup of bytes: strings that documents share are suffix-sorted in shards by external induction.

Documents lie in blocks. Blocks tell each other in packed keys which byte anchors they share; every string of the given
length holds an anchor, and equal strings hold equal ones. The stretches of text around shared anchors go to shards by
anchor, so equal strings meet in one shard. A shard sorts its suffixes by induction, reads the classes of equal strings
off the common prefixes of neighbours, and tells the blocks which of their bytes an earlier document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelore.llm.blocks import PLACES, Held, Members, Plan, in_order, runs, units_gone, windows_gone, with_blocks
from pagelore.llm.common import anchors, byte_units, mixed, numbered, span_hashes, spans_of, starts_within, utf8, window_hashes
from pagelore.llm.induced_sort import MEMORY, common_prefixes, suffix_order

#: Bytes in a string, bytes in the grams that anchors are chosen from.
LENGTH, GRAM = 50, 20
#: Anchors for each byte of text, at most about; bytes of text at once; parts that the text of as many anchors goes to as
#: one task compares keys of, and shards that a part sorts one after the other.
ANCHORS_PER_BYTE, SCAN, SPREAD, SHARDS = 1 / 14, 1 << 20, 4, 6


class Stretches(Held):
    """Of a block: the anchors of its strings, and for each run of strings with one anchor its first start and count."""

    def __init__(self, table: pa.Table, length: int = LENGTH, gram: int = GRAM) -> None:
        self.table, self.ids = in_order(table)
        self.data, self.offsets = utf8(self.table.column("text"))
        self.length = length
        key, at, count, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lo, rows = 0, len(self.ids)
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + SCAN, "right")) - 1)
            base = self.offsets[lo]
            units = byte_units(self.data[base : self.offsets[hi]])
            first = self.offsets[lo : hi + 1] - base
            if len(units) >= length:
                valid = starts_within(first, length)[: len(units) - length + 1]
                grams = window_hashes(units, gram)
                place = anchors(grams, valid, length - gram + 1)
                new = np.flatnonzero((place >= 0) & np.r_[True, place[1:] != place[:-1]])
                end = np.flatnonzero((place >= 0) & np.r_[place[1:] != place[:-1], True])
                key.append(grams[place[new]])
                at.append(new + base)
                count.append(end - new + 1)
                row.append(np.searchsorted(self.offsets, new + base, "right") - 1)
            lo = hi
        self.key, self.at, self.count, self.row = (np.concatenate(x) for x in (key, at, count, row))

    def span(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at, at + count + self.length - 1

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        return mixed(span_hashes(self.data, at, at + self.length) ^ np.uint64(self.length))


def classes(text: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(string, class of equal strings): strings are the ``length``-byte starts within each span, in order of place."""
    used = np.zeros(256, dtype=bool)
    used[text] = True
    if used.all():  # no value is free to part the spans: sort by two half letters
        half = np.stack((text >> 4, text & 15), axis=1).ravel()
        string, kind = classes(half, begin * 2, size * 2, length * 2, memory)
        even = (string & 1) == 0  # spans begin at even places
        return string[even] // 2, kind[even]
    dense = (np.cumsum(used)).astype(np.uint8)  # order stays, 0 is free
    parted = np.zeros(len(text) + len(size), dtype=np.uint8)
    spread = np.arange(len(text)) + np.repeat(np.arange(len(size)), size)
    parted[spread] = dense[text]
    order = suffix_order(parted, length, memory)
    starts = np.zeros(len(parted), dtype=bool)
    whole = np.repeat(begin + size - length, size)
    starts[spread[np.arange(len(text)) <= whole]] = True
    order = order[starts[order]]
    kind = np.r_[0, np.cumsum(common_prefixes(parted, order, length) < length)] if len(order) else order
    back = np.zeros(len(parted), dtype=np.int64)
    back[spread] = np.arange(len(text))
    return back[order], kind


def strings_gone(members: Members, length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first string, how many) of runs of a member's strings that a document of a smaller id has.

    Equal stretches are sorted once, with the least of their ids.
    """
    ids, count, size, text = members.ids, members.count, members.size, members.text
    begin = np.cumsum(size) - size
    same, first = numbered(text, begin, begin + size)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    once, at = spans_of(text, begin[first], size[first])
    string, kind = classes(once, at, size[first], length, memory)
    owner = np.searchsorted(at, string, "right") - 1
    earliest = np.full(int(kind.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, kind, least[owner])
    by_place = np.full(len(once), np.iinfo(np.int64).max)
    by_place[string] = earliest[kind]
    # every member's strings against the earliest id that has them
    who = np.repeat(np.arange(len(ids)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return members.runs_of(by_place[at[same[who]] + nth] < ids[who])


def _finished(docs: DataFrame, finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, length: int, block: int | None, memory: int, places: int) -> DataFrame:
    plan = Plan(docs, ANCHORS_PER_BYTE, **({"block": block} if block else {}))

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        held, _ = in_order(table)
        data, offsets = utf8(held.column("text"))
        return finish(held, data, offsets, units_gone(told, len(data), length))

    told = windows_gone(plan, lambda table: Stretches(table, length), lambda members: strings_gone(members, length, memory), SPREAD, SHARDS, places)
    return with_blocks(plan, told, work, schema)


def bytes_removed(docs: DataFrame, length: int = LENGTH, block: int | None = None, memory: int = MEMORY, places: int = PLACES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``.

    A byte goes if a string of ``length`` bytes of its text that covers it also starts in a row of smaller doc_id; a null
    id comes before all others, rows of equal ids don't remove each other's bytes. Null texts are empty.
    """

    def finish(held: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
        left = np.r_[0, np.cumsum(gone)]
        removed = left[offsets[1:]] - left[offsets[:-1]]
        digests, spans = [], []
        for i in range(held.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            if removed[i]:
                flags = gone[offsets[i] : offsets[i + 1]]
                text = text[~flags]
                spans.append(int(flags[0]) + int(np.count_nonzero(flags[1:] & ~flags[:-1])))
            else:
                spans.append(0)
            digests.append(hashlib.sha256(text.tobytes()).hexdigest())
        return pa.table({"doc_id": held.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return _finished(slim, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, block, memory, places)


def spans(docs: DataFrame, length: int = LENGTH, block: int | None = None) -> DataFrame:
    """(doc_id, start, end) in bytes of the maximal runs that ``bytes_removed`` removes."""

    def finish(held: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
        ids, begin, end = [], [], []
        for i, name in enumerate(held.column("doc_id").to_pylist()):
            for a, b in zip(*runs(gone[offsets[i] : offsets[i + 1]]), strict=True):
                ids.append(name)
                begin.append(int(a))
                end.append(int(b))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64())})

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return _finished(slim, finish, "doc_id long, start long, end long", length, block, MEMORY, PLACES)


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    return bytes_removed(docs)
