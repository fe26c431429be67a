"""Finding what blocks of documents share without moving what they don't: exchanges of packed keys between blocks.

Windows are runs of a fixed number of units (bytes or words). Every window has an anchor, and equal windows have equal ones.
Blocks first tell each other the keys of their anchors. Stretches, the runs of windows of one anchor, then go with their
text to the part that owns the anchor's key, if another block or row has that anchor too, so equal windows meet there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import BLOCK, Blocks, free_name, give_back, grouped, numbered, spans_of

#: Anchor keys that one task compares, and bits by which their space exceeds their number.
KEYS, SPARE_BITS = 1 << 20, 14
#: What a packed row is, beside rows of keys.
SHARED, LOCAL, EARLIER, CROWDED = 0, 1, 2, 3
#: Places of a key in one block, and blocks that have it, beyond which it is crowded.
PLACES, BLOCKS = 256, 4096
ROWS = "part int, owner long, blk int, kind int, body binary"
NAMES = ["part", "owner", "blk", "kind", "body"]


def packed_rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=NAMES)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body; ints that rise are best given as differences."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes() + b"".join(a.dtype.str.encode().ljust(8) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8).tolist(), 8 + 16 * n, []
    for i, size in enumerate(sizes):
        kind = np.dtype(raw[8 + 8 * n + 8 * i : 16 + 8 * n + 8 * i].decode().strip())
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


class Plan:
    """Blocks of ``docs`` in order of doc_id, and sizes that follow the bytes of text."""

    def __init__(self, docs: DataFrame, per_byte: float, block: int = BLOCK) -> None:
        blocks = Blocks(docs, block)
        keys = int(max(blocks.bytes, 1) * per_byte) + 1
        self.parts = keys // KEYS + 1
        #: bytes of a key: the bits that number the keys, and some to spare, so that few are alike by chance
        self.width = min(8, -(-(keys.bit_length() + SPARE_BITS) // 8))
        self.name = free_name("blk", docs)
        self.docs = docs.withColumn(self.name, blocks.of(docs))


class Held:
    """The stretches of a block's documents. Those who derive from it set, in order of place: ``data``, the bytes that
    spans lie in; and of each stretch the ``key`` of its anchor, its first window ``at`` and the ``count`` of its windows,
    and its ``row``."""

    ids: np.ndarray
    data: np.ndarray
    key: np.ndarray
    at: np.ndarray
    count: np.ndarray
    row: np.ndarray

    def span(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``count`` windows from ``at`` on."""
        raise NotImplementedError

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        """Hashes of single windows."""
        raise NotImplementedError

    def shared(self, outside: np.ndarray, width: int, within_rows: bool) -> np.ndarray:
        """Flags of the stretches whose anchor another block, or another row of this block, has too; ``within_rows``: or
        the same row once more."""
        order = np.lexsort((self.row, self.key))
        key, row = self.key[order], self.row[order]
        inside = np.zeros(len(key), dtype=bool)
        if len(key):
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(key)] - 1
            inside[order] = np.repeat((row[first] != row[last]) | (within_rows & (last > first)), last - first + 1)
        return inside | isin_sorted(shorter(self.key, width), outside)


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a block by doc_id (nulls first) and text, and the ids with the least number for null."""
    table = table.combine_chunks()
    ids = table.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    tied = ids[order][1:] == ids[order][:-1]
    if tied.any():
        text = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i] is not None, text[i] or "")), dtype=np.int64)
    return table.take(pa.array(order)), ids[order]


def shorter(keys: np.ndarray, width: int) -> np.ndarray:
    """The leading ``width`` bytes of 64-bit keys."""
    return keys >> np.uint64(64 - 8 * width)


def trimmed(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return run


def trimmed2(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return run


def shared_between_blocks(plan: Plan, keys_of: Callable[[pa.Table], np.ndarray], places: int = PLACES) -> DataFrame:
    """Rows (part, owner, blk, SHARED, body): for each block, its keys that another block has too; and the same of those
    among them that are CROWDED, as all blocks then know alike: over ``places`` times in a block, or in over BLOCKS blocks.

    A block gives each of its keys once, so a key that every document has weighs no more than one that each block has.
    """
    parts, width, name = plan.parts, plan.width, plan.name

    def body_of(keys: np.ndarray) -> bytes:
        return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()

    def keys_in(body: bytes) -> np.ndarray:
        raw = np.zeros((len(body) // width, 8), np.uint8)
        raw[:, :width] = np.frombuffer(body, np.uint8).reshape(-1, width)
        return raw.view("<u8").ravel()

    def give(table: pa.Table) -> pa.Table:
        blk = table.column(name)[0].as_py()
        keys, often = np.unique(keys_of(table), return_counts=True)
        rows = []
        for part, piece in grouped(keys, parts):
            rows.append((part, 0, blk, SHARED, body_of(np.unique(shorter(keys[piece], width)))))
            if (many := often[piece] > places).any():
                rows.append((part, 0, blk, CROWDED, body_of(np.unique(shorter(keys[piece][many], width)))))
        return packed_rows(rows)

    def meet(table: pa.Table) -> pa.Table:
        held = list(zip(table.column("blk").to_pylist(), table.column("kind").to_pylist(), map(keys_in, table.column("body").to_pylist()), strict=True))
        keys, blocks = np.unique(np.concatenate([k for _, kind, k in held if kind == SHARED]), return_counts=True)
        several = keys[blocks > 1]
        crowded = np.unique(np.concatenate([keys[blocks > BLOCKS], *(k for _, kind, k in held if kind == CROWDED)]))
        rows = []
        for blk, kind, mine in held:
            if kind == SHARED and len(mine := mine[isin_sorted(mine, several)]):
                rows.append((0, 0, blk, SHARED, mine.astype("<u8").tobytes()))
                if len(mine := mine[isin_sorted(mine, crowded)]):
                    rows.append((0, 0, blk, CROWDED, mine.astype("<u8").tobytes()))
        return packed_rows(rows)

    given = plan.docs.groupBy(name).applyInArrow(trimmed(give), ROWS)
    return given.groupBy("part").applyInArrow(trimmed(meet), ROWS)


def held_keys(rows: pa.Table, kind: int = SHARED) -> np.ndarray:
    bodies = [np.frombuffer(b, "<u8") for b, k in zip(rows.column("body").to_pylist(), rows.column("kind").to_pylist(), strict=True) if k == kind]
    return np.unique(np.concatenate(bodies)) if bodies else np.zeros(0, np.uint64)


def with_blocks(plan: Plan, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each block's documents together with its packed rows."""
    return plan.docs.groupBy(plan.name).cogroup(rows.groupBy("blk")).applyInArrow(trimmed2(work), schema)


def exchanged(rows: DataFrame, meet: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``meet`` on the rows of each part; LOCAL rows, which each have an owner of their own, pass as they are."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[1].as_py():
            return table.select(NAMES)
        out = meet(table)
        give_back()
        return out

    return rows.groupBy("part", "owner").applyInArrow(run, ROWS)


def offered(held: Held, blk: int, known: pa.Table, width: int, parts: int, shards: int, places: int, within_rows: bool) -> pa.Table:
    """The stretches of a block that may hold windows of others, for the parts that own their anchors.

    Of a crowded anchor each window goes alone, by a key of its own, so that no anchor's text fills a part. Of equal spans
    of a block only the first goes on, so a span that every document has weighs no more than one that each block has; the
    later ones are LOCAL: all their windows go. Rows of equal ids don't remove each other's text, so those are all sent.
    """
    may = np.flatnonzero(held.shared(held_keys(known), width, within_rows))
    key, at, count, row = (x[may] for x in (held.key, held.at, held.count, held.row))
    _, which, often = np.unique(key, return_inverse=True, return_counts=True)
    short = shorter(key, width)
    crowded = np.where(isin_sorted(short, held_keys(known)), isin_sorted(short, held_keys(known, CROWDED)), often[which] > places) if len(key) else np.zeros(0, bool)
    if crowded.any():
        who = np.repeat(np.flatnonzero(crowded), count[crowded])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(count[crowded]) - count[crowded], count[crowded])
        single = at[who] + nth
        key = np.concatenate((key[~crowded], held.window_keys(single)))
        at, count, row = (np.concatenate((x[~crowded], y)) for x, y in ((at, single), (count, np.ones(len(single), np.int64)), (row, row[who])))
        order = np.argsort(at, kind="stable")
        key, at, count, row = key[order], at[order], count[order], row[order]
    begin, end = held.span(at, count)
    like, first = numbered(held.data, begin, end)
    ids = held.ids[row]
    local = ids > ids[first[like]]
    if within_rows and len(like):
        order = np.lexsort((at, like))
        again = (like[order][1:] == like[order][:-1]) & (row[order][1:] == row[order][:-1])
        local[order[1:][again]] = True
    rows = [(-1, blk + 1, blk, LOCAL, pack(np.diff(at[local], prepend=0).astype(np.int32), count[local].astype(np.uint16)))] if local.any() else []
    sent = np.flatnonzero(~local)
    edges = (np.arange(1, parts * shards, dtype=np.float64) * (2.0**64 / (parts * shards))).astype(np.uint64)
    shard = np.searchsorted(edges, key[sent], "right")
    order = np.argsort(shard, kind="stable")
    sent, shard = sent[order], shard[order]
    for a, b in alike(shard // shards):
        of, part = sent[a:b], int(shard[a] // shards)
        size = end[of] - begin[of]
        text, _ = spans_of(held.data, begin[of], size)
        inside = np.bincount(shard[a:b] - part * shards, minlength=shards).astype(np.int32)
        rows.append((part, 0, blk, EARLIER, pack(inside, np.diff(at[of], prepend=0).astype(np.int32), count[of].astype(np.uint16), np.diff(row[of], prepend=0).astype(np.int32), np.diff(ids[of], prepend=0), size.astype(np.int32), text)))
    return packed_rows(rows)


def judged(rows: pa.Table, judge: Callable[[Members], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """What ``judge`` finds in each shard of a part: rows (blk, LOCAL) of the windows that go, as first ones and counts."""
    blks = rows.column("blk").to_numpy()
    bodies = [unpack(b) for b in rows.column("body").to_pylist()]
    bodies = [(np.r_[0, np.cumsum(n)], np.cumsum(at.astype(np.int64)), count, np.cumsum(row.astype(np.int64)), np.cumsum(ids), np.r_[0, np.cumsum(size.astype(np.int64))], text) for n, at, count, row, ids, size, text in bodies]
    found: list[tuple] = []
    for shard in range(len(bodies[0][0]) - 1):
        cut = [(b[0][shard], b[0][shard + 1]) for b in bodies]
        size = [np.diff(b[5][lo : hi + 1]) for b, (lo, hi) in zip(bodies, cut, strict=True)]
        of = [np.concatenate([b[i][lo:hi] for b, (lo, hi) in zip(bodies, cut, strict=True)]).astype(np.int64) for i in (1, 2, 3, 4)]
        if not len(of[0]):
            continue
        text = np.concatenate([b[6][b[5][lo] : b[5][hi]] for b, (lo, hi) in zip(bodies, cut, strict=True)])
        blk = np.repeat(blks, [hi - lo for lo, hi in cut])
        member, nth, count = judge(Members(blk, *of, np.concatenate(size), text))
        found.append((blk[member], of[0][member] + nth, count))
    if not found:
        return packed_rows([])
    owner, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, owner))
    owner, start, count = owner[order], start[order], count[order]
    return packed_rows([(0, 0, int(owner[a]), LOCAL, pack(np.diff(start[a:b], prepend=0).astype(np.int32), count[a:b].astype(np.uint16))) for a, b in alike(owner)])


class Members(NamedTuple):
    """Stretches that meet in a shard: their block, first window, count of windows, row in the block and doc_id; the sizes
    of their spans, and the bytes of those end to end."""

    blk: np.ndarray
    at: np.ndarray
    count: np.ndarray
    row: np.ndarray
    ids: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def runs_of(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, first of its windows, how many) of the runs of flagged windows; flags are by member and window."""
        who = np.repeat(np.arange(len(self.count)), self.count)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        edge = np.r_[True, who[1:] != who[:-1]]
        begins = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
        ends = np.flatnonzero(gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False]))
        return who[begins], nth[begins], nth[ends] - nth[begins] + 1


def windows_gone(plan: Plan, read: Callable[[pa.Table], Held], judge: Callable[[Members], tuple], spread: int, shards: int, places: int = PLACES, within_rows: bool = False) -> DataFrame:
    """Rows that tell each block the windows that go: ``judge`` on the stretches that blocks and rows share.

    Their text is dealt to ``spread`` times as many parts as anchor keys are, and judged by ``shards`` of a part in turn.
    """
    name, width, parts = plan.name, plan.width, plan.parts * spread

    def ask(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed_rows([])
        return offered(read(table), table.column(name)[0].as_py(), known, width, parts, shards, places, within_rows)

    shared = shared_between_blocks(plan, lambda table: read(table).key, places)
    return exchanged(with_blocks(plan, shared, ask, ROWS), lambda rows: judged(rows, judge))


def units_gone(told: pa.Table, units: int, length: int) -> np.ndarray:
    """Flags of a block's units that a window lies on that goes."""
    start, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for body in told.column("body").to_pylist():
        at, n = unpack(body)
        start.append(np.cumsum(at.astype(np.int64)))
        count.append(n.astype(np.int64))
    start, count = np.concatenate(start), np.concatenate(count)
    return covered(start, start + count - 1 + length, units)


def alike(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(cut, [*cut[1:], len(values)], strict=True))


def isin_sorted(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return held[at] == values


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:size] > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
