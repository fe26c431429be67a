"""Substring dedup over words: prefix-partitioned suffix trees whose deep internal nodes are the repeats.

Documents lie in blocks in order of doc_id. Blocks first tell each other, in packed keys, which word anchors they share
(every window holds an anchor, and equal windows hold equal ones). Suffixes that may repeat then go, with their words, to
the part that owns the anchor. A part splits its suffixes by prefixes of as many words as make the groups fit into memory
and builds the subtree of each group to the depth of a window: sorted suffixes, common prefixes of neighbours, and from
them the inner nodes. The leaves below a deep inner node are the places of a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelore.llm.blocks import PLACES, Held, Members, Plan, in_order, runs, units_gone, windows_gone, with_blocks
from pagelore.llm.common import NOT_SPACE, anchors, mixed, numbered, plainly, span_hashes, spans_of, starts_within, utf8, window_hashes, word_bounds

#: Words in a window, words in the grams that anchors are chosen from, suffixes in a group.
WINDOW, GRAM, GROUP = 20, 8, 40_000
#: Anchors for each byte of text, at most about: two in fourteen words of five bytes or more; parts that the words of as
#: many anchors go to as one task compares keys of, and shards that a part works on one after the other.
ANCHORS_PER_BYTE, SPREAD, SHARDS = 1 / 35, 6, 3


class Words:
    """A block's words in order."""

    def __init__(self, table: pa.Table) -> None:
        self.table, self.ids = in_order(table)
        self.data, self.offsets = utf8(self.table.column("text"))
        self.starts, self.ends, self.first = word_bounds(self.data, self.offsets, NOT_SPACE)


class Windows(Held):
    """A block's windows of words by their anchors; ``data`` is its words, each with a space after it."""

    def __init__(self, table: pa.Table, window: int = WINDOW, gram: int = GRAM) -> None:
        held = Words(table)
        self.ids, self.window = held.ids, window
        size = held.ends - held.starts + 1
        self.starts = np.cumsum(size) - size
        self.ends = self.starts + size - 1
        text = np.append(held.data, np.uint8(32))
        self.data, _ = spans_of(text, held.starts, size)
        self.data[self.ends] = 32
        self.units = span_hashes(self.data, self.starts, self.ends)
        self.key, self.at, self.count, self.row = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        if len(self.units) >= window:
            valid = starts_within(held.first, window)[: len(self.units) - window + 1]
            grams = window_hashes(self.units, gram)
            place = anchors(grams, valid, window - gram + 1)
            self.at = np.flatnonzero((place >= 0) & np.r_[True, place[1:] != place[:-1]])
            self.count = np.flatnonzero((place >= 0) & np.r_[place[1:] != place[:-1], True]) - self.at + 1
            self.key = grams[place[self.at]]
            self.row = np.searchsorted(held.first, self.at, "right") - 1

    def span(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[at], self.ends[at + count + self.window - 2]

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        return mixed(window_hashes(self.units, self.window)[at] ^ np.uint64(self.window))


def suffix_groups(words: np.ndarray, suffixes: np.ndarray, depth: int, most: int = GROUP) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, words they agree in): groups by variable-length prefixes. A prefix whose suffixes are more than ``most``
    is extended by a word, until a window is full; small prefixes share a group, which then agrees in fewer words."""
    waiting = [(suffixes, 0)]
    while waiting:
        held, agreed = waiting.pop()
        if len(held) <= most or agreed == depth:
            yield held, agreed
            continue
        word = words[held + agreed]
        order = np.argsort(word, kind="stable")
        held, word = held[order], word[order]
        cut = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(held)]
        small: list[np.ndarray] = []
        room = 0
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > most:
                waiting.append((held[a:b], agreed + 1))
                continue
            if room + b - a > most and small:
                yield np.concatenate(small), agreed
                small, room = [], 0
            small.append(held[a:b])
            room += b - a
        if small:
            yield np.concatenate(small), agreed


def in_suffix_order(words: np.ndarray, suffixes: np.ndarray, depth: int, agreed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their next ``depth`` words, words that each shares with the one before, ``depth`` at
    most). All agree in the first ``agreed`` words."""
    bits = max(1, int(words.max(initial=0)).bit_length())
    many = max(1, 63 // bits)  # words in one sort key
    keys = []
    for k in range(agreed, depth, many):
        key = np.zeros(len(suffixes), dtype=np.int64)
        for j in range(k, min(depth, k + many)):
            key = (key << bits) | words[suffixes + j]
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(suffixes))
    suffixes = suffixes[order]
    common = np.zeros(len(suffixes), dtype=np.int64)
    live, k = np.arange(1, len(suffixes)), agreed
    while len(live) and k < depth:
        live = live[words[suffixes[live] + k] == words[suffixes[live - 1] + k]]
        k += 1
        common[live] = k
    common[1:] = np.maximum(common[1:], agreed)
    return suffixes, common


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, depth: int, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, node of each): those under one inner node of ``depth`` words or more; a leaf of its own has a node too.

    Groups are worked on one after the other. In the subtree of a group an inner node of that depth is a run of sorted
    suffixes of which each shares ``depth`` words or more with the one before.
    """
    order, node, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for held, agreed in suffix_groups(words, suffixes, depth, most):
        held, common = in_suffix_order(words, held, depth, agreed)
        new = common < depth
        new[:1] = True
        order.append(held)
        node.append(np.cumsum(new) - 1 + nodes)
        nodes += int(new.sum())
    return np.concatenate(order), np.concatenate(node)


def repeats_among(members: Members, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first window, how many) of runs of windows whose words start earlier too: in a row of smaller doc_id, or
    earlier in the same row."""
    count, size = members.count, members.size
    # a space after each span parts its last word from the next one
    begin = np.cumsum(size + 1) - size - 1
    text = np.full(int(size.sum()) + len(size), 32, np.uint8)
    text[np.arange(len(members.text)) + np.repeat(np.arange(len(size)), size)] = members.text
    starts, ends, first = word_bounds(text, np.append(begin, len(text)), NOT_SPACE)
    words, _ = numbered(text, starts, ends)
    who = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    suffix = first[who] + nth
    suffixes, node = deep_nodes(words, suffix, window)
    of = np.empty(len(words), np.int64)  # the node of each window, by member and window
    of[suffixes] = node
    node = of[suffix]
    ids, blk, row, place = members.ids[who], members.blk[who], members.row[who], members.at[who] + nth
    order = np.lexsort((place, row, blk, ids, node))
    node, ids, blk, row = node[order], ids[order], blk[order], row[order]
    new = np.r_[True, node[1:] != node[:-1]]
    least = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (ids > least) | np.r_[False, ~new[1:] & (row[1:] == row[:-1]) & (blk[1:] == blk[:-1]) & (ids[1:] == ids[:-1])]
    gone = np.empty(len(who), bool)
    gone[order] = later
    return members.runs_of(gone)


def _finished(docs: DataFrame, finish: Callable[[Words, np.ndarray], pa.Table], schema: str, window: int, block: int | None, places: int) -> DataFrame:
    plan = Plan(docs, ANCHORS_PER_BYTE, **({"block": block} if block else {}))

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        held = Words(table)
        return finish(held, units_gone(told, len(held.starts), window))

    gram = min(GRAM, window)
    told = windows_gone(plan, lambda table: Windows(table, window, gram), lambda members: repeats_among(members, window), SPREAD, SHARDS, places, within_rows=True)
    return with_blocks(plan, told, work, schema)


def repeats_removed(docs: DataFrame, window: int = WINDOW, block: int | None = None, places: int = PLACES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs``: the digest of what is left of its words.

    A word goes if a window of ``window`` consecutive words of its document that covers it also starts earlier: in a row
    of smaller doc_id, or earlier in the same row. A null id comes before all others; rows of equal ids don't remove each
    other's words. Null texts have no words.
    """

    def finish(held: Words, gone: np.ndarray) -> pa.Table:
        whole, first = held.data.tobytes(), held.first.tolist()
        starts, ends = held.starts.tolist(), held.ends.tolist()
        left, stays, digests = np.r_[0, np.cumsum(gone)], (~gone).tolist(), []
        for i in range(len(held.ids)):
            kept = [whole[starts[w] : ends[w]] for w in range(first[i], first[i + 1]) if stays[w]]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        removed = left[held.first[1:]] - left[held.first[:-1]]
        return pa.table({"doc_id": held.table.column("doc_id"), "n_words": pa.array(np.diff(held.first)), "n_removed": pa.array(removed), "kept_sha256": pa.array(digests, pa.string())})

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return _finished(slim, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, block, places)


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int | None = None, places: int = PLACES) -> DataFrame:
    """``docs`` with the repeated words cut out of the texts, in n_chars too where there is such a column; rows of which
    no word is left go. Texts that lose nothing stay as they are; around a cut the white space before it stays."""
    docs, renamed = plainly(docs)
    names, types = docs.columns, dict(docs.dtypes)

    def finish(held: Words, gone: np.ndarray) -> pa.Table:
        left = np.r_[0, np.cumsum(gone)]
        lost = left[held.first[1:]] - left[held.first[:-1]]
        keep = (lost == 0) | (lost < np.diff(held.first))
        text = held.table.column("text").to_pylist()
        for i in np.flatnonzero((lost > 0) & keep).tolist():
            a, b = held.first[i], held.first[i + 1]
            at, end, parts = held.offsets[i], held.offsets[i + 1], []
            for s, e in zip(*runs(gone[a:b]), strict=True):
                parts.append(held.data[at : held.starts[a + s]].tobytes())
                at = held.starts[a + e] if a + e < b else end
            parts.append(held.data[at:end].tobytes())
            text[i] = b"".join(parts).decode("utf-8", "replace")
        out = {n: held.table.column(n) for n in names} | {"text": pa.array(text, pa.string())}
        if "n_chars" in out:
            held_size = held.table.column("n_chars")
            size = [len(t) if n else old for t, n, old in zip(text, lost.tolist(), held_size.to_pylist(), strict=True)]
            out["n_chars"] = pa.array(size, held_size.type)
        return pa.table(out).filter(pa.array(keep))

    schema = ", ".join(f"`{n}` {types[n]}" for n in names)
    return renamed(_finished(docs, finish, schema, window, block, places))


def op2_substrings(docs: DataFrame) -> DataFrame:
    return repeats_removed(docs)
