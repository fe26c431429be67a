"""LM scoring: smoothed n-grams as a weighted automaton with failure arcs, walked once over each text.

The states are the empty history and every history of one word or two that the training texts have, however rare. An arc
of a state carries the probability of a token seen after it and leads to the longest history that is a state; where a token
has no arc, the failure arc leads to the history without its first word at a weight. Counts of all training texts are gathered by chunks of documents: a chunk gives its
distinct n-grams of each order with their counts to the parts of an exchange and is told the corpus-wide counts of just
those, in the order it gave them, so no table of the corpus is sent everywhere and no key goes back.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.blocks import pack, unpack
from pagelore.llm.common import LOWER, NOT_SPACE, checkpointed, give_back, grouped, mixed, pieces, span_hashes, utf8, word_bounds

#: A history is a state if it is at least this share of the training tokens, and seen at all; words in the longest n-gram.
HISTORY, ORDER = 0.0, 3
#: Weight in tokens of the distribution below a history; texts whose crc32 modulo this is 0 are held out.
WEIGHT, FOLDS = 500.0, 10
#: The end of a text, which is also the history of its first token.
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes in a chunk; distinct n-grams of one order for each byte of text, at most about; n-grams that one task sums.
BLOCK, NGRAMS_PER_BYTE, KEYS = 16 << 20, 1 / 7, 2 << 20
#: Tokens of a long text that one walker reads.
STRETCH = 2048
#: What a row is: a chunk's documents, n-grams of an order (its number is their kind), or sums over a part's words.
LOCAL, TOKENS, DISTINCT, ONCE = 0, -1, -2, -3
ROWS = "part long, chunk long, kind int, body binary"


class Tokens:
    """A chunk's tokens in order, an end after each text, with flags of those that teach."""

    def __init__(self, table: pa.Table, folds: int = FOLDS, key: int = 0) -> None:
        self.ids = table.column("doc_id")
        data, offsets = utf8(table.column("text"))
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        self.tokens = np.insert(span_hashes(data, starts, ends, key), first[1:], END)
        self.first = first + np.arange(len(first))
        names = self.ids.to_pylist()
        self.held_out = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds == 0 for d in names], dtype=bool)
        sizes = np.diff(self.first)
        self.teaches = np.repeat(~self.held_out, sizes)
        #: tokens of the same text before each one
        self.before = (np.arange(len(self.tokens)) - np.repeat(self.first[:-1], sizes)).astype(np.int32)

    def ngrams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: hashes of the n-grams that end at each token, and the places that have one. A text's first
        word is after an end; longer n-grams begin with a word or that end and don't reach over it."""
        keys = self.tokens
        yield keys, np.ones(len(keys), dtype=bool)
        for n in range(2, order + 1):
            keys = mixed(np.roll(keys, 1) * np.uint64(0x9E3779B97F4A7C15) + (self.tokens ^ (self.tokens >> np.uint64(32))))
            yield keys, self.before >= n - 2


def planes(values: np.ndarray) -> np.ndarray:
    """Whole numbers byte by byte of all of them, so that their leading zeros take no room once packed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def rows_of(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "chunk", "kind", "body"])


def chunks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, bytes, pa.Table]]:
    """(number, packed documents, documents) of runs of rows of about ``block`` bytes. The number is a hash of the
    documents, so it is the same whenever they are read; chunks of the same documents share it, and all their counts."""

    def whole_chunk(held: list[pa.RecordBatch]) -> tuple[int, bytes, pa.Table]:
        table, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        body = sink.getvalue().to_pybytes()
        return xxhash.xxh64_intdigest(body) >> 1, body, table

    held, size = [], 0
    for batch in batches:
        for lo, hi, data, _ in pieces(batch.column("text"), block):
            if held and size + len(data) > block:
                yield whole_chunk(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += len(data)
    if held:
        yield whole_chunk(held)


def given(table: pa.Table, chunk: int, parts: int, folds: int, order: int, key: int) -> pa.Table:
    """A chunk's distinct n-grams with how often each is taught, for the parts; hashes as differences."""
    held, rows = Tokens(table, folds, key), []
    for n, (keys, valid) in enumerate(held.ngrams(order), 1):
        known, which = np.unique(keys[valid], return_inverse=True)
        counts = np.bincount(which, weights=held.teaches[valid], minlength=len(known))
        rows += [(part, chunk, n, pack(planes(np.diff(known[piece], prepend=np.uint64(0))), planes(counts[piece]))) for part, piece in grouped(known, parts)]
    return rows_of(rows)


def summed(rows: pa.Table, order: int) -> pa.Table:
    """Corpus-wide counts of one part's n-grams, back to each chunk in the order it gave them; and of words the sums of
    the part: tokens, distinct tokens and those seen once, in the column chunk."""
    bodies = [[whole(x) for x in unpack(b)] for b in rows.column("body").to_pylist()]
    bodies = [(np.cumsum(steps, dtype=np.uint64), counts) for steps, counts in bodies]
    known, which = np.unique(np.concatenate([b[0] for b in bodies]), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([b[1] for b in bodies])).astype(np.int64)
    counts = total[which]
    part, at, out = rows.column("part")[0].as_py(), np.cumsum([0, *(len(b[0]) for b in bodies)]), []
    for i, chunk in enumerate(rows.column("chunk").to_pylist()):
        out.append((part, chunk, order, pack(planes(counts[at[i] : at[i + 1]]))))
    if order == 1:
        out += [(part, int(x), kind, b"") for kind, x in ((TOKENS, total.sum()), (DISTINCT, (total > 0).sum()), (ONCE, (total == 1).sum()))]
    return rows_of(out)


#: Of an order: the number of the n-gram that ends at each token (-1: none), a place of each number, and its count.
Order = tuple[np.ndarray, np.ndarray, np.ndarray]


def numbered_ngrams(held: Tokens, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the number of the n-gram that ends at each token (-1: none), and a place of each number."""
    for keys, valid in held.ngrams(order):
        at = np.flatnonzero(valid).astype(np.int32)
        _, first, which = np.unique(keys[at], return_index=True, return_inverse=True)
        numbers = np.full(len(keys), -1, np.int32)
        numbers[at] = which
        place = at[first]
        del at, _, first, which
        yield numbers, place


def told(rows: pa.Table, held: Tokens, order: int) -> Iterator[Order]:
    """The n-grams of each order with their corpus-wide counts, one order at a time."""
    bodies = dict(zip(zip(rows.column("kind").to_pylist(), rows.column("part").to_pylist(), strict=True), rows.column("body").to_pylist(), strict=True))
    for n, (numbers, place) in enumerate(numbered_ngrams(held, order), 1):
        counts = np.concatenate([np.zeros(0, np.uint64), *(whole(unpack(bodies[b])[0]) for b in sorted(bodies) if b[0] == n)])
        if len(counts) != len(place):
            raise RuntimeError("the documents were not the same when they were read again")
        yield numbers, place, counts.astype(np.int64)


class Automaton:
    """The states and arcs that a chunk's texts can come to; ``total`` training tokens, ``once`` of them seen once.

    In the empty history a token has its share of the training tokens, all unseen ones together that of those seen once. In
    a history h it has (count after h + weight times that of h without its first word) / (count of h + weight): an arc if
    the count is not 0, else the failure arc of weight / (count of h + weight) and what follows. States are numbered from
    the empty one, 0, by the length of their histories; the arcs of each length are a table of their own, in order. ``end``
    is a place of an end; n-grams are taken one order at a time, so that two orders are held at most.
    """

    def __init__(self, ngrams: Iterator[Order], order: int, end: int, total: int, once: int, history: float = HISTORY, weight: float = WEIGHT) -> None:
        least = max(1.0, history * total)
        self.words, _, count = next(ngrams)
        self.end, self.symbols, self.count_of_word = self.words[end], len(count), count
        chance = np.where(count > 0, count, once) / max(1, total + once) if total else np.ones(len(count))
        chance = np.maximum(chance, 0.5 / max(1, total))
        self.weight_of_word, states = np.log10(chance), np.zeros(len(count), np.int32)
        #: the first state of each length, and one after the last; arcs are (state and word, weight, next state) by length
        self.levels, self.arcs = [0, 1], [None]
        fail_weight, fail_to = [np.zeros(1)], [np.zeros(1, np.int32)]
        numbers, own = self.words, count >= least
        for n in range(1, order + 1):
            if n > 1:
                shorter, of_shorter = numbers, count
                numbers, place, count = next(ngrams)
                before, last = shorter[place - 1], shorter[place]
                of_history, history_state, states = of_shorter[before], states[before], states[last]
                inside = of_history >= least
                chance = np.where(inside, (count + weight * chance[last]) / (of_history + weight), chance[last])
                word = self.words[place]
                own = (count >= least) & (word != self.end)  # no text goes on after its end
                del place, before, last, shorter, of_shorter, of_history
            if n < order:
                fail_weight.append(np.log10(weight / (count[own] + weight)))
                fail_to.append(states[own])
                states[own] = self.levels[-1] + np.arange(own.sum(), dtype=np.int32)
                self.levels.append(self.levels[-1] + int(own.sum()))
            if n == 1:
                self.to_of_word = states
            else:
                arc = np.flatnonzero(inside & (count > 0))
                keys = history_state[arc].astype(np.int64) * self.symbols + word[arc]
                arc, keys = arc[np.argsort(keys)], np.sort(keys)
                self.arcs.append((keys, np.log10(chance[arc]), states[arc]))
        self.fail_weight, self.fail_to = np.concatenate(fail_weight), np.concatenate(fail_to)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, log10 probability) after each walker reads its word: along failure arcs to the first state with an arc."""
        chance, after, state = np.zeros(len(state)), np.zeros(len(state), np.int32), state.copy()
        live = np.ones(len(state), dtype=bool)
        for level in range(len(self.arcs) - 1, 0, -1):
            keys, weights, to = self.arcs[level]
            here = np.flatnonzero(live & (state >= self.levels[level]))
            hit = np.zeros(len(here), dtype=bool)
            if len(keys) and len(here):
                key = state[here].astype(np.int64) * self.symbols + word[here]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                chance[here[hit]] += weights[at[hit]]
                after[here[hit]], live[here[hit]] = to[at[hit]], False
            here = here[~hit]
            chance[here] += self.fail_weight[state[here]]
            state[here] = self.fail_to[state[here]]
        chance[live] += self.weight_of_word[word[live]]
        after[live] = self.to_of_word[word[live]]
        return after, chance

    def walk(self, held: Tokens, order: int, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each text, from left to right, in the state that an end leads to.

        All texts are walked at once, long ones in stretches. A state depends on the last words only, so the walker of a
        stretch sets out ``order`` - 1 words before it, from the empty state, without counting those.
        """
        sizes, stretch = np.diff(held.first), max(stretch, order - 1)
        pieces_of = (sizes + stretch - 1) // stretch
        text = np.repeat(np.arange(len(sizes)), pieces_of)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        lead = np.where(number > 0, order - 1, 0)
        begin = held.first[text] + number * stretch - lead
        length = np.minimum((number + 1) * stretch, sizes[text]) - number * stretch + lead
        longest_first = np.argsort(-length, kind="stable")
        begin, length, lead = begin[longest_first], length[longest_first], lead[longest_first]
        state = np.where(lead > 0, 0, self.to_of_word[self.end])
        chance, live = np.zeros(len(begin)), len(begin)
        for at in range(int(length.max(initial=0))):
            live = np.searchsorted(-length[:live], -at, side="left")
            state[:live], gained = self.step(state[:live], self.words[begin[:live] + at])
            chance[:live] += np.where(at >= lead[:live], gained, 0.0)
        of_walker = np.empty(len(chance))
        of_walker[longest_first] = chance
        return np.bincount(text, weights=of_walker, minlength=len(sizes))


def scored(docs: DataFrame, folds: int = FOLDS, block: int = BLOCK, history: float = HISTORY, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Tokens are words between white space, A-Z in lower case, and an end. Rows whose crc32 of the id modulo ``folds`` is 0
    don't teach. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens. Null texts are empty.
    N-grams have ``order`` words at most. A chunk is a run of input rows of about ``block`` bytes, whatever
    their ids; ``docs`` is read twice and must give the same rows in the same order, as files do, or an error is raised.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    key = secrets.randbits(64)  # of the hashes, so that no words can be made to share one
    parts = int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * NGRAMS_PER_BYTE) // KEYS + 1

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, table in chunks(batches, block):
            yield from given(table, chunk, parts, folds, order, key).to_batches()
            give_back()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, body, _ in chunks(batches, block):
            yield from rows_of([(0, chunk, LOCAL, body)]).to_batches()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        out = summed(table, key[1].as_py())
        give_back()
        return out

    rows = checkpointed(docs.mapInArrow(give, ROWS).groupBy("part", "kind").applyInArrow(meet, ROWS))
    sums = dict(rows.where("kind < 0").groupBy("kind").agg(F.sum("chunk")).collect())
    total, distinct, once = (int(sums.get(kind, 0)) for kind in (TOKENS, DISTINCT, ONCE))

    def score(table: pa.Table) -> pa.Table:
        local = np.array(table.column("kind").to_pylist()) == LOCAL
        bodies, known = table.filter(pa.array(local)).column("body").to_pylist(), table.filter(pa.array(~local))
        if not bodies:
            raise RuntimeError("the documents were not the same when they were read again")
        held = Tokens(pa.ipc.open_stream(bodies[0]).read_all().combine_chunks(), folds, key)
        ngrams = told(known, held, order)
        automaton = Automaton(ngrams, order, held.first[1] - 1, total, once, history)
        ngrams.close()
        del held.tokens
        chance, count = automaton.walk(held, order), automaton.count_of_word[automaton.words]
        base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
        at = held.first[:-1]
        add = lambda x: np.add.reduceat(x, at)
        n = np.diff(held.first)
        out = pa.table({"doc_id": held.ids, "held_out": pa.array(held.held_out), "n_tokens": pa.array(n), "n_known": pa.array(add((count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(n), total)), "base_score": pa.array(add(base)), "score": pa.array(chance)})
        give_back()
        return pa.concat_tables([out] * len(bodies))

    return docs.mapInArrow(local, ROWS).union(rows.where("kind > 0")).groupBy("chunk").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_language_model(docs: DataFrame) -> DataFrame:
    return scored(docs, order=ORDER)
