"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagelore.llm.common import pieces

#: Pre-token pattern of byte-level BPE vocabularies of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose counts a worker remembers, and those merged in one batch.
REMEMBERED, BATCH = 1_000_000, 200_000
#: Letters from which on a pre-token is merged by an index of its ranks and not remembered.
LONG = 256
LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter by which such vocabularies write each byte: itself if it is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merger:
    """Counts the symbols that BPE leaves of byte strings.

    Symbols of a batch lie end to end in one array. In each round every string finds its lowest-ranked adjacent pair and
    merges all places of that pair at once, from the left where they overlap. Strings without a known pair leave.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        first, model = held.get("pre_tokenizer") or {}, held["model"]
        plain = held.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(t.get(k) for t in held.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocabulary, merges = model["vocab"], model["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = np.int64(max(vocabulary.values()) + 1)
        self.byte_ids = np.array([vocabulary[x] for x in _byte_letters()], dtype=np.int64)
        keys = np.array([vocabulary[a] * int(self.size) + vocabulary[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        self.pairs = np.empty(len(keys), dtype=np.int64)  # the pair of each rank
        self.pairs[self.ranks] = self.keys
        self.special = [t["content"] for t in held.get("added_tokens", []) if t["content"]]
        self.known: dict[str, int] = {}

    def count(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        counts, symbols = np.zeros(len(words), dtype=np.int64), self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        who = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (who[:-1] == who[1:]), self.ranks[at], len(self.made))
            rank = np.append(rank, len(self.made))
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            ended = least == len(self.made)
            counts[who[first[ended]]] = size[ended]
            chosen = (rank == np.repeat(least, size)) & (rank < len(self.made))
            # of overlapping places (a run of chosen neighbours) every other one from the left merges
            place = np.flatnonzero(chosen)
            if not len(place):
                break
            new_run = np.r_[True, place[1:] != place[:-1] + 1]
            run_at = place[new_run][np.cumsum(new_run) - 1]
            place = place[(place - run_at) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            stays = np.repeat(~ended, size)
            stays[place + 1] = False
            symbols, who = symbols[stays], who[stays]
        return counts

    def rank_of(self, pair: np.ndarray) -> np.ndarray:
        """The rank of each pair, the number of merges for those that aren't merged."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.made))

    def count_long(self, words: list[bytes]) -> np.ndarray:
        """The same counts, for long words: an index of the places of each rank, so that a round only looks at places whose
        pair has that rank and at their neighbours, and the work follows the length of the words."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        last = np.cumsum(lengths) - 1
        after = np.arange(1, len(symbols) + 1)
        after[last] = -1
        before = np.arange(-1, len(symbols) - 1)
        before[last[:-1] + 1] = -1
        stays, places, waiting = np.ones(len(symbols), bool), {}, []

        def index(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.rank_of(symbols[at] * self.size + symbols[after[at]])
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.r_[np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]), len(rank)] if len(rank) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if (r := int(rank[a])) < len(self.made):
                    if r not in places:
                        heapq.heappush(waiting, r)
                    places.setdefault(r, []).append(at[a:b])

        index(np.arange(len(symbols)))
        while waiting:
            rank = heapq.heappop(waiting)
            place = np.unique(np.concatenate(places.pop(rank)))
            place = place[stays[place] & (after[place] >= 0)]
            place = place[symbols[place] * self.size + symbols[after[place]] == self.pairs[rank]]
            if not len(place):
                continue
            new_run = np.r_[True, place[1:] != after[place[:-1]]]  # of overlapping places every other one merges
            nth = np.arange(len(place))
            place = place[(nth - nth[new_run][np.cumsum(new_run) - 1]) % 2 == 0]
            gone = after[place]
            symbols[place], stays[gone], after[place] = self.made[rank], False, after[gone]
            right = after[place]
            before[right[right >= 0]] = place[right >= 0]
            left = before[place]
            index(np.union1d(place, left[left >= 0]))
        return np.add.reduceat(stays.astype(np.int64), last - lengths + 1)

    def counts_of(self, words: list[str]) -> int:
        """Symbols of the words of a text, all of which that are not long have been learned."""
        long = [w.encode() for w in words if len(w) >= LONG]
        short = sum(map(self.known.__getitem__, (w for w in words if len(w) < LONG) if long else words))
        return short + (int(self.count_long(long).sum()) if long else 0)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        held = list(words)
        for i in range(0, len(held), BATCH):
            part = held[i : i + BATCH]
            self.known.update(zip(part, self.count([w.encode() for w in part]).tolist(), strict=True))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, as the library for the vocabulary file counts its text.

    Each special string of the vocabulary inside a text is one token and parts what stands around it. Null and empty
    texts have no tokens. Rows are counted one by one, whole however long, repeated or not; ids may be null, other columns
    of any name play no part, and an empty table gives no rows. The file must be readable at ``path`` on every executor and
    hold a plain byte-level BPE; another one is an error.
    """
    where = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, find = Merger(where), regex.compile(PATTERN).findall
        special = regex.compile("|".join(regex.escape(s) for s in sorted(merger.special, key=len, reverse=True))) if merger.special else None
        for batch in batches:
            sizes, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in pieces(batch.column("text")):
                whole = data.tobytes()
                rows, wanted = [], set()
                for i in range(hi - lo):
                    text = whole[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                    parts = special.split(text) if special and any(s in text for s in merger.special) else [text]
                    words = [w for p in parts for w in find(p)] if len(parts) > 1 else find(text)
                    rows.append((words, len(parts) - 1))
                    wanted.update(words)
                wanted = {w for w in wanted if len(w) < LONG}
                sizes[lo:hi] = np.diff(offsets)
                merger.learn({w for w in wanted if w not in merger.known} if len(merger.known) + len(wanted) <= REMEMBERED else wanted)
                counts[lo:hi] = [merger.counts_of(words) + n for words, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Token counts of each document, and whether they are over ``limit``; see ``token_counts``."""
    found = token_counts(docs, path)
    return found.withColumn("over_limit", found["n_tokens"] > limit)
