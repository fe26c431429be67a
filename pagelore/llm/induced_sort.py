"""Suffix sorting by induction through queues that spill to disk, with common-prefix flags to a given depth."""

from __future__ import annotations

import os
import tempfile

import numpy as np

from pagelore.llm.blocks import alike

#: Queued positions that stay in memory.
MEMORY = 4 << 20


class SpillingQueue:
    """A priority queue of suffix positions: by first letter, then in the order of arrival.

    Induction inserts suffixes in their final order within a letter, so the order of arrival is their rank. When more than
    ``memory`` positions wait, all but the letter in work go to a file of their letter in a temporary folder of the task.
    """

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.rows = memory, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.folder: tempfile.TemporaryDirectory | None = None
        self.spilled: set[int] = set()

    def push(self, letter: int, positions: np.ndarray) -> None:
        self.held.setdefault(letter, []).append(positions)
        self.rows += len(positions)
        if self.rows > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced")
        for letter, parts in self.held.items():
            with open(os.path.join(self.folder.name, str(letter)), "ab") as f:
                for p in parts:
                    f.write(p.astype(np.int64).tobytes())
            self.spilled.add(letter)
        self.held, self.rows = {}, 0

    def pop(self, letter: int) -> np.ndarray:
        """All positions that wait under the letter, in order."""
        parts = self.held.pop(letter, [])
        self.rows -= sum(map(len, parts))
        if letter in self.spilled:
            self.spilled.discard(letter)
            where = os.path.join(self.folder.name, str(letter))
            parts.insert(0, np.fromfile(where, np.int64))
            os.remove(where)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def words_at(text: np.ndarray) -> np.ndarray:
    """Eight letters from each place as one number, zeros after the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out |= padded[k : len(text) + k] << np.uint64(56 - 8 * k)
    return out


def sorted_by_names(word: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in order of their next ``depth`` letters: names of eight letters, and the same again eight letters
    further on for those that are still tied."""
    if not len(places):
        return places
    order = places[np.argsort(word[places], kind="stable")]
    key = word[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    padded = np.concatenate((word, np.zeros(depth + 8, np.uint64)))
    for at in range(8, depth, 8):
        tied = np.zeros(len(order), dtype=bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        which = np.flatnonzero(tied)
        if not len(which):
            break
        key = padded[order[which] + at]
        again = np.lexsort((key, group[which]))
        order[which], key = order[which[again]], key[again]
        new = np.zeros(len(order), dtype=bool)
        new[1:] = ~same
        fresh = np.r_[False, key[1:] != key[:-1]]
        new[which[fresh]] = True
        new[0] = True
        group = np.cumsum(new) - 1
    return order


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """All places of ``text`` (uint8) in the order of their suffixes, exact in the first ``depth`` letters.

    Suffixes smaller than the next one (S) that follow a larger one (L) are sorted by names; from them a pass over the
    letters upwards induces the order of the L suffixes, and one downwards that of the S suffixes. What is induced waits
    in a spilling queue under its first letter.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    rises = np.r_[text[edge[:-1] + 1] > text[edge[:-1]], False] if n > 1 else np.array([False])
    small = np.repeat(rises, np.diff(np.r_[-1, edge]))
    starts = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    seeds = sorted_by_names(words_at(text), starts, depth)
    letter_of = text[seeds]
    larger: list[np.ndarray] = [np.zeros(0, np.int64)] * 256

    def induce(queue: SpillingQueue, places: np.ndarray, want_small: bool, letter: int) -> np.ndarray:
        """Queues the suffixes one letter to the left that are of the wanted type; returns those of the same letter."""
        before = places[places > 0] - 1
        before = before[small[before] == want_small]
        left = text[before]
        by = np.argsort(left, kind="stable")
        before, left = before[by], left[by]
        own = np.zeros(0, np.int64)
        for a, b in alike(left):
            if left[a] == letter:
                own = before[a:b]
            else:
                queue.push(int(left[a]), before[a:b])
        return own

    queue = SpillingQueue(memory)
    queue.push(int(text[-1]), np.array([n - 1]))  # the last suffix is smaller than all of its letter
    for c in range(256):
        done, now = [], queue.pop(c)
        while len(now):
            done.append(now)
            now = induce(queue, now, False, c)
        larger[c] = np.concatenate(done) if done else larger[c]
        induce(queue, seeds[letter_of == c], False, c)
    queue.close()
    queue, out = SpillingQueue(memory), []
    for c in range(255, -1, -1):
        done, now = [], queue.pop(c)
        while len(now):
            done.append(now)
            now = induce(queue, now, True, c)
        out += done
        out.append(larger[c][::-1])
        induce(queue, larger[c][::-1], True, c)
    queue.close()
    return np.concatenate(out)[::-1]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``order`` but the first, how many letters up to ``depth`` it shares with the one before."""
    word = np.concatenate((words_at(text), np.zeros(depth + 8, np.uint64)))
    common = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    live = np.arange(len(common))
    for at in range(0, depth, 8):
        differ = word[order[live] + at] ^ word[order[live + 1] + at]
        ended = differ != 0
        lead = 8 - np.ceil(np.log2(differ[ended].astype(np.float64) + 1) / 8).astype(np.int64)
        lead = np.maximum(lead, 0)
        common[live[ended]] = at + lead
        live = live[~ended]
        if not len(live):
            break
    common[live] = depth
    return np.minimum(common, depth)
