"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import LOWER, crc32_of_id, give_back, mixed, pieces, plainly, utf8

#: Units in each direction, bytes in a stretch that the network reads at once.
UNITS, STRETCH = 8, 64
#: Bounds of the training sample: stretches of each language, at most about, and languages; passes, batch, step size, seed.
PER_LANGUAGE, LANGUAGES, EPOCHS, BATCH, RATE, SEED = 3000, 1000, 8, 256, 0.03, 11
#: Stretches that run in lockstep.
LOCKSTEP = 4096
#: Predictions below this pooled probability are rejected by the filter.
LEAST = 0.3
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Two gated recurrent layers, one from the left and one from the right, and a label for every position.

    For each direction: table (256, 3 units), the input's part in update gate, reset gate and candidate; and the recurrent
    weights of the gates (units, 2 units) and of the candidate (units, units). The label layer joins both directions.
    """

    def __init__(self, classes: int, units: int = UNITS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.units = units
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, (2 * units, classes)), "bias": np.zeros(classes)}
        for d in "fb":
            self.p |= {f"table_{d}": rng.normal(0, 0.3, (256, 3 * units)), f"gates_{d}": rng.normal(0, 0.3, (units, 2 * units)), f"new_{d}": rng.normal(0, 0.3, (units, units))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, units) after each byte of x (steps, rows), from the left ("f") or the right ("b")."""
        steps, rows = x.shape
        n, table, gates, new = self.units, self.p[f"table_{d}"], self.p[f"gates_{d}"], self.p[f"new_{d}"]
        out, h = np.empty((steps, rows, n), dtype=np.float32), np.zeros((rows, n), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            given = table[x[t]]
            zr = _sigmoid(given[:, : 2 * n] + h @ gates)
            z, r = zr[:, :n], zr[:, n:]
            reset = r * h
            c = np.tanh(given[:, 2 * n :] + reset @ new)
            if keep is not None:
                keep.append((t, h, z, r, reset, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        n = self.units
        return self.states(x, "f") @ self.p["out"][:n] + self.states(x, "b") @ self.p["out"][n:] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """By backpropagation through time, of the weighted cross-entropy of every position's label."""
        n, kept = self.units, {"f": [], "b": []}
        hs = {d: self.states(x, d, kept[d]) for d in "fb"}
        z = hs["f"] @ self.p["out"][:n] + hs["b"] @ self.p["out"][n:] + self.p["bias"]
        e = np.exp(z - z.max(axis=2, keepdims=True))
        g = e / e.sum(axis=2, keepdims=True)
        g[:, np.arange(len(y)), y] -= 1
        g *= weight[:, :, None] / weight.sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["bias"] = g.sum(axis=(0, 1))
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            grad["out"][part] = np.einsum("tru,trc->uc", hs[d], g)
            into = g @ self.p["out"][part].T
            back = np.zeros((x.shape[1], n), dtype=np.float32)
            gates, new = self.p[f"gates_{d}"], self.p[f"new_{d}"]
            given = np.empty((*x.shape, 3 * n), dtype=np.float32)
            for t, h, zt, r, reset, c in reversed(kept[d]):
                back = back + into[t]
                dc = back * zt * (1 - c * c)
                dz = back * (c - h) * zt * (1 - zt)
                dreset = dc @ new.T
                dr = dreset * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                grad[f"new_{d}"] += reset.T @ dc
                grad[f"gates_{d}"] += h.T @ dzr
                given[t, :, : 2 * n], given[t, :, 2 * n :] = dzr, dc
                back = back * (1 - zt) + dzr @ gates.T + dreset * r
            order = np.argsort(x, axis=None, kind="stable")
            byte = x.ravel()[order]
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            grad[f"table_{d}"][byte[first]] = np.add.reduceat(given.reshape(-1, 3 * n)[order], first, axis=0)
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
        """Adam over shuffled batches; x (rows, steps), weight (rows, steps) of each position."""
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        total = epochs * max(1, len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                grad = self.gradients(np.ascontiguousarray(x[part].T), y[part], np.ascontiguousarray(weight[part].T))
                step += 1
                now = rate * max(0.05, 1 - step / total)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def stretches(data: np.ndarray, offsets: np.ndarray, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into stretches of ``size`` bytes, the last filled with spaces: (rows, bytes), row of the text, length."""
    length = np.diff(offsets)
    count = -(-length // size)
    who = np.repeat(np.arange(len(length)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[who] + nth * size
    held = np.minimum(size, offsets[who + 1] - start) if len(who) else np.zeros(0, np.int64)
    padded = np.concatenate((LOWER[data], np.full(size, 32, np.uint8)))
    x = padded[start[:, None] + np.arange(size)]
    return np.where(np.arange(size) < held[:, None], x, 32).astype(np.uint8), who, held


class Model:
    def __init__(self, languages: list[str], network: Network | None) -> None:
        self.languages, self.network = languages, network

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): every position's label probabilities, averaged over each whole text."""
        rows, k = len(offsets) - 1, len(self.languages)
        total = np.zeros((rows, k))
        if self.network is None or not k:
            return total + 1
        x, who, held = stretches(data, offsets)
        for i in range(0, len(x), LOCKSTEP):
            part = np.ascontiguousarray(x[i : i + LOCKSTEP].T)
            z = self.network.logits(part)
            e = np.exp(z - z.max(axis=2, keepdims=True))
            e /= e.sum(axis=2, keepdims=True)
            e *= (np.arange(STRETCH)[:, None] < held[i : i + LOCKSTEP])[:, :, None]
            np.add.at(total, who[i : i + LOCKSTEP], e.sum(axis=0, dtype=np.float64))
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def trained(docs: DataFrame, folds: int = 3, out: int = 1, per_language: int = PER_LANGUAGE) -> Model:
    """A model of rows with text and lang whose crc32 of the id modulo ``folds`` isn't ``out``.

    The sample is bounded: about ``per_language`` stretches of each language, drawn by a hash of id, text and place from all
    stretches of all those rows, so every part of a text is as likely as any other. No text moves to be drawn from; only the
    drawn stretches come to the driver. Repeated rows of one id draw alike. A table without labelled rows gives a model
    without languages; one with more than ``LANGUAGES`` values of lang is an error.
    """
    stretch = F.ceil(F.octet_length("text") / STRETCH)
    fits = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & (crc32_of_id() % folds != out)).select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), F.lit(SEED)).alias("place"))
    sizes = dict(fits.groupBy("lang").agg(F.sum(stretch).cast("double")).limit(LANGUAGES + 1).collect())
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    below = {lang: np.uint64(min(1.0, per_language / n) * (2.0**64 - 2048)) for lang, n in sizes.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            names, place = batch.column("lang").to_pylist(), batch.column("place").to_numpy().view(np.uint64)
            count = -(-np.diff(offsets) // STRETCH)
            who = np.repeat(np.arange(len(names)), count)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            drawn = np.flatnonzero(mixed(place[who] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) < np.array([below[n] for n in names], np.uint64)[who])
            start = offsets[who[drawn]] + nth[drawn] * STRETCH
            end = np.minimum(start + STRETCH, offsets[who[drawn] + 1])
            spans = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in who[drawn].tolist()], pa.string()), pa.array(spans, pa.binary())], ["lang", "span"])

    sample = sorted((r.lang, bytes(r.span)) for r in fits.mapInArrow(draw, "lang string, span binary").collect())
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], None)
    data, offsets = np.frombuffer(b"".join(s for _, s in sample), np.uint8), np.concatenate(([0], np.cumsum([len(s) for _, s in sample])))
    x, who, held = stretches(data, offsets)
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[sample[i][0]] for i in who])
    weight = (np.arange(STRETCH) < held[:, None]).astype(np.float32)
    share_of = np.bincount(y, minlength=len(languages))
    weight *= (len(y) / len(languages) / share_of[y])[:, None].astype(np.float32)
    return Model(languages, Network(len(languages)).fit(x, y, weight))


#: A letter, as Unicode has it; texts without one have no language.
def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _each(batch: pa.RecordBatch, column: str, model: Model) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
    for lo, hi, data, offsets in pieces(batch.column(column)):
        chance, whole = model.probabilities(data, offsets), data.tobytes()
        for i in range(hi - lo):
            if len(model.languages) and _has_letter(whole[offsets[i] : offsets[i + 1]]):
                best = int(chance[i].argmax())
                names[lo + i], scores[lo + i] = model.languages[best], min(1.0, float(chance[i, best]))
    return names, scores


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; "und" and 0 for texts that are null or have no letter, and for all rows if
    the model has no languages.

    The score is the mean over all positions of the text, however long, of the probability of the predicted language; of
    equal ones the first in order of name wins. Every row is judged alone, so repeated rows have equal results; ids may be
    null or repeated, other columns of any name play no part, and an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _each(batch, "text", sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_a_language(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with a language: a letter, and a pooled probability of ``least`` or more.

    Rows stay as they are, with all columns, repeated or not; null and empty texts go; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _each(batch, "text", sent.value)
            yield batch.filter(pa.array((np.array(names, dtype=object) != UNKNOWN) & (scores >= least)))
        give_back()

    held, renamed = plainly(docs)
    return renamed(held.mapInArrow(run, held.schema))


def op9_language(docs: DataFrame, fit: Callable[[DataFrame], Model] = trained) -> DataFrame:
    """The language of each document by a network trained on the others; see ``trained`` and ``languages``."""
    held_out = crc32_of_id() % 3 == 1
    return languages(docs, fit(docs)).withColumn("held_out", held_out)
