"""A model stage: texts are encoded in batches by an encoder that each Python worker loads once and that backs off."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.functions.text import MAX_ENCODED, MIN_CHARS, TOKEN, normalized
from pagelore.operators.jobs import backing_off
from pagelore.operators.paradigm import MIN_DIM

Encoder = Callable[[list[str]], np.ndarray]
#: Texts that an encoder gets at once at first.
BATCH = 32
_LOADED: dict[str, Any] = {}


def hash_counts(dim: int = 64) -> Encoder:
    """The stand-in encoder of ``paradigm.hash_encoder`` as a model: counts of hashed tokens at length 1."""
    pattern = re.compile(TOKEN)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for token in pattern.findall(text.lower()):
                row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(size > 0, size, 1)

    return encode


def encoded(df: DataFrame, text: str, load: Callable[[], Encoder], batch: int = BATCH, too_much: tuple[type[BaseException], ...] = (MemoryError,), vec: str = "vec", used: str = "batch_used") -> DataFrame:
    """``df`` without ``text``, with ``vec`` and ``used``, the size of the batch in which the row was encoded.

    ``load`` makes the encoder, once in a worker, however many tasks the worker has. Texts go to it in batches, nulls as
    empty texts; while it runs out of memory (``too_much``) the batch is halved, and the smaller size stays for the rest of
    the task; a single text that is too much fails the job. An encoder that gives another number of vectors than of texts,
    or vectors of fewer than MIN_DIM entries or with non-finite ones, fails the job. No row is moved.
    """
    token, names = uuid.uuid4().hex, [c for c in df.columns if c not in (text, vec, used)]
    held = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("b", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _LOADED:
            _LOADED.clear()  # a worker that serves another job lets the last model go
            _LOADED[token] = load()
        encoder, size = _LOADED[token], batch

        def slices(texts: list[str], most: int) -> list:
            nonlocal size
            size, out = most, []
            for lo in range(0, len(texts), most):
                part = texts[lo : lo + most]
                vectors = np.asarray(encoder(part), dtype=np.float64)
                if vectors.ndim != 2 or len(vectors) != len(part) or vectors.shape[1] < MIN_DIM or not np.isfinite(vectors).all():
                    raise ValueError(f"the encoder gave an array of shape {vectors.shape} for {len(part)} texts, or numbers that aren't finite")
                out += [(v, most) for v in vectors]
            return out

        for rows in batches:
            texts = rows.column(rows.num_columns - 1).to_pylist()
            found = []
            for lo in range(0, len(texts), 16 * batch):  # what is done again when a batch was too much
                found += backing_off(slices, texts[lo : lo + 16 * batch], size, too_much)
            vectors = pa.array([v for v, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], vectors, pa.array([b for _, b in found], pa.int32())], schema.names)

    return held.mapInArrow(run, schema).toDF(*names, vec, used)


def encoded_covers(docs: DataFrame, doc: str, text: str, load: Callable[[], Encoder] = hash_counts, min_chars: int = MIN_CHARS, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc, *carry, vec, batch_used) of covers of enough text, of which the encoder gets the first MAX_ENCODED characters, as
    much as a model takes; the rest are left out before it runs."""
    whole = normalized(F.col(text))
    held = docs.select(doc, *carry, whole.alias(text)).where(F.length(text) >= min_chars)
    return encoded(held.withColumn(text, F.substring(text, 1, MAX_ENCODED)), text, load, **options)
