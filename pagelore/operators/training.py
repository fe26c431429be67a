"""Training of the linear classifier in seeded mini-batches, with a history, a checkpoint an epoch and a report."""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.vectors import doubles
from pagelore.operators.jobs import load_classifier, save_classifier
from pagelore.operators.supervised import checked_labels, label_ids

SPLITS = ("train", "val", "test")
#: Depth of the tree in which the sums of partitions meet.
DEPTH = 2
_HISTORY = "epoch int, train_loss_batch_mean double, train_loss double, train_accuracy double, train_macro_f1 double, val_loss double, val_accuracy double, val_macro_f1 double, val_count long, selection_key double"


@dataclass(frozen=True)
class Options:
    """A batch has ``batch`` rows, or as many more as leave ``most_steps`` batches an epoch: each one is a Spark job."""

    epochs: int = 20
    batch: int = 256
    most_steps: int = 32
    rate: float = 1e-3
    decay: float = 0.01
    dropout: float = 0.0
    seed: int = 42
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8


@dataclass
class State:
    """Weights with the bias as their last column, the moments of their gradients, and the steps taken."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @staticmethod
    def new(classes: int, size: int, seed: int) -> State:
        edge = 1 / math.sqrt(size)
        weights = np.random.default_rng(seed).uniform(-edge, edge, (classes, size + 1))
        return State(weights, np.zeros_like(weights), np.zeros_like(weights))

    def stepped(self, gradient: np.ndarray, o: Options) -> State:
        """One step of Adam with decoupled decay."""
        t = self.steps + 1
        first = o.betas[0] * self.first + (1 - o.betas[0]) * gradient
        second = o.betas[1] * self.second + (1 - o.betas[1]) * gradient**2
        move = first / (1 - o.betas[0] ** t) / (np.sqrt(second / (1 - o.betas[1] ** t)) + o.eps)
        return State(self.weights * (1 - o.rate * o.decay) - o.rate * move, first, second, t)


def kept_inputs(names: np.ndarray, size: int, step: int, o: Options) -> np.ndarray:
    """What dropout multiplies inputs with: 0, or 1 over the share that stays, by row, place and step, wherever a row lies."""
    if not o.dropout:
        return np.ones((len(names), size))
    h = names.astype(np.uint64)[:, None] ^ (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    h ^= np.uint64((step * 0x632BE59BD9B4E019 + o.seed * 0xD1342543DE82EF95) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)) / 2.0**53 >= o.dropout) / (1 - o.dropout)


def losses(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each row, probabilities)."""
    z = x @ weights[:, :-1].T + weights[:, -1]
    z -= z.max(1, keepdims=True)
    log = z - np.log(np.exp(z).sum(1, keepdims=True))
    return -log[np.arange(len(y)), y], np.exp(log)


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of the gradient and of the losses over the rows."""
    loss, p = losses(x, y, weights)
    p[np.arange(len(y)), y] -= 1
    return np.hstack((p.T @ x, p.sum(0)[:, None])), float(loss.sum())


def summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sums over all rows of the arrays ``of(names, cells, x, y)``: one set a partition, added in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                names, cells, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                x = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = _added(total, of(names, cells, x, y))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["total"])

    parts = rows.select("name", "cell", "x", "label_id").mapInArrow(run, "total binary")
    return parts.rdd.treeAggregate(None, lambda held, row: _added(held, pickle.loads(row[0])), lambda a, b: b if a is None else _added(a, b), depth=DEPTH)


def _added(a: list[np.ndarray] | None, b: list[np.ndarray] | None) -> list[np.ndarray] | None:
    return a if b is None else b if a is None else [x + y for x, y in zip(a, b, strict=True)]


def prepare(rows: DataFrame, path: str, key: str, vec: str, label: str, o: Options) -> dict:
    """Writes (split, cell, name, x, label_id) under ``path``: the batches that every epoch goes through, read by folder.

    Classes are the labels of the training rows, two at least; another label in val or test fails the job, as do null
    labels and splits that aren't among SPLITS. Vectors must have one length. Returns the facts that training needs.
    """
    train = rows.where(F.col("split") == "train")
    ids = label_ids(train.where(F.col(label).isNotNull()), label)
    names = [r[label] for r in ids.orderBy("label_id").collect()]  # a row a class
    if len(names) < 2:
        raise ValueError("at least two labels are needed")
    counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if set(counts) - set(SPLITS):
        raise ValueError(f"unknown splits: {sorted(map(str, set(counts) - set(SPLITS)))}")
    steps = max(1, min(o.most_steps, math.ceil(counts["train"] / o.batch)))
    name = F.xxhash64(F.col(key).cast("string"))
    held = checked_labels(rows, label, ids).select("split", F.pmod(F.xxhash64(name, F.lit(o.seed)), F.lit(steps)).cast("int").alias("cell"), name.alias("name"), doubles(F.col(vec)).alias("x"), "label_id")
    held.repartition("split", "cell", F.pmod("name", F.lit(max(1, -(-counts["train"] // (steps * 1_000_000)))))).write.partitionBy("split", "cell").parquet(f"{path}/batches")
    sizes = held.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if sizes.a != sizes.b or sizes.a < 1:
        raise ValueError(f"vectors have from {sizes.a} to {sizes.b} entries")
    return {"labels": names, "size": sizes.a, "steps": steps, "counts": {s: counts.get(s, 0) for s in SPLITS}}


def metrics(confusion: np.ndarray) -> dict[str, float]:
    """Accuracy and macro precision, recall and F1 of counts (truth, guess); 0 where undefined."""
    hit, truth, guess = np.diag(confusion).astype(float), confusion.sum(1), confusion.sum(0)
    p, r = hit / np.maximum(guess, 1), hit / np.maximum(truth, 1)
    f1 = 2 * p * r / np.where(p + r > 0, p + r, 1)
    return {"accuracy": float(hit.sum() / max(1, confusion.sum())), "macro_precision": float(p.mean()), "macro_recall": float(r.mean()), "macro_f1": float(f1.mean())}


def evaluated(rows: DataFrame, weights: np.ndarray, steps: int) -> dict[str, float | int | None]:
    """Metrics, the mean loss and the mean of the batches' means (batch_loss); without rows zeros and null losses."""
    sent, classes = rows.sparkSession.sparkContext.broadcast(weights), len(weights)

    def of(_: np.ndarray, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        loss, p = losses(x, y, sent.value)
        pairs = np.bincount(y * classes + p.argmax(1), minlength=classes * classes)
        return [pairs.reshape(classes, classes), np.bincount(cells, loss, steps), np.bincount(cells, minlength=steps)]

    confusion, loss, n = summed(rows, of) or [np.zeros((classes, classes)), np.zeros(steps), np.zeros(steps)]
    there = n > 0
    return metrics(confusion) | {"count": int(n.sum()), "loss": float(loss.sum() / n.sum()) if there.any() else None, "batch_loss": float((loss[there] / n[there]).mean()) if there.any() else None}


def _epochs(spark: SparkSession, path: str) -> dict[int, str]:
    """The epochs that are there whole."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/epochs")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n[6:]): f"{path}/epochs/{n}" for n in names if n.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/epochs/{n}/_SUCCESS"))}


def _state(spark: SparkSession, folder: str) -> State:
    row = spark.read.parquet(folder).first()
    return State(*(np.frombuffer(bytes(row[n])).reshape(row.classes, -1).copy() for n in ("weights", "first", "second")), row.steps)


def history(spark: SparkSession, path: str) -> DataFrame:
    """A row an epoch, as its checkpoint has it."""
    held = [spark.read.parquet(f) for _, f in sorted(_epochs(spark, path).items())]
    rows = [json.loads(f.select("said").first().said) for f in held]  # one row an epoch
    return spark.createDataFrame(rows, _HISTORY)


def best_epoch(rows: list[dict]) -> int:
    """The latest epoch of the highest key."""
    return max(rows, key=lambda r: (r["selection_key"], r["epoch"]))["epoch"]


def fit_history(rows: DataFrame, path: str, key: str, vec: str, label: str, options: Options | None = None) -> DataFrame:
    """Trains on ``rows`` (split, key, vec, label), keeps an epoch's state under ``path`` after each, and returns the history.

    An epoch goes once through all training rows, a batch after the other in an order that seed and epoch set; each batch's
    gradient is the mean over its rows, summed where they lie. After it train and val are evaluated; the key that selects
    an epoch is the macro F1 of val, or of train where val is empty. A job that was stopped goes on after the last whole
    epoch if it is started again with the same path, rows and options. At the end the best epoch's classifier is stored, as
    ``jobs.load_classifier`` reads it.
    """
    o, spark = options or Options(), rows.sparkSession
    done = _epochs(spark, path)
    facts = _facts(spark, path)
    if facts is None:
        facts = prepare(rows, path, key, vec, label, o)
        spark.createDataFrame([(json.dumps(facts | {"options": asdict(o)}),)], "said string").coalesce(1).write.text(f"{path}/facts")
    batches = spark.read.schema("name long, x array<double>, label_id int, split string, cell int").parquet(f"{path}/batches")
    train, val = batches.where("split = 'train'"), batches.where("split = 'val'")
    state = _state(spark, done[max(done)]) if done else State.new(len(facts["labels"]), facts["size"], o.seed)
    for epoch in range(max(done, default=0) + 1, o.epochs + 1):
        told = []
        for cell in np.random.default_rng((o.seed, epoch)).permutation(facts["steps"]).tolist():
            sent, step = spark.sparkContext.broadcast(state.weights), state.steps

            def of(names: np.ndarray, _: np.ndarray, x: np.ndarray, y: np.ndarray, sent=sent, step=step) -> list[np.ndarray]:
                total, loss = gradient(x * kept_inputs(names, x.shape[1], step, o), y, sent.value)
                return [total, np.array([loss, len(y)])]

            if (found := summed(train.where(F.col("cell") == cell), of)) is not None:
                state = state.stepped(found[0] / found[1][1], o)
                told.append(found[1][0] / found[1][1])
            sent.unpersist()
        a, b = evaluated(train, state.weights, facts["steps"]), evaluated(val, state.weights, facts["steps"])
        said = {"epoch": epoch, "train_loss_batch_mean": float(np.mean(told)), "train_loss": a["loss"], "train_accuracy": a["accuracy"], "train_macro_f1": a["macro_f1"], "val_loss": b["loss"], "val_accuracy": b["accuracy"], "val_macro_f1": b["macro_f1"], "val_count": b["count"], "selection_key": b["macro_f1"] if b["count"] else a["macro_f1"]}
        row = (json.dumps(said), len(state.weights), state.steps, *(bytearray(m.tobytes()) for m in (state.weights, state.first, state.second)))
        spark.createDataFrame([row], "said string, classes int, steps int, weights binary, first binary, second binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/epochs/epoch={epoch}")
    told = history(spark, path)
    best = best_epoch([r.asDict() for r in told.collect()])
    weights = _state(spark, _epochs(spark, path)[best]).weights
    rows_of = [(i, str(n), w[:-1].tolist(), float(w[-1])) for i, (n, w) in enumerate(zip(facts["labels"], weights, strict=True))]
    model = f"{path}/model-{max(_epochs(spark, path))}"
    if not _exists(spark, f"{model}/meta/_SUCCESS"):
        save_classifier(spark.createDataFrame(rows_of, "label_id int, label string, weights array<double>, bias double"), model, {"best_epoch": str(best), "options": json.dumps(asdict(o))})
    return told.withColumn("best", F.col("epoch") == best)


def fitted(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(weights, meta) of the classifier that ``fit_history`` stored last."""
    return load_classifier(spark, f"{path}/model-{max(_epochs(spark, path))}")


def fitted_report(spark: SparkSession, path: str) -> DataFrame:
    """(split, count, loss, batch_loss, accuracy, macro precision, recall and F1, best_epoch) of the stored classifier."""
    facts = _facts(spark, path)
    weights, meta = fitted(spark, path)
    matrix = np.array([[*r.weights, r.bias] for r in weights.orderBy("label_id").collect()])  # a row a class
    batches = spark.read.schema("name long, x array<double>, label_id int, split string, cell int").parquet(f"{path}/batches")
    rows = [{"split": s, "best_epoch": int(meta["best_epoch"])} | evaluated(batches.where(F.col("split") == s), matrix, facts["steps"]) for s in SPLITS]
    return spark.createDataFrame(rows, "split string, best_epoch int, count long, loss double, batch_loss double, accuracy double, macro_precision double, macro_recall double, macro_f1 double")


def _exists(spark: SparkSession, path: str) -> bool:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held)


def _facts(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/facts").first().value) if _exists(spark, f"{path}/facts/_SUCCESS") else None
