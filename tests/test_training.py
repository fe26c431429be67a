import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators import supervised, training

OPTIONS = training.Options(epochs=3, batch=60, rate=0.05, dropout=0.2, seed=7)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = int(rng.integers(0, 3))
        rows.append((i, ["train", "train", "train", "val", "test"][i % 5], "abc"[y], (rng.normal(size=5) + np.eye(5)[y] * 2).tolist()))
    return rows, spark.createDataFrame(rows, "id long, split string, label string, v array<double>")


def numpy_loop(batches, o, classes, steps):
    """The same batches in one process, a row at a time."""
    edge = 1 / np.sqrt(5)
    w = np.random.default_rng(o.seed).uniform(-edge, edge, (classes, 6))
    m, s, t, said = np.zeros_like(w), np.zeros_like(w), 0, []
    for epoch in range(1, o.epochs + 1):
        means = []
        for cell in np.random.default_rng((o.seed, epoch)).permutation(steps):
            part = [r for r in batches if r.split == "train" and r.cell == cell]
            if not part:
                continue
            total, loss = np.zeros_like(w), 0.0
            for r in part:
                x = np.array(r.x) * training.kept_inputs(np.array([r.name]), 5, t, o)[0]
                z = w[:, :5] @ x + w[:, 5]
                p = np.exp(z) / np.exp(z).sum()
                loss -= np.log(p[r.label_id])
                p[r.label_id] -= 1
                total += np.outer(p, [*x, 1])
            g, t = total / len(part), t + 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - o.rate * o.decay * w - o.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            means.append(loss / len(part))
        f1 = []
        val = [r for r in batches if r.split == "val"]
        guess = [int(np.argmax(w[:, :5] @ np.array(r.x) + w[:, 5])) for r in val]
        for c in range(classes):
            tp = sum(g == c == r.label_id for g, r in zip(guess, val, strict=True))
            wrong = sum((g == c) != (r.label_id == c) for g, r in zip(guess, val, strict=True))
            f1.append(2 * tp / max(1, 2 * tp + wrong))
        said.append((float(np.mean(means)), float(np.mean(f1)), w))
    return said


def test_history_against_a_loop_and_resumption(spark, samples, tmp_path):
    _, df = samples
    path = str(tmp_path / "whole")
    got = training.fit_history(df, path, "id", "v", "label", OPTIONS).orderBy("epoch").collect()
    batches = spark.read.parquet(f"{path}/batches").collect()
    assert len(batches) == 300 and len({r.cell for r in batches}) == 3
    want = numpy_loop(batches, OPTIONS, 3, 3)
    assert [r.train_loss_batch_mean for r in got] == pytest.approx([w[0] for w in want])
    assert [r.val_macro_f1 for r in got] == pytest.approx([w[1] for w in want])
    best = [r.epoch for r in got if r.best]
    assert best == [max(range(1, 4), key=lambda e: (want[e - 1][1], e))]
    weights, meta = training.fitted(spark, path)
    held = np.array([[*r.weights, r.bias] for r in weights.orderBy("label_id").collect()])
    assert held == pytest.approx(want[best[0] - 1][2]) and meta["best_epoch"] == str(best[0])

    other = str(tmp_path / "stopped")
    training.fit_history(df, other, "id", "v", "label", dataclasses.replace(OPTIONS, epochs=2))
    again = training.fit_history(df, other, "id", "v", "label", OPTIONS).orderBy("epoch").collect()
    assert [r.train_loss_batch_mean for r in again] == pytest.approx([r.train_loss_batch_mean for r in got], rel=1e-12)

    report = {r.split: r for r in training.fitted_report(spark, path).collect()}
    assert {s: r["count"] for s, r in report.items()} == {"train": 180, "val": 60, "test": 60}
    assert report["val"].macro_f1 == pytest.approx(max(w[1] for w in want)) and report["test"].accuracy > 0.8
    told = supervised.predicted(df.where("split = 'test'"), weights, "id", "v", "label").join(df.select("id", F.col("label").alias("truth")), "id")
    assert told.where("label = truth").count() / 60 == pytest.approx(report["test"].accuracy)


def test_what_cannot_be_trained_fails(spark, samples, tmp_path):
    rows, df = samples
    with pytest.raises(ValueError, match="two labels"):
        training.fit_history(df.where("label = 'a'"), str(tmp_path / "a"), "id", "v", "label", OPTIONS)
    with pytest.raises(Exception, match="unknown label: z"):
        training.fit_history(df.union(spark.createDataFrame([(900, "val", "z", [0.0] * 5)], df.schema)), str(tmp_path / "b"), "id", "v", "label", OPTIONS)
    with pytest.raises(ValueError, match="entries"):
        training.fit_history(df.union(spark.createDataFrame([(900, "val", "a", [0.0] * 4)], df.schema)), str(tmp_path / "c"), "id", "v", "label", OPTIONS)
    with pytest.raises(ValueError, match="unknown splits"):
        training.fit_history(df.withColumn("split", F.lit("x")).union(df), str(tmp_path / "d"), "id", "v", "label", OPTIONS)


def test_without_validation_rows_and_dropout_by_row():
    assert training.metrics(np.array([[2, 0], [1, 0]])) == {"accuracy": 2 / 3, "macro_precision": 1 / 3, "macro_recall": 0.5, "macro_f1": pytest.approx(0.4)}
    assert training.best_epoch([{"epoch": e, "selection_key": k} for e, k in enumerate((0.5, 0.9, 0.9, 0.7), 1)]) == 3
    mask = training.kept_inputs(np.arange(4000), 16, 3, OPTIONS)
    assert set(np.unique(mask)) == {0.0, 1.25} and abs((mask == 0).mean() - 0.2) < 0.01
    assert (mask[17:18] == training.kept_inputs(np.array([17]), 16, 3, OPTIONS)).all()
    assert (mask != training.kept_inputs(np.arange(4000), 16, 4, OPTIONS)).any()
