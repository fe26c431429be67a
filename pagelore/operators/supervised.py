"""Labelled datasets, the linear classifier over embeddings, and its metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.scores import softmax
from pagelore.functions.text import MIN_CHARS_SUPERVISED, skip_reason
from pagelore.functions.vectors import dot, doubles
from pagelore.sources.files import numbered


def check_shares(train: float, val: float, test: float) -> None:
    if train <= 0 or val < 0 or test < 0 or abs(train + val + test - 1) > 1e-6:
        raise ValueError("shares must be positive for training, not negative for the others, and sum to 1")


#: Leading hex digits of a digest that cut a label's seeded order into pieces.
PIECE_DIGITS = 3


def shuffled_ranks(rows: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds "rank", the number of a row in its label's seeded order, and "n_label", how many rows the label has.

    Digests are spread evenly, so their first digits cut every label into pieces of like size: a row's number is that
    within its piece and the sizes of the pieces before, and no task sorts a whole label.
    """
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    held = rows.withColumn("digest", digest).withColumn("piece", F.substring("digest", 1, PIECE_DIGITS))
    whole = Window.partitionBy(label)  # a row a piece
    sizes = held.groupBy(label, "piece").agg(F.count("*").alias("n_piece"))
    pieces = sizes.select(label, "piece", (F.sum("n_piece").over(whole.orderBy("piece")) - F.col("n_piece")).alias("before"), F.sum("n_piece").over(whole).alias("n_label"))
    number = F.row_number().over(Window.partitionBy(label, "piece").orderBy("digest", key))
    return held.join(pieces, [label, "piece"]).withColumn("rank", F.col("before") + number).drop("digest", "piece", "before")


def split(rows: DataFrame, key: str, label: str, seed: int = 42, balance: bool = True, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds "split" (train, val, test) and "number" within label and split.

    Each label's rows in seeded order: the first floor(n * train) train, the next floor(n * val) validate, the rest test;
    with ``balance`` every label has as many rows as the smallest.
    """
    check_shares(train, val, test)
    least = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_label")).agg(F.min("n_label").alias("n_least"))
    held = shuffled_ranks(rows, key, label, seed).join(F.broadcast(least), F.lit(True))  # one row
    n = F.col("n_least") if balance else F.col("n_label")
    a, b = F.floor(n * train), F.floor(n * train) + F.floor(n * val)
    part = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "val").otherwise("test")
    before = F.when(part == "train", F.lit(0)).when(part == "val", a).otherwise(b)
    out = held.where(F.col("rank") <= n).withColumn("split", part).withColumn("number", (F.col("rank") - before).cast("int"))
    return out.drop("rank", "n_label", "n_least")


def split_counts(parts: DataFrame, label: str) -> DataFrame:
    return parts.groupBy("split", label).agg(F.count("*").alias("n"))


def usable(samples: DataFrame, text: str, least: int = MIN_CHARS_SUPERVISED) -> tuple[DataFrame, DataFrame]:
    """(samples of enough text, skipped ones with the reason)."""
    held = samples.withColumn("reason", skip_reason(F.col(text), least, "text_too_short"))
    return held.where("reason is null").drop("reason"), held.where("reason is not null")


def label_ids(rows: DataFrame, label: str) -> DataFrame:
    """(label, label_id): ids from 0 in order of the labels. One small row a label."""
    held = F.array_sort(F.collect_set(F.col(label)))
    return rows.agg(held.alias("all")).select(F.posexplode("all").alias("label_id", label)).select(label, "label_id")


def centroid_weights(vectors: DataFrame, label: str, means: DataFrame) -> DataFrame:
    """(label_id, label, weights, bias) from mean vectors (label, mean): a linear classifier with fixed weights."""
    ids = label_ids(vectors, label)
    return means.join(ids, label).select("label_id", label, F.col("mean").alias("weights"), (-0.5 * dot(F.col("mean"), F.col("mean"))).alias("bias"))


def predicted(vectors: DataFrame, weights: DataFrame, doc: str, vec: str, label: str) -> DataFrame:
    """(doc, label, label_id, logits, probabilities, labels): the first class of the highest logit.

    Weights are a row a class; put together in one row, so each vector is scored where it lies, repeated ids and all.
    """
    classes = weights.agg(F.array_sort(F.collect_list(F.struct("label_id", F.col(label).alias("name"), "weights", "bias"))).alias("c"))
    held = vectors.select(doc, doubles(F.col(vec)).alias("x")).crossJoin(F.broadcast(classes))  # one row
    held = held.withColumn("logits", F.transform("c", lambda c: dot(c["weights"], F.col("x")) + c["bias"])).withColumn("probabilities", softmax(F.col("logits")))
    best = F.element_at("c", F.array_position("logits", F.array_max("logits")).cast("int"))
    return held.select(doc, best["name"].alias(label), best["label_id"].alias("label_id"), "logits", "probabilities", F.transform("c", lambda c: c["name"]).alias("labels"))


def checked_labels(rows: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """``rows`` with the label_id of their label; a label that isn't among the known ones fails the job."""
    held = rows.join(known.select(label, "label_id"), label, "left")
    return held.withColumn("label_id", F.when(F.col("label_id").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")).otherwise(F.col("label_id")))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def macro_metrics(rows: DataFrame, truth: str, guess: str, labels: DataFrame, label: str) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1 over all labels; 0 where undefined."""
    cells = confusion(rows, truth, guess)
    long = cells.select(F.col(truth).alias("t"), F.col(guess).alias("g"), "n")
    tall = long.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t"), (F.col("t") == F.col("g")).cast("int").alias("ok"), "n"), F.struct(F.col("g").alias("c"), F.lit(0).alias("is_t"), F.lit(0).alias("ok"), "n"))).alias("x")).select("x.*")
    per = tall.groupBy("c").agg(F.sum(F.col("n") * F.col("is_t")).alias("support"), F.sum(F.col("n") * (1 - F.col("is_t"))).alias("guessed"), F.sum(F.col("n") * F.col("ok")).alias("tp"))
    held = labels.select(F.col(label).alias("c")).join(per, "c", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    each = held.withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    out = each.agg(F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))
    return out.select(*[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def best_epoch(history: DataFrame, epoch: str, key: str) -> DataFrame:
    """The latest epoch of the highest key."""
    return history.agg(F.max(F.struct(key, epoch)).alias("b")).select(F.col(f"b.{epoch}").alias(epoch), F.col(f"b.{key}").alias(key))


def evaluation_loss(rows: DataFrame, order: str, loss: str, batch: int) -> DataFrame:
    """Mean of batch means in order of position, and the plain mean. Rows are numbered by ranges, no task sorts them all."""
    held = numbered(rows.select(F.col(f"`{order}`").alias("at"), F.col(f"`{loss}`").alias("loss")), (), "at")
    means = held.groupBy(F.floor((F.col("number") - 1) / batch)).agg(F.avg("loss").alias("m"), F.sum("loss").alias("s"), F.count("loss").alias("n"))
    return means.agg(F.avg("m").alias("batch_loss"), (F.sum("s") / F.sum("n")).alias("mean_loss"))


def fit(vectors: DataFrame, vec: str, label: str, epochs: int = 25, decay: float = 0.01) -> tuple[LogisticRegressionModel, DataFrame]:
    """(model, label ids) of a softmax head over embeddings; needs two labels."""
    ids = label_ids(vectors, label)
    if ids.count() < 2:
        raise ValueError("at least two labels are needed")
    held = vectors.join(ids, label).select(F.col("label_id").cast("double").alias("label_id"), array_to_vector(doubles(F.col(vec))).alias("features"))
    return LogisticRegression(featuresCol="features", labelCol="label_id", maxIter=epochs, regParam=decay, family="multinomial").fit(held), ids


def apply_fit(model: LogisticRegressionModel, ids: DataFrame, vectors: DataFrame, doc: str, vec: str, label: str) -> DataFrame:
    held = model.transform(vectors.withColumn("features", array_to_vector(doubles(F.col(vec)))))
    out = held.select(doc, F.col("prediction").cast("int").alias("label_id"), vector_to_array("probability").alias("probabilities"))
    return out.join(ids.withColumnRenamed(label, f"{label}_pred"), "label_id")
