"""Live search: new documents are scored against the catalog as they arrive."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelore.operators.search import find_docs


def live_search(spark: SparkSession, folder: str, schema: str, paradigms: DataFrame, tag: str, doc: str, vec: str) -> DataFrame:
    """A streaming frame: the stateless join of arriving vectors (Parquet files in ``folder``) with the static catalog."""
    return find_docs(spark.readStream.schema(schema).parquet(folder), paradigms, tag, doc, vec)


def write_hits(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Passing rows as Parquet, each once."""
    return results.where("pass_threshold").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark: SparkSession, folder: str, batch: int) -> int | None:
    """The last whole batch before ``batch`` that ``folder`` holds: one whose writer left its mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "batch=*/_SUCCESS"))
    numbers = [int(m.getPath().getParent().getName().split("=")[1]) for m in marks]
    return max((n for n in numbers if n < batch), default=None)


def _add_batch(rows: DataFrame, batch: int, out: str, doc: str, last: int) -> None:
    spark = rows.sparkSession
    hits, logged, sums = (f"{out}/{name}/batch={batch}" for name in ("hits", "last", "totals"))
    rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
    rows = spark.read.parquet(f"{out}/rows/batch={batch}")
    rows.where("pass_threshold").write.mode("overwrite").parquet(hits)
    newest = rows.select(F.lit(batch).cast("long").alias("of_batch"), *rows.columns)
    counts = rows.agg(F.count("*").alias("total"), F.count_if("pass_threshold").alias("found"))
    before = _before(spark, f"{out}/totals", batch)
    if before is not None:
        newest = newest.unionByName(spark.read.parquet(f"{out}/last/batch={before}"))
        counts = counts.unionByName(spark.read.parquet(f"{out}/totals/batch={before}").select("total", "found")).agg(F.sum("total").alias("total"), F.sum("found").alias("found"))
    newest.orderBy(F.col("of_batch").desc(), F.col(doc).desc()).limit(last).write.mode("overwrite").parquet(logged)
    ratio = F.round(F.coalesce(F.try_divide("found", "total"), F.lit(0.0)), 6)
    # the totals come last: a batch that has them is whole, one that has not is written anew by the same number
    counts.withColumn("found_ratio", ratio).write.mode("overwrite").parquet(sums)


def write_totals(results: DataFrame, out: str, checkpoint: str, doc: str, last: int = 15) -> StreamingQuery:
    """Live search with running totals: every batch adds its scored rows and hits, the number of documents seen and found
    since the start, and the ``last`` rows. A batch that was cut off is done again under its number and overwrites what it
    left, so a stream that is stopped at any point goes on with the same totals."""
    return results.writeStream.foreachBatch(partial(_add_batch, out=out, doc=doc, last=last)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_state(spark: SparkSession, out: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """(totals, last rows with the newest first) after the last whole batch."""
    batch = _before(spark, f"{out}/totals", 1 << 62)
    if batch is None:
        raise FileNotFoundError(f"no batch is whole in {out}")
    newest = spark.read.parquet(f"{out}/last/batch={batch}").orderBy(F.col("of_batch").desc(), F.col(doc).desc())
    return spark.read.parquet(f"{out}/totals/batch={batch}"), newest
