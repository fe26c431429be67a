"""Sources: folders of documents, labelled trees, page features, lenient JSON; and the matching sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.sources.store import stored

#: Columns of a features file in their fixed order, all after the first three doubles.
FEATURE_FILE = "source_dir string, file string, page_index int, chars double, token_count double, fill_percent double, spaces double, whitespace double, non_whitespace double, line_count double, empty_lines double, font_count double, width_mm double, height_mm double"
SKIPS_SHOWN = 200


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, file, length, content) of a folder's documents. ``path_order`` sorts as by path components."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return held.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content")


def path_order(path: str = "path") -> Column:
    return F.split(path, "/")


def first_files(docs: DataFrame, most: int = 0) -> DataFrame:
    """All documents, or the first ``most`` by path; the limit is the feature."""
    return docs.orderBy(path_order()).limit(most) if most else docs


def labelled_tree(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(split, label, path, file, content) of folder/split/label/**; files above that are none of it."""
    rest = F.split(F.substring_index("path", folder.rstrip("/") + "/", -1), "/")
    held = documents(spark, folder, pattern, True).where(F.size(rest) >= 3)
    return held.select(F.get(rest, 0).alias("split"), F.get(rest, 1).alias("label"), "path", "file", "content")


def page_texts(docs: DataFrame, parse: Callable[[bytes], list[str]], strict: bool = False) -> DataFrame:
    """(path, file, page_index, text) by a parser of file contents. A file that fails has no pages, or fails the job."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for path, file, content in zip(batch["path"], batch["file"], batch["content"], strict=True):
                try:
                    rows += [(path, file, i, t or "") for i, t in enumerate(parse(bytes(content)))]
                except Exception:
                    if strict:
                        raise
            yield pd.DataFrame(rows, columns=["path", "file", "page_index", "text"])

    return docs.select("path", "file", "content").mapInPandas(run, "path string, file string, page_index int, text string")


def page_of(docs: DataFrame, pages: DataFrame, index: int = 0) -> DataFrame:
    """One page's text of every document, empty where there is none."""
    held = pages.where(F.col("page_index") == index).select("path", "text")
    return docs.join(held, "path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_FILE).csv(path, header=True)


def write_features(pages: DataFrame, path: str) -> None:
    kinds = [f.split() for f in FEATURE_FILE.split(", ")]
    pages.select(*[F.format_string("%.6f", F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in kinds]).write.mode("errorifexists").csv(path, header=True)


def lenient_json(text: Column, schema: str) -> Column:
    """The parsed struct, all null where the text isn't JSON of that shape."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def write_split_tree(parts: DataFrame, label: str, path: str, overwrite: bool = False) -> None:
    """The rows under path/split=/label=; refuses a folder that is there unless told to overwrite."""
    parts.write.partitionBy("split", label).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_manifest(parts: DataFrame, path: str) -> None:
    parts.select("label", "split", "src_abs", "src_name", "dst_name", "dst_abs").write.mode("errorifexists").csv(path, header=True)


def skips(rows: DataFrame, key: str, most: int = SKIPS_SHOWN) -> DataFrame:
    """The first skipped rows for a sidecar report."""
    return rows.orderBy(key).limit(most)


def numbered(rows: DataFrame, groups: tuple[str, ...], order: Column | str) -> DataFrame:
    """Adds "number": each row's place, from 1, in the order of its group.

    Rows are dealt by ranges of group and order and stored; a row's number is its place within its part and the sizes of the
    group's parts before, so no task sorts a whole group. Rows of equal order are numbered in any way, null groups are one.
    """
    at = F.col(order) if isinstance(order, str) else order
    keys = [F.col(f"`{g}`") for g in groups]
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.struct(F.lit(0), *keys).alias("group"), at.alias("at"))
    held = stored(held.repartitionByRange("group", "at").sortWithinPartitions("group", "at").select("row", "group"))
    held = held.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33))
    sizes = held.groupBy("group", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")  # a row a part
    out = held.join(sizes.select("group", "part", "first", before.alias("before")), ["group", "part"])
    return out.select("row.*", (F.col("place") - F.col("first") + F.col("before") + 1).alias("number"))


def resolved_path(listing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds "resolved" to the rows (key, path, source_dir, file): the first of path, source_dir/file, file that the listing
    (path) has. One join for all three; ``key`` names a row."""
    tries = F.posexplode(F.array("path", F.concat_ws("/", "source_dir", "file"), "file")).alias("rank", "p")
    hits = rows.select(key, tries).join(listing.select(F.col("path").alias("p")).distinct(), "p")
    return rows.join(hits.groupBy(key).agg(F.min_by("p", "rank").alias("resolved")), key, "left")
