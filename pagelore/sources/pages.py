"""Folders of documents as a Spark data source: a row a page, groups of files a partition, errors as rows with reasons."""

from __future__ import annotations

import fnmatch
import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, file string, page_index int, text string, status string, reason string"
#: Bytes of files in a partition; a larger file is a partition of its own.
GROUP = 32 << 20
#: What a page's status may be: read; a file without such a page; a page, or a whole file, that failed.
STATUSES = ("ok", "page_out_of_range", "unreadable_page", "unreadable_file")


def form_feed_pages(content: bytes) -> list[str]:
    """The default parser: pages of UTF-8 text parted by form feeds; what follows the last one is a page if it isn't empty."""
    pages = content.decode("utf-8").split("\f")
    return pages if pages[-1] else pages[:-1]


@dataclass
class Files(InputPartition):
    paths: list[str]


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.recursive, self.strict = (options.get(o, "false").lower() == "true" for o in ("recursive", "strict"))
        self.parser, self.group = options.get("parser", f"{__name__}:form_feed_pages"), int(options.get("group", GROUP))
        self.wanted = sorted({int(p) for p in options["page"].split(",")}) if "page" in options else None

    def partitions(self) -> list[Files]:
        fs, root = _opened(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=self.recursive))
        held = sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", ".")))
        if not held:
            raise ValueError(f"no {self.pattern} in {self.folder}")
        out, room = [], 0
        for path, size in held:
            if not out or room + size > self.group:
                out.append(Files([]))
                room = 0
            out[-1].paths.append(path)
            room += size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        module, name = self.parser.split(":")
        parse, (fs, _) = getattr(importlib.import_module(module), name), _opened(self.folder)
        for path in partition.paths:
            file = path.rsplit("/", 1)[-1]
            try:
                with fs.open_input_stream(path, compression=None) as f:
                    pages = parse(f.read())
                count = len(pages)
            except Exception as e:
                if self.strict:
                    raise
                yield path, file, None, None, "unreadable_file", f"{type(e).__name__}: {e}"
                continue
            for i in range(count) if self.wanted is None else self.wanted:
                if not 0 <= i < count:
                    if self.strict:
                        raise ValueError(f"{path} has {count} pages, not page {i}")
                    yield path, file, i, None, "page_out_of_range", f"page {i} of {count}"
                    continue
                try:
                    yield path, file, i, pages[i] or "", "ok", None
                except Exception as e:
                    if self.strict:
                        raise
                    yield path, file, i, None, "unreadable_page", f"{type(e).__name__}: {e}"


class Pages(DataSource):
    """``spark.read.format("pages").load(folder)``: (path, file, page_index, text, status, reason) of all pages.

    Options: pattern and recursive choose files; parser is "module:function" that makes a sequence of page texts from a
    file's bytes, of which only wanted pages are asked; page is the page, or pages with commas, that are wanted of every file (conditions
    aren't pushed down, as Spark 4.1 then keeps those of one query for the next one of the same frame); strict fails
    the job at the first file or page that can't be read, else such are rows with a status and a reason; group is how
    many bytes of files a task reads. A folder without such files is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


def pages(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The data source over ``folder``, registered if need be."""
    spark.dataSource.register(Pages)
    held = spark.read.format("pages")
    for name, value in options.items():
        held = held.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return held.load(folder)


def page_counts(rows: DataFrame) -> DataFrame:
    """(status, pages, files): what was read and what was dropped, a row for every status that there may be."""
    every = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    held = rows.groupBy("status").agg(F.count("*").alias("pages"), F.count_distinct("path").alias("files"))
    return every.join(held, "status", "left").select("status", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("files", F.lit(0)).alias("files"))


def write_page_files(rows: DataFrame, path: str, group: str, order: list[str], text: str, files: int) -> None:
    """Writes texts as page files, the rows of each value of ``group`` in their order as the pages of one file; ``files`` tasks
    write them. Form feeds in texts become spaces, as they part pages."""
    held = rows.select(F.col(group).alias("of"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.translate(F.coalesce(F.col(text), F.lit("")), "\f", " ").alias("value"))
    held.repartition(files, "of").sortWithinPartitions("of", *(f"o{i}" for i in range(len(order)))).select("of", "value").write.partitionBy("of").option("lineSep", "\f").text(path)
