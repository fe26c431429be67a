"""The tag catalog: create, update, look up, with an append-only history. Every version is a folder of its own."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions.text import canonical_digest
from pagelore.sources.store import stored

SCHEMA = "tag string, model string, page_index int, threshold double, method string, paradigm array<double>, updated_at timestamp, update_count int, signature string"
EVENTS = "tag string, action string, at timestamp, signature_before string, signature_after string"
#: Events that a tag's history shows.
SHOWN = 200
#: Times that a write is tried where other writers are first.
TRIES = 10


class CatalogError(ValueError):
    pass


class Catalog:
    """Tags under ``root``. ``versions/v=N`` has version N whole: its entries, the events that made it, and the requests that
    it used up. A write is prepared aside and becomes the next version by one rename, which fails if that version is there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(*parts))) if self._fs().exists(self._path(*parts)) else []

    def _renamed(self, source, target) -> bool:
        """Renames; False if the target is there."""
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, none)
        except Py4JJavaError:
            if self._fs().exists(target):
                return False
            raise
        return True

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("versions") if n.startswith("v="))

    def entries(self, version: int | None = None) -> DataFrame:
        """The entries of the last version, or of another; of version 0 there are none."""
        held = self.versions() if version is None else [version]
        if not held or held[-1] == 0:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/versions/v={held[-1]}/entries")

    def events(self) -> DataFrame:
        held = [f"{self.root}/versions/v={v}/events" for v in self.versions()]
        return self.spark.read.schema(EVENTS).parquet(*held) if held else self.spark.createDataFrame([], EVENTS)

    def history(self) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.col("at").desc(), "action"))
        return self.events().withColumn("rank", rank).where(F.col("rank") <= SHOWN).drop("rank")

    def snapshot(self, version: int) -> DataFrame:
        """(tag, signature_before, signature_after, change) of the tags that a version added or changed."""
        old, new = (self.entries(v).select("tag", F.col("signature").alias(n)) for v, n in ((version - 1, "signature_before"), (version, "signature_after")))
        held = old.join(new, "tag", "full").where(~F.col("signature_before").eqNullSafe(F.col("signature_after")))
        return held.withColumn("change", F.when(F.col("signature_before").isNull(), "added").when(F.col("signature_after").isNull(), "removed").otherwise("changed"))

    def put(self, rows: DataFrame, update: bool = False, authorize: bool = True, requests: str | None = None) -> int:
        """Adds rows (tag, model, page_index, threshold, method, paradigm) as the next version, whose number it returns.

        Without ``update`` no tag may be there; with it every tag must be, and ``authorize`` must be given, or by the files
        in the folder ``requests``: lines of JSON (tag, authorize), one for every tag. The files are moved into the version
        with the commit and back if there is none, so none is used twice. If another writer is first, the check and the
        commit are done again on what it left. Nothing is seen of a write that was cut off; ``recover`` gives its requests back.
        """
        new = stored(rows.select("tag", "model", "page_index", "threshold", "method", "paradigm"))
        for _ in range(TRIES):
            aside = f"staging/{uuid.uuid4().hex}"
            self._fs().mkdirs(self._path(aside))
            version = max(self.versions(), default=0)
            try:
                granted = self._claimed(aside, requests) if requests else None
                self._prepared(aside, new, self.entries(version), update, authorize, granted)
                self._fs().mkdirs(self._path("versions"))
                if self._renamed(self._path(aside), self._path("versions", f"v={version + 1}")):
                    return version + 1
            except BaseException:
                self._given_back(aside)
                raise
            self._given_back(aside)
        raise CatalogError(f"other writers were first {TRIES} times")

    def _prepared(self, aside: str, new: DataFrame, old: DataFrame, update: bool, authorize: bool, granted: DataFrame | None) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
        if update and not authorize:
            raise CatalogError("the update isn't authorized")
        if update and granted is not None:
            refused = new.join(granted.where("authorize"), "tag", "left_anti").select("tag").limit(3).collect()
            if refused:
                raise CatalogError(f"no request authorizes the update of {[r.tag for r in refused]}")
        clash = new.join(old, "tag", "left_anti" if update else "left_semi").select("tag").limit(3).collect()
        if clash:
            raise CatalogError(f"{'not in' if update else 'already in'} the catalog: {[r.tag for r in clash]}")
        digest = canonical_digest(F.struct("method", "model", "page_index", "paradigm", "threshold"))
        stamped = new.join(old.select("tag", F.col("update_count").alias("n"), F.col("signature").alias("before")), "tag", "left").select("*", digest.alias("signature"), F.lit(now).cast("timestamp").alias("updated_at"), (F.coalesce("n", F.lit(-1)) + 1).cast("int").alias("update_count"))
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        kept = old.join(new.select("tag"), "tag", "left_anti").select(*columns)
        kept.unionByName(stamped.select(*columns)).write.parquet(f"{self.root}/{aside}/entries")
        stamped.select("tag", F.lit("update" if update else "create").alias("action"), F.col("updated_at").alias("at"), F.col("before").alias("signature_before"), F.col("signature").alias("signature_after")).write.parquet(f"{self.root}/{aside}/events")

    def _claimed(self, aside: str, folder: str) -> DataFrame:
        """Moves the request files into the staging folder, from which no other writer takes them; returns their lines."""
        source = self._hadoop.Path(folder)
        self._fs().mkdirs(self._path(aside, "requests"))
        with_origin = self._fs().create(self._path(aside, "requests", "_from"), True)
        with_origin.write(bytearray(folder.encode()))
        with_origin.close()
        for status in self._fs().listStatus(source) if self._fs().exists(source) else []:
            name = status.getPath().getName()
            if status.isFile() and not name.startswith(("_", ".")):
                self._fs().rename(status.getPath(), self._path(aside, "requests", name))
        lines = self.spark.read.schema("tag string, authorize boolean, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{self.root}/{aside}/requests").cache()
        bad = lines.where("_corrupt is not null or tag is null").first()
        if bad:
            raise CatalogError(f"not a request: {bad['_corrupt'] or bad.asDict()}")
        return lines.groupBy("tag").agg(F.bool_and(F.coalesce("authorize", F.lit(False))).alias("authorize"))

    def _given_back(self, aside: str) -> None:
        """Moves a staging folder's requests back to where they came from and removes it."""
        held = self._path(aside, "requests")
        if self._fs().exists(self._path(aside, "requests", "_from")):
            folder = self._origin(aside)
            for status in self._fs().listStatus(held):
                name = status.getPath().getName()
                if not name.startswith(("_", ".")):
                    self._fs().rename(status.getPath(), self._hadoop.Path(f"{folder}/{name}"))
        self._fs().delete(self._path(aside), True)

    def _origin(self, aside: str) -> str:
        source = self._fs().open(self._path(aside, "requests", "_from"))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def recover(self) -> int:
        """Gives back the requests of writes that were cut off and removes what they had prepared. Only while none is running."""
        held = self._names("staging")
        for name in held:
            self._given_back(f"staging/{name}")
        return len(held)

    def resolve(self, tag: str) -> dict:
        row = self.entries().where(F.col("tag") == tag).first()
        if row is None:
            raise CatalogError(f"not in the catalog: {tag}")
        return row.asDict()


def contained(root: str, path: str) -> str:
    """The path as a child of ``root``; refuses any that leads out of it."""
    parts: list[str] = []
    full = path if path.startswith(root.rstrip("/") + "/") else f"{root.rstrip('/')}/{path}"
    if path.startswith("/") and full != path:
        raise CatalogError(f"outside of {root}: {path}")
    for part in full[len(root.rstrip("/")) + 1 :].split("/"):
        if part == "..":
            if not parts:
                raise CatalogError(f"outside of {root}: {path}")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join([root.rstrip("/"), *parts])


def manifest(rows: DataFrame, source: str, page: str) -> DataFrame:
    """One row: counts per page, distinct sources and rows, and the SHA-256 of their canonical JSON."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct(page, "n"))), lambda s: F.concat(s[page].cast("string"), F.lit(":"), s["n"].cast("string")))
    per_page = rows.groupBy(page).agg(F.count("*").alias("n")).agg(pages.alias("page_counts"), F.sum("n").alias("rows"))
    held = per_page.join(rows.agg(F.count_distinct(source).alias("sources")), F.lit(True))  # one row each
    return held.select("page_counts", "rows", "sources", canonical_digest(F.struct("page_counts", "rows", "sources")).alias("signature"))
