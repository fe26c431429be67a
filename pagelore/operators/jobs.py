"""Whole jobs: what builds a catalog, prepares a dataset or stores a classifier, each with its files and their readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.text import MIN_CHARS_SUPERVISED, target_name
from pagelore.functions.vectors import doubles, unit
from pagelore.operators import paradigm
from pagelore.operators.catalog import Catalog
from pagelore.operators.supervised import split, usable
from pagelore.sources.files import SKIPS_SHOWN, write_manifest, write_split_tree
from pagelore.sources.store import stored

DEFAULT_MODEL = "hash64"


def write_embeddings(vectors: DataFrame, path: str, meta: dict[str, str], skipped: DataFrame | None = None) -> None:
    """Vectors (item, file, embedding) and beside them a row of meta data with the count and the first skipped rows (a
    report of SKIPS_SHOWN lines at most; the vectors themselves are all there)."""
    vectors.select(F.col("item").cast("long").alias("item"), "file", doubles(F.col("embedding")).alias("embedding")).write.mode("errorifexists").parquet(f"{path}/vectors")
    lines = skipped.orderBy("file").limit(SKIPS_SHOWN).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "file", "reason"))).alias("skips")) if skipped is not None else vectors.sparkSession.range(1).select(F.array().cast("array<string>").alias("skips"))
    held = lines.select("skips", *(F.lit(v).alias(k) for k, v in meta.items()))
    held.crossJoin(vectors.agg(F.count("*").alias("count"))).write.mode("errorifexists").json(f"{path}/meta")  # one row each


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((item, file, embedding), meta): items without a file name are called by their number."""
    held = spark.read.parquet(f"{path}/vectors")
    named = F.coalesce(F.nullif(F.trim("file"), F.lit("")), F.format_string("item_%06d", "item"))
    return held.select("item", named.alias("file"), "embedding"), spark.read.json(f"{path}/meta").first().asDict()


def model_name(given: Column, source: Column, default: str = DEFAULT_MODEL) -> Column:
    """The name that is given, else that of the source, else the default; blank names count as none."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(F.trim(source), F.lit("")), F.lit(default))


def build_catalog(catalog: Catalog, vectors: DataFrame, tag: str, vec: str, model: str = DEFAULT_MODEL, page_index: int = 0, method: str = "p05", update: bool = False, authorize: bool = True) -> DataFrame:
    """Puts each tag's paradigm and cutoff into the catalog and returns the validation report of its members."""
    known = stored(paradigm.paradigms(vectors, tag, vec))
    scores = stored(paradigm.self_scores(vectors, tag, vec, known=known))
    entries = known.join(paradigm.thresholds(scores, tag, method), tag)
    rows = entries.select(F.col(tag).cast("string").alias("tag"), F.lit(model).alias("model"), F.lit(page_index).alias("page_index"), "threshold", F.lit(method).alias("method"), "paradigm")
    catalog.put(rows, update, authorize)
    return paradigm.report(scores, tag, method)


def read_paradigms(catalog: Catalog) -> DataFrame:
    """The catalog's entries with their paradigms at length 1 and a model name, ready to be searched with."""
    held = catalog.entries()
    return held.withColumn("paradigm", unit(F.col("paradigm"))).withColumn("model", model_name(F.col("model"), F.lit(None).cast("string")))


def prepare_dataset(samples: DataFrame, path: str, key: str, label: str, text: str, source: str, least: int = MIN_CHARS_SUPERVISED, **options) -> DataFrame:
    """Splits the samples of enough text, writes them as a tree of split and label with a manifest, and returns the summary:
    (split, label, n), and of those left out (skipped, label, n)."""
    kept, short = usable(samples, text, least)
    parts = split(kept, key, label, **options)
    name = target_name(F.col("number"), F.concat(source, F.lit("/"), F.col(key).cast("string")), F.col(key).cast("string"))
    parts = parts.withColumns({"src_name": F.col(source), "src_abs": F.concat(source, F.lit("/"), F.col(key).cast("string")), "dst_name": name, "dst_abs": F.concat_ws("/", F.lit(path), "split", F.col(label).cast("string"), name)})
    write_split_tree(parts, label, f"{path}/tree")
    parts = parts.sparkSession.read.schema(parts.schema).parquet(f"{path}/tree")  # the manifest and the summary are of what was written
    write_manifest(parts.withColumn("label", F.col(label).cast("string")), f"{path}/manifest")
    counts = parts.groupBy("split", label).agg(F.count("*").alias("n"))
    return counts.union(short.groupBy(F.lit("skipped").alias("split"), label).agg(F.count("*").alias("n")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, split string, src_abs string, src_name string, dst_name string, dst_abs string").csv(f"{path}/manifest", header=True)


def save_classifier(weights: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Weights, a row a class, and a row of meta data."""
    weights.select("label_id", "label", "weights", "bias").write.mode("errorifexists").parquet(f"{path}/weights")
    size = weights.agg(F.count("*").alias("classes"), F.max(F.size("weights")).alias("embedding_dim"), F.sort_array(F.collect_list("label")).alias("labels"))
    size.select("*", *(F.lit(v).alias(k) for k, v in meta.items())).write.mode("errorifexists").json(f"{path}/meta")


def load_classifier(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(weights, meta); an error if they don't belong together."""
    weights, meta = spark.read.parquet(f"{path}/weights"), spark.read.json(f"{path}/meta").first().asDict()
    if weights.count() != meta["classes"]:
        raise ValueError(f"{path} has other weights than its meta data say")
    return weights, meta


def row_texts(rows: DataFrame, texts: DataFrame, path: str, text: str) -> DataFrame:
    """``rows`` with the text of their path, each path read once; blank paths and paths that aren't there have no text.
    ``found`` is "ok", "missing" or "unreadable" (a null text)."""
    wanted = rows.select(path).where(F.trim(path) != "").distinct()
    held = wanted.join(texts.select(path, F.col(text).alias("held_text")).withColumn("there", F.lit(True)), path)
    out = rows.join(held, path, "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("held_text").isNull(), "unreadable").otherwise("ok")
    return out.withColumn("found", status).withColumn(text, F.coalesce("held_text", F.lit(""))).drop("held_text", "there")


def signature(named: dict[str, Column]) -> Column:
    """The catalog's signature: ``catalog_signature``, else the first other one, by name, that isn't blank."""
    order = sorted(named, key=lambda n: (n != "catalog_signature", n))
    return F.coalesce(*(F.nullif(F.trim(named[n]), F.lit("")) for n in order))


def update_action(exists: Column, authorized: Column) -> Column:
    """What a request does: a new tag is created; one that is there is updated only if that is authorized in so many words."""
    return F.when(~exists, "create").when(F.coalesce(authorized, F.lit(False)), "update").otherwise("refused")


def annotated(results: DataFrame, tag: str, path: str) -> DataFrame:
    """``results`` with the tag and catalog path that they come from."""
    return results.withColumns({"catalog_tag": F.lit(tag), "catalog_path": F.lit(path)})


def feature_map(fields: tuple[str, ...]) -> Column:
    """The features of a row by their names."""
    return F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f) for f in fields)))


def same_fields(held: list[str], wanted: list[str]) -> None:
    """Refuses a catalog of other features, or of the same in another order."""
    if list(held) != list(wanted):
        raise ValueError(f"the catalog has the features {held}, not {wanted}")


def exactly_one(**given: object) -> str:
    """The name of the one argument that is given."""
    names = [n for n, v in given.items() if v]
    if len(names) != 1:
        raise ValueError(f"give exactly one of {', '.join(given)}")
    return names[0]


def backing_off(encode: Callable[[list, int], list], items: list, batch: int, too_much: type[BaseException] = MemoryError) -> list:
    """``encode(items, batch)``, again with half the batch while it runs out of memory; with 1 the error stands."""
    while True:
        try:
            return encode(items, batch)
        except too_much:
            if batch <= 1:
                raise
            batch //= 2


def payload(job: str, outcome: DataFrame, **details: str) -> DataFrame:
    """One row (job, payload): the outcome of a small report as JSON, with the details, for whoever started the job."""
    rows = outcome.agg(F.array_sort(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in outcome.columns)))).alias("rows"))
    said = F.struct(*(F.lit(v).alias(k) for k, v in sorted(details.items())), "rows")
    return rows.select(F.lit(job).alias("job"), F.to_json(said, {"ignoreNullFields": "false"}).alias("payload"))
