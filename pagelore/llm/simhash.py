"""SimHash near-duplicates: multi-index hashing finds the links between fingerprints, by small balls in their segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelore.llm.common import checkpointed, free_name, pieces, plainly, small_or_shuffled

#: Words in a shingle, seed of the shingle hash, bits of a fingerprint.
SHINGLE, SEED, BITS = 3, 42, 64
#: Segments of a fingerprint, bits in which linked ones may differ, members beyond which a table entry is crowded.
SEGMENTS, DISTANCE, CROWDED = 2, 2, 64


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])]  # noqa: B905


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each row.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A bit is set if it is set in over half of
    the shingle hashes, repeats included. A text of fewer words is one shingle; a null text or one without words has
    fingerprint 0. Rows are kept as they are, repeated or not, whatever other columns ``docs`` has.
    """
    return with_prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "print", size).drop("text")


def prints_of(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    prints = np.zeros(len(column), dtype=np.uint64)
    for lo, hi, data, offsets in pieces(column):
        whole = data.tobytes()
        for row in range(lo, hi):
            hashes = np.array(_shingle_hashes(whole[offsets[row - lo] : offsets[row - lo + 1]], size), dtype="<u8")
            if len(hashes):
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
                prints[row] = np.packbits(most, bitorder="little").view("<u8")[0]
    return prints


def with_prints(docs: DataFrame, name: str, size: int = SHINGLE) -> DataFrame:
    """``docs`` with its fingerprints in the column ``name``."""
    at_text, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints_of(batch.column(at_text), size).view(np.int64))], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def masks(bits: int, radius: int) -> list[int]:
    """All numbers of ``bits`` bits of which ``radius`` or fewer are set."""
    return [sum(1 << i for i in held) for k in range(radius + 1) for held in combinations(range(bits), k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(prints: DataFrame) -> DataFrame:
    """(segment, value, print): the entries of a fingerprint in the tables of its segments."""
    wide = BITS // SEGMENTS
    entries = [F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("print", i * wide).bitwiseAND(F.lit(signed((1 << wide) - 1))).alias("value")) for i in range(SEGMENTS)]
    return prints.select("print", F.explode(F.array(*entries)).alias("e")).select("e.segment", "e.value", "print")


def around(entries: DataFrame, *columns: str) -> DataFrame:
    """(segment, value, columns) for the small Hamming ball of each entry's value.

    Of two fingerprints that differ in DISTANCE bits, one segment differs in few: with q and r the quotient and rest of
    DISTANCE by SEGMENTS, in q bits at most if it is one of the first r + 1, or in q - 1 at most if it is one of the others.
    """
    small, rest = divmod(DISTANCE, SEGMENTS)
    ball = lambda radius: F.array(*(F.col("value").bitwiseXOR(F.lit(signed(m))) for m in masks(BITS // SEGMENTS, radius)))
    of = F.when(F.col("segment") <= rest, ball(small))
    of = of.otherwise(ball(small - 1)) if small else of
    return entries.where(of.isNotNull()).select("segment", F.explode(of).alias("value"), *columns)


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at DISTANCE or fewer differing bits that connect all that are so linked.

    Each fingerprint looks up the small balls of its segments in their tables, and what it finds is verified by complete
    distance. Near copies crowd some entries. Those with more than CROWDED members are not looked up: the fingerprints that
    they and the entries around them hold are linked by ``midpoints`` instead, whose entries can't be crowded.
    """
    entries = tables(prints.select("print").distinct())
    crowded = small_or_shuffled(entries.groupBy("segment", "value").count().where(F.col("count") > CROWDED).select("segment", "value"))
    calm = entries.join(crowded, ["segment", "value"], "left_anti")
    looked = around(calm, "print").withColumnRenamed("print", "a").join(calm.withColumnRenamed("print", "b"), ["segment", "value"])
    found = looked.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    near_crowds = around(crowded).distinct()
    return found.union(midpoints(entries.join(near_crowds, ["segment", "value"], "left_semi").select("print"))).distinct()


def midpoints(prints: DataFrame) -> DataFrame:
    """The same edges, for a DISTANCE of 2: such fingerprints have a value within one bit of both. Each fingerprint gives
    all values within one bit; a value has BITS + 1 fingerprints at most, all within two bits of each other, and a chain
    through them links them."""
    ball = F.array(*(F.col("print").bitwiseXOR(F.lit(signed(m))) for m in masks(BITS, DISTANCE // 2)))
    members = prints.distinct().select("print", F.explode(ball).alias("member"))
    last = F.lag("print").over(Window.partitionBy("member").orderBy("print"))
    return members.select(last.alias("a"), F.col("print").alias("b")).where(F.col("a").isNotNull())


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its connected component.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until the edges are stars. The edges of
    each round go to the checkpoint folder; none come to the driver but a count and a checksum.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        all_ways = both(edges)
        least = all_ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = all_ways.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.where("a != b").distinct())
        before, seen = seen, state(edges)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, print, root, component_id) of each row: root is the least print of its group, component_id the least
    doc_id that links reach, its own included.

    A null doc_id is never a component's name unless all its members have none. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, size))
    return named(prints, links(prints))


def named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, print, root, component_id) of each row (doc_id, print), given the edges between prints."""
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(edges)
    rooted = first.join(roots, first["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("print", "root", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "root", "component_id")


def one_of_each_group(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = near_duplicates, prints_of: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One row of each group of ``docs``, as ``near`` finds them: that of the least doc_id, null last, then of the least
    print; of rows that are alike in both, one, by a hash of all columns.

    ``prints_of`` gives rows the column that ``near`` calls print. Rows stay as they are, with all columns of any name; null
    and empty texts are a group; an empty table stays empty. The rows that go are told to the others, so texts aren't
    shuffled while their ids and prints are few enough to be broadcast.
    """
    prints_of = prints_of or with_prints
    docs, renamed = plainly(docs)
    name, same = free_name("print", docs), free_name("copies", docs)
    found = near(docs).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print").alias("row")).groupBy("root", "row").count()
    found = checkpointed(found.withColumn("first", F.min("row").over(Window.partitionBy("root"))))
    go = small_or_shuffled(found.where("row <> first").select("row.doc_id", "row.print").distinct())
    several = small_or_shuffled(found.where("row = first and count > 1").select("row.doc_id", "row.print"))
    held = prints_of(docs, name)

    def alike(other: DataFrame) -> Column:
        return held["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (held[name] == other["print"])

    kept = held.join(go, alike(go), "left_anti")
    marked = kept.join(several.withColumn(same, F.lit(True)).withColumnRenamed("print", "print_of_copies").withColumnRenamed("doc_id", "id_of_copies"), held["doc_id"].cast("long").eqNullSafe(F.col("id_of_copies")) & (held[name] == F.col("print_of_copies")), "left")
    alone = marked.where(F.col(same).isNull()).select(*(kept[c] for c in docs.columns))
    order = F.xxhash64(*(F.col(c) for c, t in docs.dtypes if not t.startswith("map")))
    # a grouped minimum keeps one row a task, so a hot group doesn't meet
    one = F.min_by(F.struct(*docs.columns), order).alias("row")
    repeated = kept.join(several, alike(several), "left_semi").groupBy("doc_id", name).agg(one).select("row.*")
    return renamed(alone.union(repeated))


def op10_simhash(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document and the least id that links at two bits or fewer reach; see ``near_duplicates``."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
