"""Near copies by shingle similarity: a prefix filter finds all pairs that can be alike enough, exact sets verify them.

Two sets of n and m shingles of a Jaccard similarity of t or more share one of the first n - ceil(t n) + 1 of the first
and of the first m - ceil(t m) + 1 of the second, in any order of all shingles that is the same for both. So no pair is
missed. The order only decides how much work there is: shingles that a sample shows to be common come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelore.llm.common import LOWER, NOT_SPACE, checkpointed, give_back, pieces, small_or_shuffled, span_hashes, window_hashes, word_bounds
from pagelore.llm import simhash
from pagelore.llm.simhash import components, named

#: Words in a shingle, and the Jaccard similarity from which two texts are near copies.
SHINGLE, ALIKE = 5, 0.8
#: About how many documents show which shingles are common, how often such a one occurs in them, and how many are told.
SAMPLE, COMMON, TOLD = 20_000, 3, 1 << 16
#: Cells of the parities that rule pairs out; a power of two.
BITS = 1024
#: Texts that share a shingle of their prefixes beyond which they are compared in blocks, rows of a block, rows of a task.
CROWDED, BLOCK, ROWS = 8, 1024, 1 << 16


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, number of the first word of each text and of all words) of runs of texts."""
    for _, _, data, offsets in pieces(column):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        yield span_hashes(data, starts, ends), first


def prints_of(column: pa.Array) -> np.ndarray:
    """A hash of the words of each text."""
    out = [xxhash.xxh64_intdigest(words[a:b].tobytes()) for words, first in word_hashes(column) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return np.array(out, np.uint64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(hash of the words, sorted distinct shingle hashes) of each text; one of fewer words is one shingle, null is empty."""
    for words, first in word_hashes(column):
        shingles = window_hashes(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            whole = xxhash.xxh64_intdigest(words[a:b].tobytes())
            if b - a >= size:
                yield whole, np.unique(shingles[a : b - size + 1])
            else:
                yield whole, np.array([whole] if b > a else [], dtype=np.uint64)


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted (shingle, rank) of those that are common in a sample of documents, the most common with the highest rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in shingle_sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["shingle"])
        give_back()

    step = max(1, docs.count() // SAMPLE)
    # drawn by text, each text once: copies would make all that they say common
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit("near copies")), F.lit(step)) == 0).select("text").distinct()
    counts = drawn.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(TOLD).collect()
    held = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(held)
    return np.stack([held[order], (len(rows) - order).astype(np.uint64)])


def prefixes(docs: DataFrame, common: np.ndarray, size: int, alike: float) -> DataFrame:
    """(shingle, print, held) for the shingles of each text's prefix: held has the number n of its distinct shingles in
    its upper and the place of this one in the prefix in its lower 32 bits."""
    told, ranks = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = [], set()
            for whole, held in shingle_sets(batch.column("text"), size):
                if whole not in seen and (n := len(held)):
                    seen.add(whole)
                    rank = np.zeros(n, np.uint64)
                    if len(told):
                        at = np.minimum(np.searchsorted(told, held), len(told) - 1)
                        rank = np.where(told[at] == held, ranks[at], rank)
                    most = n - int(np.ceil(alike * n - 1e-9)) + 1
                    first = np.argsort(rank, kind="stable")[:most]  # shingles of one rank are in order
                    out.append((held[first], whole, (n << 32) | np.arange(len(first))))
            shingle = np.concatenate([np.zeros(0, np.uint64), *(o[0] for o in out)])
            print_ = np.repeat(np.array([o[1] for o in out], np.uint64), [len(o[0]) for o in out])
            held = np.concatenate([np.zeros(0, np.int64), *(o[2] for o in out)])
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(print_.view(np.int64)), pa.array(held)], ["shingle", "print", "held"])
        give_back()

    return docs.select("text").mapInArrow(run, "shingle long, print long, held long")


def with_prints(docs: DataFrame, name: str = "print") -> DataFrame:
    """``docs`` with the column ``name``: a hash of each row's words."""
    at_text, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints_of(batch.column(at_text)).view(np.int64))], names)
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def facts(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print, fingerprint, n, bits) of each row, all that pairs are chosen by, from one pass over the texts.

    fingerprint is the text's SimHash, n the number of its distinct shingles; bits has for each of BITS cells whether an
    odd number of them falls into it: two texts differ in at least as many shingles as in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            out = [(w, len(held), np.packbits(np.bincount((held & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()) for w, held in shingle_sets(text, size)]
            wholes, prints = np.array([o[0] for o in out], np.uint64), simhash.prints_of(text)
            columns = [pa.array(wholes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "print", "fingerprint", "n", "bits"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long, fingerprint long, n long, bits binary")


def differing(n: Column, m: Column, alike: float) -> Column:
    """How many shingles two texts of n and m may have that the other has not."""
    return F.floor((1 - alike) / (1 + alike) * (n + m) + 1e-9)


def needed(pairs: DataFrame) -> DataFrame:
    return small_or_shuffled(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct())


def of_both(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    first, second = (held.select(F.col("print").alias(c), F.col(column).alias(f"{column}_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b")


def judged(pairs: DataFrame, docs: DataFrame, size: int, alike: float) -> DataFrame:
    """Those of the stored pairs (a, b) of prints whose texts have a similarity of ``alike`` or more, by whole sets."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size), strict=True)
            keep = [(both := len(np.intersect1d(x, y, True))) >= alike * (len(x) + len(y) - both) - 1e-9 for (_, x), (_, y) in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    texts = with_prints(docs.select("text")).join(needed(pairs), "print", "left_semi").groupBy("print").agg(F.first("text").alias("text"))
    return checkpointed(of_both(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(judge, "a long, b long"))


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, size: int, alike: float) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) of prints whose texts have a similarity of ``alike`` or more.

    Parities rule out most of the others, so the texts of few move; what remains is judged by whole sets.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b")]
            keep = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1) <= batch.column("may").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    pairs = checkpointed(pairs.select("a", "b", differing(F.col("n_a"), F.col("n_b"), alike).alias("may")))
    bits = known.select("print", "bits").join(needed(pairs), "print", "left_semi").dropDuplicates(["print"])
    pairs = checkpointed(of_both(pairs, bits, "bits").select("a", "b", "may", "bits_a", "bits_b").mapInArrow(close, "a long, b long"))
    return judged(pairs, docs, size, alike)


def fingerprint_links(docs: DataFrame, known: DataFrame, size: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """Edges (a, b) between prints whose SimHash fingerprints link (see ``simhash.links``) and whose sets confirm it.

    Texts of one fingerprint are compared with the one of the least print, which stands for them in the links between
    fingerprints. Texts without words are no nodes, as they have no shingles.
    """
    held = checkpointed(known.where("n > 0").select("fingerprint", "print").distinct())
    first = held.groupBy("fingerprint").agg(F.min("print").alias("first"))
    same = held.join(first, "fingerprint").select(F.col("first").alias("a"), F.col("print").alias("b"))
    names = [first.select(F.col("fingerprint").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"]
    near = simhash.links(held.select(F.col("fingerprint").alias("print"))).join(names[0], "a").join(names[1], "b")
    near = near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return judged(checkpointed(same.union(near).where("a <> b").distinct()), docs, size, alike)


def met_in_blocks(held: DataFrame, known: DataFrame, alike: float) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of prints that share a shingle, not yet a root, and may be alike by sizes, places and parities, from
    rows (shingle, print, n, at, root, blocks).

    The texts of a shingle are dealt to blocks of about BLOCK rows, and pairs of blocks to tasks; what is compared there
    is no row. All pairs are compared, so nothing is lost in however large a group.
    """
    bits = known.select("print", "bits").join(small_or_shuffled(held.select("print").distinct()), "print", "left_semi").dropDuplicates(["print"])
    mine = held.withColumn("mine", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("shingle", "print", "n", "at", "root", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    parts = met.count() // ROWS + 1

    def meet(table: pa.Table) -> pa.Table:
        shingle, print_, n, at, root, mine, low, high = (table.column(c).to_numpy() for c in ("shingle", "print", "n", "at", "root", "mine", "low", "high"))
        words = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(print_), -1)
        order = np.lexsort((high, low, shingle))
        key = np.stack([shingle[order], low[order], high[order]], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(order)]
        out = [np.zeros((0, 4), np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[lo:hi]
            left, right = rows[mine[rows] == low[rows[0]]], rows[mine[rows] == high[rows[0]]]
            for k in range(0, len(left), 64):
                a, b = left[k : k + 64, None], right[None, :]
                less, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                may = np.floor((1 - alike) / (1 + alike) * (n[a] + n[b]) + 1e-9)
                fit = (root[a] != root[b]) & (less >= alike * most - 1e-9) & (n[a] + n[b] - 2 * np.minimum(n[a] - at[a], n[b] - at[b]) <= may)
                x, y = np.nonzero(fit)
                i, j = left[k + x], right[y]
                near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= may[x, y]
                i, j = i[near], j[near]
                i, j = np.where(print_[i] < print_[j], (i, j), (j, i))
                out.append(np.unique(np.stack([print_[i], print_[j], n[i], n[j]], 1), axis=0))
        both = np.unique(np.concatenate(out), axis=0)
        return pa.table({c: both[:, k] for k, c in enumerate(("a", "b", "n_a", "n_b"))})

    dealt = met.join(bits, "print").withColumn("part", F.pmod(F.xxhash64("shingle", "low", "high"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(meet, "a long, b long, n_a long, n_b long").distinct()


def links(docs: DataFrame, known: DataFrame, size: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """Edges (a, b) between prints of distinct texts that connect all whose similarity is ``alike`` or more.

    Fingerprints link some first. Of the texts that share a shingle of their prefixes, each is then compared with the one
    that has it at the first place, so which says least else: the original, of copies that were each changed elsewhere.
    That links a large group of near copies in a star; then all that are not yet linked are compared with each other, in
    blocks where a shingle has many. Pairs whose sizes, or the places at which they share the shingle, leave too little in
    common are not compared at all. ``known`` are the stored ``facts`` of ``docs``.
    """
    found = fingerprint_links(docs, known, size, alike)
    rows = prefixes(docs, common_shingles(docs, size), size, alike).repartition("shingle").distinct()
    same = Window.partitionBy("shingle")
    rows = rows.withColumn("least", F.min(F.struct(F.col("held").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"), "print", "held")).over(same)).withColumn("many", F.count("*").over(same)).where("many > 1").drop("many")
    n, at = (lambda held: F.shiftright(held, 32)), (lambda held: held.bitwiseAND(F.lit((1 << 32) - 1)))
    shared = checkpointed(rows.select("shingle", "print", n(F.col("held")).alias("n"), at(F.col("held")).alias("at"), F.col("least.print").alias("least"), n(F.col("least.held")).alias("least_n"), at(F.col("least.held")).alias("least_at")))

    def may(n: str, at: str, m: str, to: str) -> Column:
        """Whether what can be shared from these places on is enough, by the sizes of both and of what lies before."""
        n, at, m, to = map(F.col, (n, at, m, to))
        return (F.least(n, m) >= F.lit(alike) * F.greatest(n, m) - 1e-9) & (n + m - 2 * F.least(n - at, m - to) <= differing(n, m, alike))

    # the first shared place of a pair bounds what it shares, so later ones may pass where that one doesn't: keep all that pass
    star = shared.where("print <> least").where(may("n", "at", "least_n", "least_at"))
    edges = found.union(verified(star.select(F.col("least").alias("a"), F.col("print").alias("b"), F.col("least_n").alias("n_a"), F.col("n").alias("n_b")).distinct(), docs, known, size, alike))
    roots = components(edges)
    held = checkpointed(shared.join(roots, shared["print"] == roots["node"], "left").select("shingle", "print", "n", "at", F.coalesce("root", "print").alias("root")))
    many = F.count("*").alias("many")
    open_ = held.groupBy("shingle").agg(many, F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("shingle", "many")
    held = checkpointed(held.join(open_, "shingle"))
    calm, crowded = held.where(F.col("many") <= CROWDED), held.where(F.col("many") > CROWDED)
    one, two = (calm.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("print", "n", "at", "root"))) for k in "ab")
    rest = one.join(two, "shingle").where("print_a < print_b and root_a <> root_b").where(may("n_a", "at_a", "n_b", "at_b"))
    met = met_in_blocks(crowded.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")), known, alike)
    rest = rest.select(F.col("print_a").alias("a"), F.col("print_b").alias("b"), "n_a", "n_b").union(met).distinct()
    return edges.union(verified(rest, docs, known, size, alike))


def near_copies(docs: DataFrame, size: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """(doc_id, print, root, component_id) of each row: root names its group, component_id is the least doc_id that near
    copies of near copies reach.

    Null and empty texts are copies of each other. Rows may be repeated and ids null or repeated; a null id is never a
    group's name unless all its members have none. Texts are judged whole, however long, A-Z in lower case and by words
    between white space; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = checkpointed(facts(docs, size))
    return named(known.select("doc_id", "print"), links(docs, known, size, alike))
