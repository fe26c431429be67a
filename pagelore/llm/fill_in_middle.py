"""Fill-in-middle transformation: texts are cut at two seeded places and their pieces put in another order."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: What begins prefix, suffix and middle; out of 100, the texts that are changed, and those of them with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST, SEED = 90, 20, "1"
#: A unit that texts are cut between: any code point.
CODE_POINT = r"(?s:.)"

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points; what no unit covers belongs to the one after it, and after the last to none."""
    return array("I", (m.end() for m in unit.finditer(text)))


def seeds(name: str, seed: str = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16), int(digest[16:24], 16), int(digest[24:32], 16)


def transformed(text: str, name: str, unit: regex.Pattern, seed: str = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = seeds(name, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= changed:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + text[b:] + PREFIX + text[:a] + MIDDLE + text[a:b]
    return n, "psm", a, b - a, PREFIX + text[:a] + SUFFIX + text[b:] + MIDDLE + text[a:b]


def restored(output: str, form: str) -> str:
    """The text of an output, found by its marks alone: texts that have one of them are plain, and no mark overlaps another."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no {first} at the start of a text of form {form}")
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def filled_in_middle(docs: DataFrame, text: str = "text", doc: str = "doc_id", name: str = "fim", unit: str = CODE_POINT, seed: str = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with the struct column ``name``: units, form, sizes of prefix and middle in code points, output, and the
    SHA-256 of the output and of the text that is rebuilt from it.

    The draw depends on the id alone, so rows of equal ids are drawn alike; a null id is the empty one. Null and empty texts
    are plain and empty. Texts are cut whole, however long: a task holds a batch of them and the offsets of one. Other
    columns stay; one called ``name`` is replaced.
    """
    pattern = regex.compile(unit)

    @pandas_udf(RESULT)
    def cut(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for value, held in zip(texts, names, strict=True):
            n, form, prefix, middle, output = transformed(value, held, pattern, seed, changed, suffix_first)
            rows.append((n, form, prefix, middle, output, _sha256(output), _sha256(restored(output, form))))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    return docs.withColumn(name, cut(F.coalesce(F.col(f"`{text}`"), empty), F.coalesce(F.col(f"`{doc}`").cast("string"), empty)))


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """Per document what ``filled_in_middle`` makes of its whole text."""
    held = filled_in_middle(docs.select("doc_id", "text"))
    return held.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output_sha256", "fim.restored_sha256")
