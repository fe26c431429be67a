"""Normalization of page texts, tags, labels and file names. All are built-in expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators 1C-1F; letters and digits of a token (ASCII and À-ÿ); fixed values.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
TOKEN = "[0-9A-Za-zÀ-ÿ]+"
#: Defaults: least characters of a page, of a supervised text, of a compared text; excerpts; text given to an encoder.
MIN_CHARS, MIN_CHARS_SUPERVISED, MIN_COMPARED, EXCERPT, BEST_EXCERPT, MAX_ENCODED = 40, 20, 20, 1800, 220, 3000


def normalized(text: Column) -> Column:
    """One space for each run of white space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE + "+", " "))


def tag(name: Column) -> Column:
    """Lower-case tag of ASCII letters, digits, "-" and single "_"; null where nothing is left."""
    low = F.regexp_replace(F.lower(F.trim(name)), "[^0-9a-zA-Z_-]+", "_")
    return F.nullif(F.btrim(F.regexp_replace(low, "_+", "_"), F.lit("_")), F.lit(""))


def strict_tag(name: Column) -> Column:
    """The tag in lower case if it has only letters, digits, ".", "_" and "-"; else null."""
    held = F.trim(name)
    return F.when(held.rlike("^[A-Za-z0-9._-]+$"), F.lower(held))


def required(value: Column, what: str) -> Column:
    """The value; a null one fails the job, as a tag must that nothing is left of."""
    return F.coalesce(value, F.raise_error(F.lit(f"no valid {what}")).cast("string"))


def label(name: Column) -> Column:
    """Like a tag, but letters and digits of any script stay."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}_-]", "_")
    return F.btrim(F.regexp_replace(low, "_+", "_"), F.lit("_"))


def slug(name: Column) -> Column:
    """A safe file name; "arquivo" where nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_"), F.lit("_")), F.lit("")), F.lit("arquivo"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    return F.substring(normalized(text), 1, most)


def row_status(text: Column, least: int = MIN_CHARS) -> Column:
    return F.when(F.length(normalized(text)) >= least, "ok").otherwise("skipped_short_text")


def skip_reason(text: Column, least: int = MIN_CHARS, what: str = "cover_text_too_short") -> Column:
    size = F.length(normalized(text))
    return F.when(size < least, F.format_string(f"{what}(%d<{least})", size))


def target_name(number: Column, path: Column, file: Column) -> Column:
    """Numbered name with ten digits of the path's digest."""
    return F.format_string("%05d_%s_%s", number, F.substring(F.sha1(path), 1, 10), file)


def preview_name(number: Column, file: Column, page: Column) -> Column:
    return F.format_string("%05d__%s__cover_p%04d.pdf", number, slug(file), page + 1)


def utc_iso(at: Column, zoned: bool = True) -> Column:
    """The time in UTC, whatever the session's zone; ``zoned`` is False for a column without a zone, which is UTC as it is."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()) if zoned else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_time(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def compact_utc(at: Column, zoned: bool = True) -> Column:
    """As ``utc_iso``, without marks between the digits."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()) if zoned else at, "yyyyMMdd'T'HHmmss'Z'")


def human_time(at: Column) -> Column:
    """The session's local time, for people."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def canonical_digest(value: Column) -> Column:
    """SHA-256 of the value's JSON, null fields included; give struct fields in key order."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)
