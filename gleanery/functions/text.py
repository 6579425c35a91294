"""Scalar text functions as Spark columns: all of them stay in the JVM.

White space and word characters are spelt out, as the regular expressions of Java, RE2 and Python disagree on the
short classes. A null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, the characters of a word, and a word with inner hyphens and apostrophes.
WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), f"^[{WS}]+|[{WS}]+$", "")


def slug(c: Column | str) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def item_slug(c: Column | str) -> Column:
    return slug(F.replace(_c(c), F.lit(" "), F.lit("")))


def token_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_c(c), F.lit(f"({WORD})"), F.lit(1)))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(f"({WORD})"), F.lit(1)), F.lower))


def stable_hash(c: Column | str) -> Column:
    return F.left(F.sha1(_c(c)), F.lit(10))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), trim_ws), lambda x: x != "")


def paragraphs(c: Column | str) -> Column:
    return _parts(_c(c), "\n{2,}")


def sentences(c: Column | str) -> Column:
    """Parts between white space that follows a full stop, an exclamation or a question mark."""
    return _parts(trim_ws(c), f"(?<=[.!?])[{WS}]+")


def words(c: Column | str) -> Column:
    """Runs of anything but white space, case kept."""
    return F.filter(F.split(_c(c), f"[{WS}]+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones are equal, an empty and another one have nothing in common."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def company(source_file: Column | str) -> Column:
    return F.replace(_c(source_file), F.lit(".html"), F.lit(""))


def chunk_id(source_file: Column | str, item: Column | str, index: Column | str) -> Column:
    stem = F.regexp_replace(_c(source_file), r"(?s)^.*/|(?<=[^/.])\.[^./]*$", "")
    return F.format_string("%s_%s_chunk_%03d", slug(stem), item_slug(item), _c(index))


def preview(c: Column | str, limit: int = 500) -> Column:
    c = _c(c)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def fingerprint(c: Column | str, read: int = 200, keep: int = 100) -> Column:
    return F.left(trim_ws(F.left(_c(c), F.lit(read))), F.lit(keep))
