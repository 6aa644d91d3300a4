"""Text and label functions, Column to Column.

Lengths are UTF-16 units and white space is spelled out, because Spark's own length, trim and
\\s differ from the semantics wanted. Labels sort by UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred import errors as E

CONTROLS = "".join(map(chr, range(33)))
SPACES = r"[ \t\n\x0B\f\r]+"
SEPARATORS = "[;；,，]"
CODE_LIMIT, CODES_LIMIT, NAME_LIMIT = 64, 4000, 500


def java_trim(c: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(c, F.lit(CONTROLS))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def normalize(c: Column) -> Column:
    """Null to empty, ideographic space and line ends unified, trimmed, white space collapsed."""
    flat = F.coalesce(c, F.lit(""))
    for old, new in (("　", " "), ("\r\n", "\n"), ("\r", "\n")):
        flat = F.replace(flat, F.lit(old), F.lit(new))
    return F.regexp_replace(java_trim(flat), SPACES, " ")


def text_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def paragraph_error(normalized: Column, limit: int = 4000) -> Column:
    """The error of a normalised paragraph, null when it is acceptable."""
    return (
        F.when(normalized == "", F.lit(E.MSG_PARAGRAPH_EMPTY))
        .when(utf16_length(normalized) > limit, F.lit(E.MSG_PARAGRAPH_LONG.format(limit=limit)))
    )


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once a row however often `use` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _tokens(raw: Column) -> Column:
    parts = F.split(F.coalesce(raw, F.lit("")), SEPARATORS, -1)
    return F.filter(F.transform(parts, java_trim), lambda t: t != "")


def canonical_codes(raw: Column) -> Column:
    """Distinct labels in order, joined by ';'. Meaningful where codes_error() is null."""
    return _canonical(_tokens(raw))


def _canonical(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), ";")


def codes_error(raw: Column) -> Column:
    """The first failing check: per label in input order length before white space, then the total."""
    return once(_tokens(raw), _tokens_error)


def codes_and_error(raw: Column) -> Column:
    """Both in a struct (codes, error), from one split."""
    return once(_tokens(raw), lambda t: F.struct(_canonical(t).alias("codes"), _tokens_error(t).alias("error")))


def _tokens_error(tokens: Column) -> Column:
    per_code = F.transform(
        tokens,
        lambda t: F.when(utf16_length(t) > CODE_LIMIT, F.lit(E.MSG_CODE_LONG)).when(
            t.rlike(r"\A(?:.*[ \t\n\x0B\f\r]+.*)\z"), F.concat(F.lit(E.MSG_CODE_SPACE), t)
        ),
    )
    total = F.when(utf16_length(_canonical(tokens)) > CODES_LIMIT, F.lit(E.MSG_CODES_LONG))
    return F.when(F.size(tokens) == 0, F.lit(E.MSG_CODES_EMPTY)).otherwise(F.coalesce(F.get(F.filter(per_code, lambda e: e.isNotNull()), F.lit(0)), total))


def parse_codes(c: Column) -> Column:
    """Split stored labels; trailing empty ones go, inner ones stay, nothing is trimmed."""
    kept = F.regexp_replace(c, r";+\z", "")
    empty = F.array().cast("array<string>")
    return F.when(c.isNull() | (java_trim(c) == "") | (kept == ""), empty).otherwise(F.split(kept, ";", -1))


def not_blank(c: Column) -> Column:
    return F.coalesce(java_trim(c) != "", F.lit(False))


def truncate_name(c: Column, limit: int = NAME_LIMIT) -> Column:
    """At most `limit` UTF-16 units of a file name, without half a character; null stays null."""
    def fits(head: Column) -> Column:  # the units before each character decide whether it fits
        units = F.transform(F.split(head, ""), lambda x: F.struct(x.alias("x"), utf16_length(x).alias("n")))
        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))
        step = lambda a, u: F.struct((a["n"] + u["n"]).alias("n"), F.when(a["n"] + u["n"] <= limit, F.concat(a["s"], u["x"])).otherwise(a["s"]).alias("s"))
        return F.aggregate(units, start, step, lambda a: a["s"])

    head = F.substring(c, 1, limit)
    return F.when(utf16_length(head) <= limit, head).otherwise(fits(head))


def is_xlsx_name(c: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(c), F.lit(".xlsx")), F.lit(False))


def header_ok(first: Column, second: Column) -> Column:
    head = F.coalesce(java_trim(first), F.lit("")) == E.HEADER_PARAGRAPH
    return head & (F.coalesce(java_trim(second), F.lit("")) == E.HEADER_CODES)
