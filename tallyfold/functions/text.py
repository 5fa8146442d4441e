"""Scalar functions over text, lists and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: CR LF, and the single characters that end a line.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: What precedes an inline comment `*>`: quoted stretches (closed or not) and anything but the comment's start.
BEFORE_COMMENT = "^((?:[^'\"*]|'[^']*(?:'|$)|\"[^\"]*(?:\"|$)|\\*(?!>))*)"
#: Words that open a table reference, and words that may follow one but name no table.
TABLE_REFERENCE = r"(?i)\b(?:from|join|into|update|table)\s+([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)?)"
NOT_TABLES = ("SELECT", "SET", "VALUES", "WHERE", "LATERAL", "UNNEST", "ONLY")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``; it stays one evaluation where filters are pushed through."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def record_fingerprint(*columns: str) -> Column:
    """One hash for equal records, whatever the order in which the columns are named. Nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def physical_lines(text: Column) -> Column:
    """The text's lines; a line end at the very end opens no further line. Null gives null."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def without_comment(line: Column) -> Column:
    """The line up to an inline comment that stands outside quotes."""
    return F.regexp_extract(line, BEFORE_COMMENT, 1)


#: A literal: closed (a doubled quote does not close it) or open to the end.
LITERAL = "'(?:[^']|'')*(?:'|$)|\"(?:[^\"]|\"\")*(?:\"|$)"


def masked_literals(line: Column) -> Column:
    """The line with the inside of literals blanked out, doubled quotes included; every other character keeps its place.

    A literal that the line does not close is blanked to its end.
    """
    pattern = F.lit(LITERAL)
    quote = lambda x: F.substring(x, 1, 1)
    closed = lambda x: (F.length(x) > 1) & F.endswith(x, quote(x))
    blank = lambda x: F.concat(quote(x), F.repeat(F.lit(" "), F.length(x) - F.when(closed(x), 2).otherwise(1)), F.when(closed(x), quote(x)).otherwise(""))
    join = lambda outside, literal: F.concat(outside, F.coalesce(blank(literal), F.lit("")))
    return F.array_join(F.zip_with(F.split(line, pattern, -1), F.regexp_extract_all(line, pattern, F.lit(0)), join), "")


def found(code: Column, pattern: str) -> Column:
    """What the pattern's first group finds outside literals, without case: literals before it are consumed first."""
    either = F.lit(r"(?i)\"(?:[^\"]|\"\")*\"?|'(?:[^']|'')*'?|" + pattern)
    return F.filter(F.regexp_extract_all(code, either, F.lit(1)), lambda x: x != "")


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(path, "(?<=[^/])(\\.[^./]*)$", 1))


def member_of(operand: Column) -> Column:
    """``library`` and ``member`` of ``LIBRARY(MEMBER)``; a plain operand is a member without a library."""
    name = F.upper(F.trim(operand))
    inside = F.regexp_extract(name, r"^[^()]+\(([^()]+)\)$", 1)
    return F.when(inside != "", F.struct(F.regexp_extract(name, r"^([^()]+)\(", 1).alias("library"), inside.alias("member"))).otherwise(F.struct(F.lit(None).cast("string").alias("library"), name.alias("member")))


def table_references(text: Column) -> Column:
    """Distinct upper-case table names that a SQL text refers to, in order of appearance. Literals are not looked into."""
    found = F.transform(F.regexp_extract_all(masked_literals(text), F.lit(TABLE_REFERENCE), F.lit(1)), F.upper)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in NOT_TABLES]))


def list_cell(cell: Column) -> Column:
    """Trimmed, non-empty parts of a cell that separates by ``;`` or ``,``."""
    return F.filter(F.transform(F.split(cell, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def list_summary(names: Column, limit: int) -> Column:
    """``a, b (+N more; T total)``: as many leading names as fit in ``limit`` characters, at least one."""
    step = lambda acc, x: F.struct((acc["len"] + F.length(x) + 2).alias("len"), F.when(acc["len"] + F.length(x) <= limit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))
    fit = F.aggregate(names, F.struct(F.lit(0).alias("len"), F.lit(0).alias("n")), step, lambda acc: F.greatest(acc["n"], F.lit(1)))
    shown = F.array_join(F.slice(names, F.lit(1), fit), ", ")
    more = F.size(names) - fit
    return F.when(F.size(names) == 0, F.lit("")).when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more; "), F.size(names).cast("string"), F.lit(" total)"))).otherwise(shown)


def percent(part: Column, whole: Column) -> Column:
    """Two decimals; null where the whole is zero or unknown."""
    return F.round(F.try_divide(100.0 * part, whole), 2)


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a leading apostrophe."""
    return F.when(F.rlike(F.ltrim(cell), F.lit("^[=+\\-@]")), F.concat(F.lit("'"), cell)).otherwise(cell)


def capped(items: Column, limit: int) -> Column:
    """``items`` cut to ``limit`` and ``truncated``."""
    return F.struct(F.slice(items, 1, limit).alias("items"), (F.size(items) > limit).alias("truncated"))


def fixed_width(c: Column, width: int) -> Column:
    """Blank-padded to ``width``; null where the value is longer."""
    return F.when(F.length(c) <= width, F.rpad(c, width, " "))


def location_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case without blanks; known aliases become their canonical name."""
    key = F.lower(F.replace(name, F.lit(" "), F.lit("")))
    if not aliases:
        return key
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), key)


def condition_met(condition: Column, rc: Column) -> Column:
    """Whether a step condition (``Always``, blank, ``RC <op> n``) holds for a return code; null if it cannot be read."""
    text = F.upper(F.regexp_replace(F.coalesce(condition, F.lit("")), "\\s+", ""))
    op, n = F.regexp_extract(text, r"^RC(<=|>=|=|<|>)(\d+)$", 1), F.regexp_extract(text, r"^RC(?:<=|>=|=|<|>)(\d+)$", 1).try_cast("int")
    return (
        F.when(text.isin("ALWAYS", ""), F.lit(True)).when(op == "<=", rc <= n).when(op == ">=", rc >= n).when(op == "=", rc == n).when(op == "<", rc < n).when(op == ">", rc > n)
    )


def valid_identifier(c: Column, longest: int = 128) -> Column:
    """A letter, then letters, digits, underscores or hyphens."""
    return F.coalesce(F.rlike(c, F.lit("^[A-Za-z][A-Za-z0-9_-]*\\z")) & (F.length(c) <= longest), F.lit(False))
