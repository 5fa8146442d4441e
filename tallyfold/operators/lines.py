"""Physical lines: splitting, normalising, masking across lines, and classification by signature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyfold.functions.text import found, let, masked_literals, physical_lines, stem, suffix
from tallyfold.operators.windows import capped_list


def explode_lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``(key, line_no, line)`` with numbers from 1."""
    return files.select(key, F.posexplode(physical_lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def normalize_fixed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``class`` (blank, comment, code or unsupported) and ``code`` for card-image lines.

    A sequence area (six digits, or six blanks before an indicator) is dropped, the indicator column decides, columns 8 to 72
    are code; a debug line counts as code. Other lines are free form: `*>` opens a comment line.
    """
    c = F.rtrim(line)
    card = F.rlike(F.col(line), F.lit(r"^(?:[0-9]{6}.?| {6}(?:[*/-]|[Dd](?=\s|PROGRAM-ID\b|COPY\b|[0-9]{2}\s)))"))
    mark = F.substring(line, 7, 1)
    fixed = F.rtrim(F.substring(line, 8, 65))
    kind = F.when(F.trim(c) == "", "blank").when(card & mark.isin("*", "/"), "comment").when(card & (mark == "-"), "unsupported").when(card & (F.trim(fixed) == ""), "blank")
    kind = kind.when(F.startswith(F.ltrim(F.when(card, fixed).otherwise(c)), F.lit("*>")), "comment").otherwise("code")
    return lines.withColumn("class", kind).withColumn("code", F.when(kind == "code", F.when(card, fixed).otherwise(c)))


def line_counts(classified: DataFrame, key: str = "path") -> DataFrame:
    """``(key, physical, blank, comment, code)``."""
    n = lambda k: F.count_if(F.col("class") == k).alias(k)
    return classified.groupBy(key).agg(F.count("*").alias("physical"), n("blank"), n("comment"), n("code"))


def clean_text(text: str) -> str:
    """The text with block comments, quoted literals and in-stream data blanked out, every line end in place.

    In-stream data runs from the line after a ``DD *`` or ``DD DATA`` card to the next ``/*`` or ``//`` card.
    """
    out, comment, stream = [], False, False
    for line in text.split("\n"):
        if stream:
            if line.startswith(("/*", "//")):
                stream = False
            else:
                out.append(" " * len(line))
                continue
        if line.startswith("//") and any(f" DD {kind}" in line + " " for kind in ("* ", "*,", "DATA ", "DATA,")):
            stream = True
        kept, quote, i = [], "", 0
        while i < len(line):
            c = line[i]
            if comment:
                if line.startswith("*/", i):
                    comment = False
                    kept.append("  ")
                    i += 2
                    continue
                kept.append(" ")
            elif quote:
                kept.append(c if c == quote else " ")
                quote = "" if c == quote else quote
            elif line.startswith("/*", i) and i:
                comment = True
                kept.append("  ")
                i += 2
                continue
            else:
                quote = c if c in "'\"" else ""
                kept.append(c)
            i += 1
        out.append("".join(kept))
    return "\n".join(out)


@F.pandas_udf(StringType())
def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``clean_text`` of each whole text: comments and in-stream data reach across lines."""
    for part in texts:
        yield part.map(lambda t: None if t is None else clean_text(t))


#: Control statements of sort, copy and catalog utilities.
CONTROL_STATEMENTS = (
    r"SORT\s+FIELDS", r"MERGE\s+FIELDS", r"JOINKEYS\s", r"JOIN\s+UNPAIRED", r"REFORMAT\s+FIELDS", r"INCLUDE\s+COND", r"OMIT\s+COND", r"SUM\s+FIELDS", r"INREC\s", r"OUTREC\s", r"OUTFIL\s", r"OPTION\s+COPY",
    r"(?:COPY|COUNT|DISPLAY|OCCUR|SELECT|STATS|UNIQUE|VERIFY)\s+FROM\s*\(", r"REPRO\s+(?:IN|OUT)", r"DEFINE\s+(?:CLUSTER|GDG|AIX)", r"DELETE\s+[A-Z0-9@$#_-]+\.[A-Z0-9@$#_.-]+", r"SET\s+(?:MAXCC|LASTCC)\s*=", r"PRINT\s+INFILE\s*\(", r"LISTCAT(?:\s|$)",
)
#: The kinds of content and what tells them, tried on each line without case.
SIGNATURES: tuple[tuple[str, str], ...] = (
    ("cobol_program", r"^\s*(?:\d{6}\s)?\s*PROGRAM-ID\s*\."),
    ("jcl_job", r"^//[A-Z0-9@$#]+\s+JOB(?:\s|$)"),
    ("jcl_proc", r"^//[A-Z0-9@$#]+\s+PROC(?:\s|$)"),
    ("jcl_fragment", r"^//[A-Z0-9@$#]*\s+(?:EXEC|DD|INCLUDE|SET|PEND|IF)\b"),
    ("bms_map", r"^\s*(?:[A-Z0-9@$#]+\s+)?DFHM(?:SD|DI|DF)\b"),
    ("copybook", r"^\s*(?:\d{6}\s)?\s*\d{2}\s+[A-Z][A-Z0-9_-]*(?:\s|\.)"),
    ("dclgen", r"^\s*(?:EXEC\s+SQL\s+)?DECLARE\s+[A-Z][A-Z0-9_.]*\s+TABLE\b"),
    ("sql", r"^\s*(?:(?:CREATE|ALTER|DROP)\s+(?:TABLE|INDEX|VIEW|SCHEMA|DATABASE|TABLESPACE)\b|SELECT(?!\s+FROM\s*\()\s|INSERT\s+INTO\s|UPDATE\s+\S+\s+SET\s|DELETE\s+FROM\s)"),
    ("utility_control", r"^\s*(?:" + "|".join(CONTROL_STATEMENTS) + ")"),
    ("rexx", r"^\s*/\*\s*REXX\b"),
    ("clist", r"^\s*PROC\s+\d+\b"),
    ("pli", r"^\s*(?:[A-Z][A-Z0-9_]*\s*:\s*)?PROC(?:EDURE)?\b.*;\s*$"),
    ("assembler", r"^\s*[A-Z0-9@$#]+\s+(?:CSECT|DSECT|START)\b"),
    ("cics_definition", r"^\s*(?:DEFINE|ALTER|DELETE|LIST)\s+(?:TRANSACTION|PROGRAM|FILE|MAPSET|GROUP|LIST)\s*\("),
    ("scheduler_definition", r"^\s*(?:JOB|LJOB|LQ|LPRRN)\s*,\s*JOB="),
)
#: A kind on the left takes those on the right away.
SUPPRESSED: dict[str, tuple[str, ...]] = {
    "cobol_program": ("copybook", "sql", "dclgen"),
    "jcl_job": ("jcl_fragment", "utility_control", "sql", "jcl_proc"),
    "jcl_proc": ("jcl_fragment", "utility_control", "sql"),
    "dclgen": ("copybook", "sql"),
    "bms_map": ("assembler",),
}


def signature_hits(lines: DataFrame, signatures: Sequence[tuple[str, str]], line: str = "line", first_lines: dict[str, int] | None = None) -> DataFrame:
    """Lines with ``kinds``: the signatures that match, as one array Column in one pass."""
    limits = first_lines or {}
    hit = lambda k, p: F.when(F.rlike(line, F.lit("(?i)" + p)) & (F.col("line_no") <= limits[k] if k in limits else F.lit(True)), F.lit(k))
    return lines.withColumn("kinds", F.array_compact(F.array(*[hit(k, p) for k, p in signatures])))


def classify(lines: DataFrame, key: str = "path", referenced: DataFrame | None = None, evidence: int = 200) -> DataFrame:
    """``(key, kinds, kind, confidence, hint, evidence, truncated)`` for each file.

    One kind left after suppression is the file's; several are conflicting, none is unresolved. A file without a kind whose
    stem is in ``referenced`` (column ``stem``) is a copybook. The suffix is only a hint.
    """
    hits = signature_hits(lines, SIGNATURES, first_lines={"rexx": 5})
    found = hits.select(key, "line_no", "line", F.explode("kinds").alias("kind"))
    shown = capped_list(found, [key], F.struct("kind", "line_no", F.substring("line", 1, 200).alias("text")), ["line_no", "kind"], evidence)
    kinds = hits.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("all"))
    gone = F.flatten(F.array(*[F.when(F.array_contains("all", k), F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>")) for k, v in SUPPRESSED.items()]))
    out = kinds.withColumn("kinds", F.array_except("all", gone)).drop("all")
    if referenced is not None:
        named = referenced.select(F.upper("stem").alias("_stem"), F.lit(True).alias("_used")).distinct()
        out = out.withColumn("_stem", F.upper(stem(F.col(key)))).join(named, "_stem", "left")
        out = out.withColumn("kinds", F.when((F.size("kinds") == 0) & F.col("_used"), F.array(F.lit("copybook"))).otherwise(F.col("kinds"))).drop("_stem", "_used")
    one = F.size("kinds") == 1
    out = out.withColumns({
        "kind": F.when(one, F.get("kinds", F.lit(0))).when(F.size("kinds") > 1, "ambiguous").otherwise("unknown"),
        "confidence": F.when(one, "structural").when(F.size("kinds") > 1, "conflicting").otherwise("unresolved"),
        "hint": suffix(F.col(key)),
    })
    return out.join(shown.withColumnRenamed("items", "evidence"), key, "left")


def families(lines: DataFrame, verbs: dict[str, str], line: str = "line") -> DataFrame:
    """Lines with ``families``: the construct families of the verbs in a line, sorted; several for one line."""
    own: dict[str, list[str]] = {}
    for verb, family in verbs.items():
        own.setdefault(family, []).append(verb)
    # the words are a column of their own, so that they are cut once for all families; a-z only, as no other letter is in a verb
    cut = lines.withColumn("_words", F.regexp_extract_all(F.translate(line, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(r"[A-Z][A-Z0-9-]*"), F.lit(0)))
    each = [F.when(F.arrays_overlap("_words", F.array(*map(F.lit, sorted(vs)))), F.lit(name)) for name, vs in sorted(own.items())]
    return cut.withColumn("families", F.array_compact(F.array(*each))).drop("_words")


#: The verbs of each construct family.
CONSTRUCTS: dict[str, tuple[str, ...]] = {
    "iteration": ("PERFORM", "END-PERFORM"),
    "file_io": ("OPEN", "CLOSE", "READ", "WRITE", "REWRITE", "DELETE", "START", "DISPLAY", "ACCEPT"),
    "sorting": ("SORT", "MERGE", "RELEASE", "RETURN"),
    "arithmetic": ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE"),
    "conditional": ("IF", "ELSE", "END-IF", "EVALUATE", "WHEN", "END-EVALUATE"),
    "assignment": ("MOVE", "INITIALIZE"),
    "calling": ("CALL", "CANCEL"),
    "control_flow": ("GO", "GOBACK", "STOP", "EXIT", "CONTINUE", "ALTER"),
    "string_handling": ("STRING", "UNSTRING", "INSPECT"),
    "table_handling": ("SEARCH", "SET"),
    "data_layout": ("FD", "SD", "SELECT", "COPY", "REPLACE"),
}
#: The operations of job control cards.
CARDS: dict[str, tuple[str, ...]] = {
    "jcl_execution": ("JOB", "EXEC", "PROC", "PEND"),
    "jcl_data": ("DD", "SET", "INCLUDE", "JCLLIB", "OUTPUT"),
    "conditional": ("IF", "ELSE", "ENDIF"),
}
#: Statements that are known by more than their verb; the first that fits is the line's only family.
STATEMENTS: tuple[tuple[str, str], ...] = (
    ("embedded_sql", r"\b(EXEC\s+SQL)\b"),
    ("cics", r"\b(EXEC\s+CICS)\b"),
    ("messaging", r"\bCALL\s+['\"](MQCONN|MQCONNX|MQDISC|MQOPEN|MQCLOSE|MQPUT|MQPUT1|MQGET|MQINQ|MQSET|MQSUB|MQSUBRQ|MQCMIT|MQBACK)['\"]"),
    ("scheduling", r"^(JOB|SCH|SCHEDULE|LJOB|LDEP|LDSN)\s*[,=]"),
    ("data_layout", r"^(\d{2}\s+[A-Z0-9_-]+)\b"),
)


def constructs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with ``constructs``: the construct families of a source line, sorted; none for blank and comment lines.

    Words inside literals do not count, and the columns of a card image are cut. A line without a known construct is
    ``unclassified_source``, a null line (a reference without its source) ``unlocated_source``. ``members.constructs`` follows
    statements over several lines.
    """
    return lines.withColumn("constructs", let(F.col(line), constructs_of))


def constructs_of(line: Column) -> Column:
    card = F.rlike(line, F.lit("^[0-9]{6}[ */Dd-]"))
    code = F.upper(F.trim(F.when(card, F.substring(line, 8, 65)).otherwise(line)))
    comment = card & F.substring(line, 7, 1).isin("*", "/")
    return F.when(line.isNull(), F.array(F.lit("unlocated_source"))).when(comment, F.array().cast("array<string>")).otherwise(let(code, _families))


def _families(code: Column) -> Column:
    """The construct families of upper-case code without blanks around it."""
    only = lambda name: F.array(F.lit(name))
    operation = F.regexp_extract(code, r"^//[A-Z0-9@$#]*\s+([A-Z]+)\b", 1)
    by_card, special = only("unclassified_source"), F.lit(None).cast("array<string>")
    for name, operations in CARDS.items():
        by_card = F.when(operation.isin(*operations), only(name)).otherwise(by_card)
    for name, pattern in reversed(STATEMENTS):
        likely = F.rlike(code, F.lit(pattern))  # cheap, and seldom true
        special = F.when(likely & (F.size(found(code, pattern)) > 0), only(name)).otherwise(special)
    by_verb = lambda words: F.array_sort(F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, own))), F.lit(name)) for name, own in CONSTRUCTS.items()])))
    verbs = let(F.regexp_extract_all(masked_literals(code), F.lit(r"[A-Z][A-Z0-9_-]*"), F.lit(0)), by_verb)
    plain = F.coalesce(special, let(verbs, lambda v: F.when(F.size(v) > 0, v).otherwise(only("unclassified_source"))))
    comment = (code == "") | F.rlike(code, F.lit(r"^(//)?\*"))
    return F.when(comment, F.array().cast("array<string>")).when(F.startswith(code, F.lit("//")), by_card).otherwise(plain)


def entities(lines: DataFrame, patterns: dict[str, str], key: str = "path", line: str = "line") -> DataFrame:
    """``(key, kind, name)``: what each pattern's first group finds, upper-cased and distinct."""
    each = [_named(k, p, line) for k, p in patterns.items()]
    return lines.select(key, F.explode(F.concat(*each)).alias("e")).select(key, "e.kind", "e.name").distinct()


def _named(kind: str, pattern: str, line: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(line), F.lit("(?im)" + pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), F.upper(n).alias("name")))


def unaccounted(lines: DataFrame, disposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines that no disposition row accounts for."""
    return lines.join(disposed.select(*keys), list(keys), "left_anti")


def out_of_order(lines: DataFrame, key: str, line_no: str, rank: Column) -> DataFrame:
    """Lines whose section rank is below an earlier one's: ``(key, line_no, rank, highest)``."""
    w = Window.partitionBy(key).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select(key, line_no, rank.alias("rank")).where("rank is not null").withColumn("highest", F.max("rank").over(w))
    return rows.where(F.col("rank") <= F.col("highest"))


def excerpt(lines: DataFrame, key: str, first: Column, last: Column, most: int = 200, chars: int = 16_000) -> DataFrame:
    """``(key, first_line, last_line, text)``: each file's lines in a range, ``most`` lines and ``chars`` characters at most."""
    inside = lines.where(F.col("line_no").between(first, F.least(last, first + F.lit(most - 1))))
    out = inside.groupBy(key).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return out.select(key, "first_line", "last_line", F.substring(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), 1, chars).alias("text"))
