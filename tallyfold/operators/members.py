"""Source members as cleaned lines, and what the lines around a line make of it.

``scan`` runs one state machine over each member: nested comments, literals and in-stream data reach across lines, fixed
columns are cut. The rest is windows and joins over the lines: the open procedure and step of a job line, the program of a
source line, the regions of embedded SQL, and resource statements gathered up to the next command. A window's partition is
one member, or one nesting depth of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import found, let
from tallyfold.operators import lines as single_lines

#: A member name, a qualified name, and where fixed columns are in use (numbered, or with a blank sequence area).
NAME = r"[A-Z@$#][A-Z0-9@$#_-]*"
QUALIFIED = rf"{NAME}(?:\.{NAME})*"
FIXED = r"^(?:[0-9]{6}[ */Dd-]| {6}(?:[ */-]|[Dd](?=\s|PROGRAM-ID\b|COPY\b|[0-9]{2}\s)))"
STREAM = re.compile(r"//[A-Z0-9@$#]*\s+DD\s+(DATA|\*)(?=[\s,]|$)", re.I)
DELIMITER = re.compile(r"(?:^|,)\s*DLM\s*=\s*(?:'([^']{1,8})'|([^,\s]{1,8}))(?=[\s,]|$)", re.I)

_fixed, _outside, _comment = re.compile(FIXED, re.I), re.compile(r"/\*|--|\*>|['\"]"), re.compile(r"/\*|\*/")
_closing = {q: re.compile(f"(?:[^{q}]|{q}{q})*{q}(?!{q})") for q in "'\""}
LINES = "array<struct<line_no:int,code:string>>"


class Scanner:
    """The state between the lines of one member: what ends in-stream data, how deep comments are nested, the open literal's quote."""

    def __init__(self) -> None:
        self.data: tuple[str, bool] | None = None  # the delimiter, and whether a card ends the data, too
        self.depth, self.quote, self.cards = 0, "", False

    def lines(self, text: str) -> Iterator[tuple[int, str]]:
        """(number, code) of the lines that hold code."""
        for number, line in enumerate(text.splitlines(), 1):
            if self.data and not self.resumes(line):
                continue
            code = self.code(line)
            if code is None:
                continue
            yield number, code
            if found := STREAM.match(code):
                named = DELIMITER.search(code, found.end())
                self.data = (named[1] or named[2], False) if named else ("/*", found[1] == "*")

    def resumes(self, line: str) -> bool:
        """Whether in-stream data is over with this line and the line itself is code."""
        delimiter, by_card = self.data
        if line.startswith(delimiter):
            self.data = None
            return False
        if by_card and line.startswith("//"):
            self.data = None
        return self.data is None

    def code(self, line: str) -> str | None:
        """The line without its comments and without what a literal from an earlier line still holds; None if it is a comment line."""
        free = not self.depth and not self.quote
        if free and _fixed.match(line):
            if line[6] in "*/":
                return None
            line = line[7:72]
        if free and line.lstrip().startswith(("*>", "//*", "--")):
            return None
        if free and line.startswith("//"):
            self.cards = True
            return line
        if free and self.cards and line.strip() == "/*":
            return None
        banner = free and re.match(r"\s*/\*\s*REXX\b", line, re.I)
        kept = self.cleaned(line)
        return "/* REXX */" + kept if banner else kept

    def cleaned(self, line: str) -> str:
        out, at = [], 0
        while at < len(line):
            if self.depth:
                found = _comment.search(line, at)
                self.depth += 0 if not found else 1 if found[0] == "/*" else -1
                at = found.end() if found else len(line)
                out.append(" " if found and not self.depth else "")
            elif self.quote:
                found = _closing[self.quote].match(line, at)
                end = found.end() if found else len(line)
                out.append(line[at:end] if at else " " * end)  # from an earlier line: blank
                self.quote, at = "" if found else self.quote, end
            else:
                found = _outside.search(line, at)
                if not found:
                    out.append(line[at:])
                    break
                out.append(line[at : found.start()])
                if found[0] in ("--", "*>"):
                    break
                if found[0] == "/*":
                    self.depth = 1
                else:
                    self.quote = found[0]
                    out.append(found[0])
                at = found.end()
        return "".join(out)


def scan(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``(key, line_no, code)``: the lines of each member that hold code, cleaned. Null texts have none."""

    @F.pandas_udf(LINES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: [] if t is None else list(Scanner().lines(t)))

    return files.select(key, F.explode(run(F.col(text))).alias("x")).select(key, "x.line_no", "x.code")


def unquoted(operand: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(operand, r"^(['\"])(.*)\1$", "$2"), r"\.$", ""))


def member_names(value: Column) -> Column:
    """``name`` and ``library`` of ``LIBRARY(MEMBER)`` or ``LIBRARY.MEMBER``."""
    paren = rf"(?i)^({QUALIFIED})\(({NAME})\)$"
    dotted = F.contains(value, F.lit("."))
    name = F.when(F.rlike(value, F.lit(paren)), F.regexp_extract(value, paren, 2)).when(dotted, F.substring_index(value, ".", -1)).otherwise(value)
    library = F.when(F.rlike(value, F.lit(paren)), F.regexp_extract(value, paren, 1)).when(dotted, F.regexp_extract(value, r"^(.*)\.[^.]*$", 1))
    return F.struct(name.alias("name"), library.alias("library"))


def is_name(value: Column, pattern: str = NAME) -> Column:
    return F.rlike(value, F.lit(f"(?i)^(?:{pattern})$"))


def job_context(lines: DataFrame, key: str = "path") -> DataFrame:
    """Job lines with ``owner`` and ``step``: the open job or procedure (kind, name, line_no; null for the member itself) and the open step.

    A procedure opens a level that PEND closes, after which the owner from before it is back; PEND without a procedure leaves
    the member itself. A job, a procedure or PEND ends the open step.
    """
    c = F.col("code")
    opens = F.regexp_extract(c, rf"(?i)^//({NAME})\s+(JOB|PROC)\b", 2)
    step_name = F.regexp_extract(c, rf"(?i)^//({NAME})?\s+EXEC\s+\S", 1)
    rows = lines.select("*", F.upper(opens).alias("_opens"), F.rlike(c, F.lit(r"(?i)^//\s+PEND\b")).alias("_pend"), F.rlike(c, F.lit(rf"(?i)^//(?:{NAME})?\s+EXEC\s+\S")).alias("_exec"))
    by_line = Window.partitionBy(key).orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.when(F.col("_opens") == "PROC", 1).when(F.col("_pend"), -1).otherwise(0)).over(upto))
    rows = rows.withColumn("_floor", F.least(F.lit(0), F.min("_sum").over(upto)))
    rows = rows.withColumns({"_depth": F.col("_sum") - F.col("_floor"), "_bare": F.col("_pend") & (F.col("_floor") < F.coalesce(F.lag("_floor").over(by_line), F.lit(0)))})
    owner = F.struct(F.lower("_opens").alias("kind"), F.upper(F.regexp_extract(c, rf"(?i)^//({NAME})", 1)).alias("name"), F.col("line_no"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line_no"))
    event = F.when(F.col("_opens") != "", owner).when(F.col("_bare"), none)
    at_depth = Window.partitionBy(key, "_depth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("owner", F.last(event, ignorenulls=True).over(at_depth))
    rows = rows.withColumn("owner", F.when(F.col("owner.line_no").isNotNull(), F.col("owner")))
    rows = rows.withColumn("_part", F.sum(F.when((F.col("_opens") != "") | F.col("_pend"), 1).otherwise(0)).over(upto))
    step = F.when(F.col("_exec"), F.struct(F.when(step_name != "", F.upper(step_name)).otherwise("<unnamed>").alias("name"), F.col("line_no")))
    in_part = Window.partitionBy(key, "_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("step", F.last(step, ignorenulls=True).over(in_part)).drop("_opens", "_pend", "_sum", "_floor", "_depth", "_bare", "_part")


def _item(name: Column, library: Column | None = None, dynamic: Column | None = None) -> Column:
    no = F.lit(None).cast("string") if library is None else library
    return F.struct(name.alias("name"), no.alias("library"), (F.lit(False) if dynamic is None else dynamic).alias("dynamic"))


def job_references(context: DataFrame, key: str = "path") -> DataFrame:
    """What the lines of ``job_context`` refer to, with the step or owner that refers.

    ``contains_step, executes, invokes_proc, includes, dd_dataset, dd_member, dd_instream_data`` and, for operands that go on in
    the next line, ``requires_interpretation``. The source is the step where there is one, else the owner, else the member.
    All relations of a line are found in one pass, so that the lines are placed by member once.
    """
    c = F.col("code")
    head = rf"(?i)^//(?:{NAME})?\s+"
    no_step = F.lit(None).cast("struct<name:string,line_no:int>")

    def one(relation: str, kind: str, test: Column, item: Column, step: bool = True) -> Column:
        return F.when(test, F.struct((F.col("step") if step else no_step).alias("step"), F.lit(relation).alias("relation"), F.lit(kind).alias("kind"), *[item[n].alias(n) for n in ("name", "library", "dynamic")]))

    operand = F.regexp_extract(c, head + r"EXEC\s+(?:PGM\s*=\s*|PROC\s*=\s*)?('[^']*'|\"[^\"]*\"|[^\s,()]+)", 1)
    value = unquoted(operand)
    names, by_pgm = member_names(value), F.rlike(c, F.lit(head + r"EXEC\s+PGM\s*="))
    target = _item(names["name"], names["library"], ~is_name(names["name"]) | F.contains(value, F.lit("&")))
    included = unquoted(F.regexp_extract(c, head + r"INCLUDE\s+MEMBER\s*=\s*('[^']*'|[^\s,()]+)", 1))
    inner = member_names(included)
    rest = F.regexp_extract(c, head + r"DD\b(.*)", 1)
    is_dd = F.rlike(c, F.lit(head + r"DD\b"))
    dsn = unquoted(F.regexp_extract(rest, r"(?i)^(?:[^'\"]|'[^']*'|\"[^\"]*\")*?\bDSN(?:AME)?\s*=\s*('[^']*'|\"[^\"]*\"|[^,\s]*)", 1))
    has_dsn = is_dd & F.rlike(rest, F.lit(r"(?i)^(?:[^'\"]|'[^']*'|\"[^\"]*\")*?\bDSN(?:AME)?\s*="))
    static = is_name(dsn, rf"{QUALIFIED}(?:\((?:{NAME}|[+-]?\d+)\))?") & ~F.contains(dsn, F.lit("&"))
    member = rf"(?i)^({QUALIFIED})\(({NAME})\)$"
    goes_on = F.endswith(F.rtrim(c), F.lit(","))
    each = [
        one("contains_step", "jcl_step", F.col("_exec"), _item(F.col("step.name")), step=False),
        one("executes", "program", F.col("_exec") & by_pgm, target),
        one("invokes_proc", "proc", F.col("_exec") & ~by_pgm, target),
        one("requires_interpretation", "unknown_dependency", F.col("_exec") & goes_on, _item(F.lit("JCL_EXEC_CONTINUATION"), None, F.lit(True))),
        one("includes", "jcl_include", included != "", _item(inner["name"], inner["library"], ~is_name(inner["name"])), step=False),
        one("dd_dataset", "dataset", has_dsn, _item(F.when(dsn == "", "<unknown>").otherwise(dsn), None, ~static)),
        one("dd_member", "control_member", has_dsn & F.rlike(dsn, F.lit(member)), _item(F.regexp_extract(dsn, member, 2), F.regexp_extract(dsn, member, 1))),
        one("dd_instream_data", "in_stream_data", is_dd & F.rlike(rest, F.lit(r"(?i)^\s*(?:DATA|\*)(?=\s|,|$)")), _item(F.col("line_no").cast("string"))),
        one("requires_interpretation", "unknown_dependency", is_dd & goes_on, _item(F.lit("JCL_DD_CONTINUATION"), None, F.lit(True))),
    ]
    items = context.select(key, "line_no", "owner", F.array_compact(F.array(*each)).alias("_x"))
    return items.select(key, "line_no", "owner", F.explode("_x").alias("x")).select(key, "line_no", "owner", "x.*")


def program_context(lines: DataFrame, key: str = "path") -> DataFrame:
    """Lines with ``program``: the last PROGRAM-ID at or before them, null before the first."""
    name = F.regexp_extract("code", rf"(?i)^\s*PROGRAM-ID\s*\.\s*({NAME})\s*\.", 1)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("program", F.last(F.when(name != "", F.upper(name)), ignorenulls=True).over(w))


#: Calls of the message-queue interface.
MQ_CALLS = ("MQOPEN", "MQPUT", "MQPUT1", "MQGET", "MQCONN", "MQCONNX", "MQCLOSE", "MQDISC", "MQCMIT", "MQBACK")
OPERAND = r"(\"[^\"]*\"|'[^']*'|[^\s,()]+)"


def program_references(context: DataFrame, key: str = "path") -> DataFrame:
    """``(key, line_no, program, relation, kind, name, library, dynamic)`` of the lines of ``program_context``.

    ``calls, copies, sql_includes, cics_link, uses_map, uses_mapset, uses_mq``. Operands that are no literal are only known at
    run time, also those that stand in the next line. Nothing inside a literal counts.
    """
    c = F.col("code")

    def rows(relation: str, kind: str, pattern: str, literal: bool = True, keep: Column | None = None) -> DataFrame:
        values = context.select(key, "line_no", "program", c.alias("code"), F.explode(found(c, pattern)).alias("v"))
        names = member_names(unquoted(F.col("v")))
        quoted = F.rlike("v", F.lit(r"^['\"]"))
        dynamic = ~is_name(names["name"]) | (~quoted if literal else F.lit(False))
        out = values.select(key, "line_no", "program", F.lit(relation).alias("relation"), F.lit(kind).alias("kind"), names["name"].alias("name"), names["library"].alias("library"), dynamic.alias("dynamic"), quoted.alias("_quoted"), "code")
        return out

    calls = rows("calls", "program", rf"\bCALL\s+{OPERAND}")
    is_mq = F.col("_quoted") & F.col("name").isin(*MQ_CALLS)
    mq = calls.where(is_mq)
    copies = rows("copies", "copybook", rf"(?:^\s*)COPY\s+{OPERAND}", literal=False)
    qualifier = F.upper(F.regexp_extract("code", rf"(?i)\b(?:OF|IN)\s+({QUALIFIED})", 1))
    nothing = F.lit(None).cast("string")
    ends = lambda relation, kind, test, name: context.where(test).select(key, "line_no", "program", F.lit(relation).alias("relation"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), nothing.alias("library"), F.lit(True).alias("dynamic"))
    has = lambda pattern: F.size(found(c, f"({pattern})")) > 0
    plain = [
        calls.where(~is_mq),
        mq.withColumns({"kind": F.lit("platform_api"), "dynamic": F.lit(False)}),
        mq.where(F.col("name").isin("MQOPEN", "MQPUT", "MQPUT1", "MQGET", "MQCONN", "MQCONNX")).withColumns({"relation": F.lit("uses_mq"), "kind": F.lit("mq_interface"), "name": F.lit("<dynamic queue binding>"), "dynamic": F.lit(True)}),
        copies.withColumn("library", F.when(qualifier != "", qualifier).otherwise(F.col("library"))),
        rows("sql_includes", "copybook", rf"\bEXEC\s+SQL\s+INCLUDE\s+({NAME})", literal=False),
        rows("cics_link", "program", rf"\b(?:LINK|XCTL)\s+PROGRAM\s*\(\s*{OPERAND}"),
        rows("uses_map", "bms_map", rf"\b(?:SEND|RECEIVE)\s+MAP\s*\(\s*{OPERAND}"),
        rows("uses_mapset", "bms_mapset", rf"\bMAPSET\s*\(\s*{OPERAND}").where(F.rlike("code", F.lit(r"(?i)\b(?:SEND|RECEIVE)\s+MAP\s*\("))),
    ]
    columns = (key, "line_no", "program", "relation", "kind", "name", "library", "dynamic")
    open_ended = [
        ends("calls", "program", has(r"\bCALL\s*$"), "<continued CALL operand>"),
        ends("copies", "copybook", F.rlike(c, F.lit(r"(?i)^\s*COPY\s*$")), "<continued COPY operand>"),
        ends("cics_link", "program", has(r"\bEXEC\s+CICS\s+(?:LINK|XCTL)\b") & ~has(r"\bPROGRAM\s*\("), "<continued CICS PROGRAM operand>"),
    ]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in plain] + open_ended)


#: Words after FROM, JOIN, INTO and the like that name no table.
SQL_WORDS = frozenset(("FINAL", "OLD", "NEW", "TABLE", "SELECT", "VALUES", "SET", "JOIN", "WHERE", "ON", "GROUP", "ORDER", "LATERAL"))
_sql = {k: re.compile(p, re.I) for k, p in {
    "literal": r"\"(?:[^\"]|\"\")*\"?|'(?:[^']|'')*'?", "dynamic": r"\b(?:PREPARE|EXECUTE\s+IMMEDIATE)\b[^;]*?(?=END-EXEC|;|\Z)", "common": rf"\bWITH\s+({NAME})\s+AS\s*\(",
    "table": rf"\b(?:FROM|JOIN|INTO|UPDATE|REFERENCES)\s+(?:({QUALIFIED})|(\x00))", "declared": rf"\b(?:CREATE\s+TABLE\s+({QUALIFIED})|DECLARE\s+({QUALIFIED})\s+TABLE)\b", "list": r"\bFROM\s+[^;\n]*,",
}.items()}
MENTIONS = "array<struct<at:int,until:int,relation:string,kind:string,name:string,dynamic:boolean>>"


def sql_mentions(text: str) -> list[tuple]:
    """(first line, last line, relation, kind, name, dynamic) of what one SQL text mentions; lines count from 0.

    Names of common table expressions are no tables, anywhere in the text. What PREPARE or EXECUTE IMMEDIATE take is only known
    at run time, and so are delimited names. Lists after FROM and common table expressions need a closer look: a gap row.
    """
    blank = lambda m, first="": first + re.sub(r"[^\n]", " ", m[0])[len(first) :]
    plain = _sql["literal"].sub(lambda m: blank(m, "\x00"), text)
    line = lambda at: plain.count("\n", 0, at)
    out = [(line(m.start()), line(m.start()), "dynamic_sql", "db2_table", "<dynamic SQL>", True) for m in _sql["dynamic"].finditer(plain)]
    static = re.sub(r"(?i)\bEND-EXEC\b", "\x01END-EXEC", _sql["dynamic"].sub(blank, plain))
    common = {m[1].upper() for m in _sql["common"].finditer(plain)}
    out += [(line(m.start()), line(m.start()), "requires_interpretation", "unknown_dependency", "SQL_CTE_SCOPE", True) for m in _sql["common"].finditer(plain)]
    out += [(line(m.start()), line(m.start()), "requires_interpretation", "unknown_dependency", "SQL_COMPLEX_FROM", True) for m in _sql["list"].finditer(plain)]
    line = lambda at: static.count("\n", 0, at)
    for m in _sql["table"].finditer(static):
        name = m[1].upper() if m[1] else "<delimited SQL identifier>"
        if m[2] or name not in common | SQL_WORDS:
            out.append((line(m.start()), line(m.end()), "sql_table", "db2_table", name, bool(m[2])))
    out += [(line(m.start()), line(m.end()), "declares", "db2_table", (m[1] or m[2]).upper(), False) for m in _sql["declared"].finditer(static)]
    return sorted(out)


def sql_regions(lines: DataFrame, key: str = "path", whole: DataFrame | None = None) -> DataFrame:
    """The lines inside EXEC SQL ... END-EXEC, ends included; all lines of the members in ``whole`` (column ``key``), which hold plain SQL."""
    c = F.col("code")
    has = lambda pattern: F.size(found(c, f"({pattern})")) > 0
    opens, closes = has(r"\bEXEC\s+SQL\b"), has(r"\bEND-EXEC\b")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_after", F.when(closes, False).when(opens, True)).withColumn("_inside", opens | F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit(False)))
    if whole is not None:
        rows = rows.join(whole.select(key, F.lit(True).alias("_whole")).distinct(), key, "left").withColumn("_inside", F.col("_inside") | F.coalesce("_whole", F.lit(False))).drop("_whole")
    return rows.where("_inside").drop("_after", "_inside")


def sql_references(regions: DataFrame, key: str = "path") -> DataFrame:
    """``(key, line_no, end_line, program, relation, kind, name, dynamic)`` of the SQL lines of each member, read together."""
    one = regions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "code", "program"))).alias("l"))

    @F.pandas_udf(MENTIONS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(sql_mentions)

    found_in = one.select(key, "l", F.explode(run(F.array_join(F.transform("l", lambda x: x["code"]), "\n"))).alias("m"))
    at = lambda c: F.get("l", F.col(f"m.{c}"))
    return found_in.select(key, at("at")["line_no"].alias("line_no"), at("until")["line_no"].alias("end_line"), at("at")["program"].alias("program"), "m.relation", "m.kind", "m.name", "m.dynamic")


#: What a resource statement defines, and the commands that begin one.
RESOURCES = {"TRANSACTION": "cics_transaction", "PROGRAM": "cics_program_definition", "MAPSET": "cics_mapset_definition", "FILE": "cics_file_definition"}
COMMAND = r"^\s*(?:(?:DEFINE|ALTER|DELETE|LIST)\s+\w+\s*\(|(?:JOB|LJOB|LQ|LPRRN)\s*,\s*JOB\s*=)"


def resource_statements(lines: DataFrame, key: str = "path") -> DataFrame:
    """``(key, line_no, end_line, text)``: each command with the lines up to the next one; lines before the first are left out."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_at", F.last(F.when(F.rlike("code", F.lit("(?i)" + COMMAND)), F.col("line_no")), ignorenulls=True).over(w)).where("_at is not null")
    out = rows.groupBy(key, "_at").agg(F.max("line_no").alias("end_line"), F.sort_array(F.collect_list(F.struct("line_no", "code"))).alias("_l"))
    return out.select(key, F.col("_at").alias("line_no"), "end_line", F.array_join(F.transform("_l", lambda x: x["code"]), "\n").alias("text"))


def resource_references(statements: DataFrame, key: str = "path") -> DataFrame:
    """``(key, line_no, source_kind, source, relation, kind, name, dynamic)`` of resource and scheduler statements.

    ``declares`` for each resource, and ``binds_program, defines_mapset, schedules_job, job_dependency, defines_mq``, also where
    the operand stands some lines below its command.
    """
    t = F.col("text")
    first = lambda pattern, group=1: F.upper(F.regexp_extract(t, "(?i)" + pattern, group))
    defined = rf"^\s*(?:DEFINE|ALTER)\s+(TRANSACTION|PROGRAM|MAPSET|FILE)\s*\(\s*({NAME})\s*\)"
    what = first(defined)
    kinds = reduce(lambda out, kv: out.when(what == kv[0], kv[1]), RESOURCES.items(), F.when(F.lit(False), ""))
    job = first(rf"^\s*(?:JOB|LJOB|LQ|LPRRN)\s*,\s*JOB\s*=\s*({NAME})")
    queue_at = r"^\s*DEFINE\s+(?:QLOCAL|QREMOTE|QALIAS|CHANNEL)\s*\(\s*('[^']*'|\"[^\"]*\"|[^\s,()]*)"
    is_queue, queue = F.rlike(t, F.lit("(?i)" + queue_at)), unquoted(F.regexp_extract(t, "(?i)" + queue_at, 1))
    known = is_name(queue, QUALIFIED)
    own = F.when(kinds.isNotNull(), first(defined, 2)).when(job != "", job).when(is_queue & known, queue)
    own_kind = F.when(kinds.isNotNull(), kinds).when(job != "", "ca7_definition").when(is_queue & known, "mq_interface")
    item = lambda relation, kind, name, dynamic=F.lit(False): F.struct(F.lit(relation).alias("relation"), kind.alias("kind"), name.alias("name"), dynamic.alias("dynamic"))
    when = lambda test, x: F.when(test, F.array(x))
    bound = F.transform(found(F.regexp_replace(t, "(?i)" + defined, ""), rf"\bPROGRAM\s*\(\s*({NAME})\s*\)"), F.upper)
    after = F.transform(found(t, rf"\b(?:PRED|PREDECESSOR|DEPJOB|JOBDEP)\s*=\s*({NAME})"), lambda n: item("job_dependency", F.lit("job"), F.upper(n)))
    items = F.flatten(F.array_compact(F.array(
        when(own.isNotNull(), item("declares", own_kind, own)),
        when(kinds.isNotNull() & (F.size(bound) > 0), item("binds_program", F.lit("program"), F.get(bound, F.lit(0)))),
        when(what == "MAPSET", item("defines_mapset", F.lit("bms_mapset"), first(defined, 2))),
        when(job != "", item("schedules_job", F.lit("job"), job)),
        F.when(job != "", after),
        when(is_queue & ~known, item("defines_mq", F.lit("mq_interface"), F.when(queue == "", "<unknown queue>").otherwise(queue), F.lit(True))),
    )))
    return statements.select(key, "line_no", own_kind.alias("source_kind"), own.alias("source"), F.explode(items).alias("x")).select(key, "line_no", "source_kind", "source", "x.*")


def constructs(lines: DataFrame, key: str = "path") -> DataFrame:
    """Lines of ``scan`` with ``constructs``: what is inside EXEC SQL or EXEC CICS ... END-EXEC is of that family, also over
    several lines; what is outside is judged by ``lines.constructs``. EXEC and its dialect must stand in one line."""
    c = F.col("code")
    opened = F.upper(F.element_at(F.concat(F.array(F.lit("")), found(c, r"\bEXEC\s+(SQL|CICS)\b")), -1))
    last_open, last_end = F.size(found(c, r"(?:.*)\b(EXEC\s+(?:SQL|CICS))\b(?!.*END-EXEC)")) > 0, F.size(found(c, r"\b(END-EXEC)\b")) > 0
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_after", F.when(last_open, opened).when(last_end, ""))
    rows = rows.withColumn("_open", F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit("")))
    families = {"SQL": "embedded_sql", "CICS": "cics"}
    rest = F.when(F.col("_open") != "", F.regexp_replace(c, r"(?i)^.*?(?:END-EXEC\b|$)", "")).otherwise(c)
    of_open = reduce(lambda out, kv: out.when(F.col("_open") == kv[0], kv[1]), families.items(), F.when(F.trim(c) == "", None))

    def judged(code: Column) -> Column:
        own = F.array_compact(F.array(*[F.when(F.size(found(code, rf"\bEXEC\s+({k})\b")) > 0, v) for k, v in families.items()], of_open))
        cut = lambda regions: F.when(F.size(regions) > 0, F.regexp_replace(code, r"(?i)\bEXEC\s+(?:SQL|CICS)\b.*?(?:END-EXEC\b|$)", " ")).otherwise(code)
        nothing = lambda outside, regions: (F.size(regions) > 0) & ~F.rlike(outside, F.lit("[A-Za-z]"))
        plain = lambda outside, regions: F.when(nothing(outside, regions), F.array().cast("array<string>")).otherwise(single_lines.constructs_of(outside))
        return let(own, lambda regions: let(cut(regions), lambda outside: F.array_sort(F.array_union(plain(outside, regions), regions))))

    return rows.withColumn("constructs", let(rest, judged)).drop("_after", "_open")
