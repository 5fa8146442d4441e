"""Ordered rule sets and step chains as Columns: one narrow projection for each rule, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.shared import materialize
from tallyfold.functions.text import condition_met, let

#: Rules between two checkpoints of a very long chain.
CHAIN = 50


@dataclass(frozen=True)
class Atom:
    """``left op right``, where the right side is a literal or another field (``peer``)."""

    left: str
    op: str
    literal: int | float | str | None = None
    peer: str | None = None


@dataclass(frozen=True)
class Rule:
    """``when`` is an OR of ANDs. Effects are (field, literal) pairs in order; the last one for a field wins."""

    rule_id: str
    when: tuple[tuple[Atom, ...], ...]
    then: tuple[tuple[str, int | str], ...] = ()
    otherwise: tuple[tuple[str, int | str], ...] = ()
    refs: tuple[str, ...] = field(default=())


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def compare(op: str, left: Column, right: Column) -> Column:
    match op:
        case "=":
            return left == right
        case "<>":
            return left != right
        case "<":
            return left < right
        case "<=":
            return left <= right
        case ">":
            return left > right
        case ">=":
            return left >= right
    raise ValueError(f"unknown operator {op}")


def atom(a: Atom, widths: dict[str, int]) -> Column:
    if a.peer is not None:
        return compare(a.op, column(a.left), column(a.peer))
    if isinstance(a.literal, str):
        if a.left in widths and len(a.literal) > widths[a.left]:
            raise ValueError(f"literal {a.literal!r} is wider than {a.left}")
        if a.op not in ("=", "<>"):
            raise ValueError("strings have no order here")
        return compare(a.op, column(a.left), F.lit(a.literal.ljust(widths.get(a.left, 0))))
    return compare(a.op, column(a.left), F.lit(a.literal))


def predicate(dnf: tuple[tuple[Atom, ...], ...], widths: dict[str, int] | None = None) -> Column:
    """AND binds tighter than OR. Short literals are blank-padded to the width of their field."""
    return reduce(Column.__or__, [reduce(Column.__and__, [atom(a, widths or {}) for a in group]) for group in dnf])


def apply_rules(df: DataFrame, rules: list[Rule], widths: dict[str, int] | None = None, prefix: str = "") -> DataFrame:
    """Run the rules in order and add ``trace``: an array of (rule_id, branch).

    Each rule first fixes its branch as a column, then makes all its assignments, so that a later rule sees earlier writes
    and no branch is computed again. A null predicate counts as false.
    """
    widths, out, branches = widths or {}, df, []
    for i, rule in enumerate(rules):
        name = f"{prefix}branch_{i}"
        out = out.withColumn(name, F.coalesce(predicate(rule.when, widths), F.lit(False)))
        yes, no = dict(rule.then), dict(rule.otherwise)
        value = lambda f, arm: column(f) if f not in arm else F.lit(arm[f].ljust(widths.get(f, 0)) if isinstance(arm[f], str) else arm[f])
        out = out.withColumns({f: F.when(F.col(name), value(f, yes)).otherwise(value(f, no)) for f in yes | no})
        branches.append((rule.rule_id, name))
        if i % CHAIN == CHAIN - 1:
            out = materialize(out)
    trace = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(b).alias("branch")) for r, b in branches])
    return out.withColumn(f"{prefix}trace", trace).drop(*[b for _, b in branches])


def branch_outcomes(traced: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(rule_id, branch, n)`` for both branches of every rule; 0 where none was seen."""
    seen = traced.select(F.explode("trace").alias("t")).groupBy("t.rule_id", "t.branch").agg(F.count("*").alias("n"))
    both = traced.sparkSession.createDataFrame([(r.rule_id, b) for r in rules for b in (True, False)], "rule_id string, branch boolean")
    return both.join(seen, ["rule_id", "branch"], "left").select("rule_id", "branch", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Step:
    name: str
    rules: tuple[Rule, ...]
    condition: str = "Always"


def run_steps(df: DataFrame, steps: list[Step], valid: Column | None = None, widths: dict[str, int] | None = None) -> DataFrame:
    """Feed each row through the steps; add ``steps``: (step, status, rc), and ``rc``.

    A step whose condition does not hold for the last return code is SKIPPED and leaves the row alone. Where ``valid`` is
    false before a step, that step is REJECTED with a null code and ends the row's chain (NOT_RUN).
    """
    out, results = df.withColumn("rc", F.lit(0)), []
    for i, step in enumerate(steps):
        run, good = f"_run_{i}", F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
        met = F.coalesce(condition_met(F.lit(step.condition), F.col("rc")), F.lit(False))
        status = F.when(F.col("rc").isNull(), "NOT_RUN").when(~met, "SKIPPED").when(good, "ACCEPT_INPUT").otherwise("REJECT_INPUT")
        out = out.withColumn(run, status)
        touched = sorted({f for r in step.rules for f, _ in r.then + r.otherwise})
        before = {f: f"_before_{i}_{k}" for k, f in enumerate(touched)}
        out = out.withColumns({b: column(f) for f, b in before.items()})
        out = apply_rules(out, list(step.rules), widths, f"_{i}_").drop(f"_{i}_trace")
        out = out.withColumns({f: F.when(F.col(run) == "ACCEPT_INPUT", column(f)).otherwise(F.col(b)) for f, b in before.items()}).drop(*before.values())
        out = out.withColumn("rc", F.when(F.col(run) == "ACCEPT_INPUT", F.lit(0)).when(F.col(run) == "SKIPPED", F.col("rc")))
        results.append(F.struct(F.lit(step.name).alias("step"), F.col(run).alias("status"), F.when(F.col(run) == "ACCEPT_INPUT", F.lit(0)).alias("rc")))
    return out.withColumn("steps", F.array(*results)).drop(*[f"_run_{i}" for i in range(len(steps))])


def atoms_table(spark, corpus: dict[str, list[Rule]]) -> DataFrame:
    """``(program, rule_id, ord, left, op, literal, peer)`` of every comparison in a rule corpus, literals as text."""
    rows = [(p, r.rule_id, k, a.left, a.op, None if a.literal is None else str(a.literal), a.peer) for p, rules in corpus.items() for r in rules for k, a in enumerate(a for g in r.when for a in g)]
    return spark.createDataFrame(rows, "program string, rule_id string, ord int, left string, op string, literal string, peer string")


def check_rules(atoms: DataFrame, layout: DataFrame) -> DataFrame:
    """``(program, rule_id, ord, violation)``: unknown fields, unequal types or widths, ordered strings, literals too wide."""
    fields = layout.select("program", "field", "type", "width")
    left = fields.select("program", F.col("field").alias("left"), F.col("type").alias("lt"), F.col("width").alias("lw"))
    right = fields.select("program", F.col("field").alias("peer"), F.col("type").alias("rt"), F.col("width").alias("rw"))
    both = atoms.join(left, ["program", "left"], "left").join(right, ["program", "peer"], "left")
    text = F.col("lt") == "string"
    checks = {
        "unknown field": F.col("lt").isNull() | (F.col("peer").isNotNull() & F.col("rt").isNull()),
        "types differ": (F.col("lt") != F.col("rt")) | (F.col("literal").isNotNull() & (F.col("lt") == "integer") & ~F.rlike("literal", F.lit("^[0-9]+$"))),
        "widths differ": text & (F.col("rt") == "string") & (F.col("lw") != F.col("rw")),
        "strings have no order": text & ~F.col("op").isin("=", "<>"),
        "literal too wide": F.length("literal") > F.col("lw"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return both.select("program", "rule_id", "ord", F.explode(found).alias("violation"))


def relationships(atoms: DataFrame) -> DataFrame:
    """Pairs of fields that a rule compares for equality."""
    return atoms.where("op = '=' and peer is not null").select("program", "rule_id", "left", F.col("peer").alias("right")).distinct()


def plain_text(atoms: DataFrame) -> DataFrame:
    """``(program, rule_id, text)``: the comparisons of a rule in words, in order."""
    words = F.create_map(*[F.lit(x) for kv in {"=": "equals", "<>": "differs from", "<": "is below", "<=": "is at most", ">": "is above", ">=": "is at least"}.items() for x in kv])
    one = F.concat_ws(" ", "left", F.element_at(words, F.col("op")), F.coalesce("peer", "literal"))
    return atoms.groupBy("program", "rule_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "; ").alias("text"))


NUMBERS, TEXTS = ("A", "B"), ("FLAG", "TEXT-A", "TEXT-B")
RULE_TABLE = (
    "program_index long, rules array<struct<when:array<array<struct<op:string,numeric:boolean,left:int,peer:int,number:long,text:string>>>,"
    "then:struct<numbers:array<long>,texts:array<string>>,otherwise:struct<numbers:array<long>,texts:array<string>>>>"
)


def rule_table(spark, programs: dict[int, list[Rule]]) -> DataFrame:
    """Rules over the fields NUMBERS and TEXTS as rows, one for each program: predicates as arrays of atoms with field places,
    effects as arrays in the fields' order (null leaves a field alone)."""

    def one(a: Atom) -> tuple:
        numeric = a.left in NUMBERS
        names = NUMBERS if numeric else TEXTS
        return (a.op, numeric, names.index(a.left), None if a.peer is None else names.index(a.peer), a.literal if numeric else None, None if numeric else a.literal)

    values = lambda effects: ([dict(effects).get(f) for f in NUMBERS], [dict(effects).get(f) for f in TEXTS])
    rows = [(p, [([[one(a) for a in g] for g in r.when], values(r.then), values(r.otherwise)) for r in own]) for p, own in programs.items()]
    return spark.createDataFrame(rows, RULE_TABLE)


def checked_by_columns(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``input_status``, ``numbers`` and ``texts`` (both null when rejected) for records whose limits stand in the row
    (``maximum``, ``text_width``)."""
    names = sorted(NUMBERS + TEXTS)
    out = rows.withColumns({"_v": F.try_parse_json(F.col(raw)), "_keys": F.array_sort(F.json_object_keys(F.col(raw)))})
    kind = lambda n: F.schema_of_variant(F.variant_get(F.col("_v"), f'$["{n}"]', "variant"))
    get = lambda n, t: F.try_variant_get(F.col("_v"), f'$["{n}"]', t)
    out = out.withColumns({"_n": F.array(*[F.when(kind(n) == "BIGINT", get(n, "bigint")) for n in NUMBERS]), "_t": F.array(*[F.when(kind(n) == "STRING", get(n, "string")) for n in TEXTS])})
    good = (F.col("_keys") == F.array(*[F.lit(n) for n in names])) & F.forall("_n", lambda x: F.coalesce(x.between(F.lit(0), F.col("maximum")), F.lit(False)))
    width = lambda i: F.length(F.get("_t", F.lit(i)))
    good = good & (width(0) == 1) & (width(1) == F.col("text_width")) & (width(2) == F.col("text_width"))
    out = out.withColumn("input_status", F.when(F.coalesce(good, F.lit(False)), "ACCEPT_INPUT").otherwise("REJECT_INPUT"))
    kept = F.col("input_status") == "ACCEPT_INPUT"
    return out.withColumns({"numbers": F.when(kept, F.col("_n")), "texts": F.when(kept, F.col("_t"))}).drop("_v", "_keys", "_n", "_t")


def run_rule_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Run each accepted row through its program's rules in order; ``numbers, texts, branches`` follow. The rule table is
    broadcast: it has one row for each program."""

    def related(op: Column, x: Column, y: Column) -> Column:
        return F.when(op == "=", x == y).when(op == "<>", x != y).when(op == "<", x < y).when(op == "<=", x <= y).when(op == ">", x > y).otherwise(x >= y)

    def holds(state: Column, a: Column) -> Column:
        side = lambda values, literal: (F.get(state[values], a["left"]), F.coalesce(F.get(state[values], a["peer"]), a[literal]))
        return F.when(a["numeric"], related(a["op"], *side("numbers", "number"))).otherwise(related(a["op"], *side("texts", "text")))

    def step(acc: Column, rule: Column) -> Column:
        branch = F.exists(rule["when"], lambda group: F.forall(group, lambda a: holds(acc, a)))

        def after(b: Column) -> Column:
            arm = F.when(b, rule["then"]).otherwise(rule["otherwise"])
            new = lambda values: F.zip_with(arm[values], acc[values], lambda e, v: F.coalesce(e, v)).alias(values)
            return F.struct(new("numbers"), new("texts"), F.concat(acc["branches"], F.array(b)).alias("branches"))

        return F.get(F.transform(F.array(branch), after), F.lit(0))

    start = F.struct(F.col("numbers").alias("numbers"), F.col("texts").alias("texts"), F.array().cast("array<boolean>").alias("branches"))
    out = rows.join(F.broadcast(table), "program_index").withColumn("_r", F.when(F.col("numbers").isNotNull(), F.aggregate("rules", start, step)))
    return out.withColumns({c: F.col(f"_r.{c}") for c in ("numbers", "texts", "branches")}).drop("_r", "rules")


def compiled(rules: Sequence[Rule]) -> Callable[[Column], Column]:
    """The rules as one expression from state to state: a struct of ``numbers``, ``texts`` and ``branches``."""

    def holds(state: Column, a: Atom) -> Column:
        values, names = ("numbers", NUMBERS) if a.left in NUMBERS else ("texts", TEXTS)
        at = lambda name: F.get(state[values], F.lit(names.index(name)))
        return compare(a.op, at(a.left), at(a.peer) if a.peer is not None else F.lit(a.literal))

    def written(state: Column, values: str, names: Sequence[str], rule: Rule, branch: Column) -> Column:
        yes, no = dict(rule.then), dict(rule.otherwise)
        old = lambda i: F.get(state[values], F.lit(i))
        kind = "long" if values == "numbers" else "string"
        arm = lambda effects, i, n: F.lit(effects[n]).cast(kind) if n in effects else old(i)
        return F.array(*[F.when(branch, arm(yes, i, n)).otherwise(arm(no, i, n)) if n in yes or n in no else old(i) for i, n in enumerate(names)]).alias(values)

    def run(state: Column, rest: Sequence[Rule]) -> Column:
        if not rest:
            return state
        rule = rest[0]
        test = reduce(Column.__or__, [reduce(Column.__and__, [holds(state, a) for a in group]) for group in rule.when])
        after = lambda b: F.struct(written(state, "numbers", NUMBERS, rule, b), written(state, "texts", TEXTS, rule, b), F.concat(state["branches"], F.array(b)).alias("branches"))
        return let(test, lambda b: let(after(b), lambda new: run(new, rest[1:])))

    return lambda state: run(state, list(rules))


def run_compiled(rows: DataFrame, programs: dict[int, list[Rule]], batch: int = 20) -> DataFrame:
    """``numbers, texts, branches`` after each row's own program, as ``run_rule_table`` gives them, with every program compiled
    to Column branches. Programs are dispatched a batch at a time, then one by one; a row without a program keeps null branches."""
    start = F.struct("numbers", "texts", F.array().cast("array<boolean>").alias("branches"))
    indexes = sorted(programs)
    at = F.col("program_index")

    def dispatch(state: Column) -> Column:
        out = None
        for i in range(0, len(indexes), batch):
            inner = None
            for p in indexes[i : i + batch]:
                inner = (F if inner is None else inner).when(at == p, compiled(programs[p])(state))
            test = at.between(indexes[i], indexes[min(i + batch, len(indexes)) - 1])
            out = (F if out is None else out).when(test, inner)
        return out

    out = rows.withColumn("_s", F.when(F.col("numbers").isNotNull(), let(start, dispatch)))
    return out.withColumns({c: F.col(f"_s.{c}") for c in ("numbers", "texts", "branches")}).drop("_s")
