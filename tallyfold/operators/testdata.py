"""Test rows: boundary, invalid, interaction and correlated cases, scenario tables and rule sensitivity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.contract import Field
from tallyfold.operators.rules import Atom, Rule, apply_rules, column


def seeded_hex(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def seeded(seed: int, *parts: Column) -> Column:
    """A repeatable number for a row, from 0 to 2^60 - 1: the first 15 hex digits of the MD5 of seed and parts, joined by colons.

    Any engine can make it again, so what is drawn with it can be checked from outside.
    """
    return F.conv(F.substring(seeded_hex(seed, *parts), 1, 15), 16, 10).cast("long")


def boundaries(atoms: DataFrame, layout: DataFrame, seed: int = 0) -> DataFrame:
    """``(program, field, value)``: each literal and its neighbours, zero, the maximum and one seeded value, as text.

    Text fields get their literals, blanks and Z's, padded to the width.
    """
    a = atoms.where("literal is not null").select("program", F.col("left").alias("field"), "literal")
    with_layout = layout.join(a, ["program", "field"], "left")
    top = F.rpad(F.lit(""), F.col("width"), "9").cast("long")
    n = F.col("literal").try_cast("long")
    numbers = F.array(n - 1, n, n + 1, F.lit(0).cast("long"), top, F.pmod(seeded(seed, F.col("program"), F.col("field")), top + 1))
    numbers = F.transform(F.filter(F.array_compact(numbers), lambda v: v.between(0, top)), lambda v: v.cast("string"))
    texts = F.array_compact(F.array(F.rpad("literal", F.col("width"), " "), F.rpad(F.lit(""), F.col("width"), " "), F.rpad(F.lit(""), F.col("width"), "Z")))
    return with_layout.select("program", "field", F.explode(F.when(F.col("type") == "integer", numbers).otherwise(texts)).alias("value")).distinct()


def record_json(layout: Sequence[Field], base: dict[str, Column] | None = None, drop: str | None = None) -> Column:
    """A record as JSON text from defaults and the given raw JSON values."""
    import json

    base = base or {}
    items = [F.concat(F.lit(json.dumps(f.name) + ":"), base.get(f.name, F.lit(json.dumps(f.filled())))) for f in layout if f.name != drop]
    items += [F.concat(F.lit(json.dumps(n) + ":"), v) for n, v in base.items() if n not in {f.name for f in layout}]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def invalid_cases(layout: Sequence[Field], base: dict[str, Column] | None = None) -> Column:
    """An array of ``(case, raw)``: each field out of range, of the wrong type, null, short, long and missing; an extra field; no object.

    The other fields of a case have the raw JSON values of ``base``, else their defaults.
    """
    import json

    base = base or {}
    cases: list[tuple[str, Column]] = []
    for f in layout:
        values = {"null": "null", "boolean": "true"}
        if f.kind == "integer":
            values |= {"negative": "-1", "overflow": str(f.maximum + 1), "text": '"1"', "fraction": "1.5"}
        else:
            values |= {"short": json.dumps("x" * (f.width - 1)), "long": json.dumps("x" * (f.width + 1)), "number": "7"}
        cases += [(f"{f.name} {k}", record_json(layout, base | {f.name: F.lit(v)})) for k, v in values.items()]
        cases.append((f"{f.name} missing", record_json(layout, base, drop=f.name)))
    cases += [("extra field", record_json(layout, base | {"EXTRA": F.lit("1")})), ("no object", F.lit("[]")), ("no JSON", F.lit("{"))]
    return F.array(*[F.struct(F.lit(c).alias("case"), raw.alias("raw")) for c, raw in cases])


def invalid_rows(spark, layout: Sequence[Field]) -> DataFrame:
    """``(case, raw)``: the invalid cases of a layout around its defaults."""
    return spark.range(1).select(F.explode(invalid_cases(layout)).alias("r")).select("r.*")


def invalid_witnesses(rows: DataFrame, layout: Sequence[Field], keys: Sequence[str]) -> DataFrame:
    """``(*keys, case, raw)``: the invalid cases around every row's own values, a narrow projection.

    A null field is written as JSON null. Texts are escaped as JSON texts.
    """
    value = lambda f: F.col(f.name).cast("string") if f.kind == "integer" else F.regexp_extract(F.to_json(F.struct(F.col(f.name).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    written = {f"_written_{i}": F.when(F.col(f.name).isNull(), "null").otherwise(value(f)) for i, f in enumerate(layout)}
    base = {f.name: F.col(c) for f, c in zip(layout, written)}
    return rows.select(*keys, *[v.alias(c) for c, v in written.items()]).select(*keys, F.explode(invalid_cases(layout, base)).alias("r")).select(*keys, "r.*")


def interactions(domains: Sequence[DataFrame], budget: int) -> DataFrame:
    """Combinations of small value tables in mixed-radix order, at most 16 for each row of the budget, 4,096 at most.

    Each domain is a one-column table of a layout's few values; the product stops at the cap.
    """
    cap = min(4096, 16 * budget)
    out = None
    for d in domains:
        name = d.columns[0]
        values = d.orderBy(name).limit(cap).select(F.collect_list(name).alias("v"))  # within the cap by construction
        out = values.select(F.posexplode("v").alias("case_no", name)) if out is None else (
            out.join(values).select(*[c for c in out.columns if c != "case_no"], (F.col("case_no") * F.size("v")).alias("_base"), F.posexplode("v").alias("_i", name))
            .withColumn("case_no", F.col("_base") + F.col("_i")).drop("_base", "_i").where(F.col("case_no") < cap)
        )
    return out


def domain_values(layout: DataFrame, minimum: int, seed: int = 0) -> DataFrame:
    """``(field, value)`` of integer fields: the first 2k values, 2k seeded ones and the extremes, distinct."""
    top = F.rpad(F.lit(""), F.col("width"), "9").cast("long")
    first = F.transform(F.sequence(F.lit(0), F.lit(2 * minimum - 1)), lambda i: i.cast("long"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(2 * minimum - 1)), lambda i: F.pmod(seeded(seed, F.col("field"), i), top + 1))
    every = F.filter(F.concat(first, drawn, F.array(top)), lambda v: v <= top)
    return layout.where("type = 'integer'").select("field", F.explode(F.array_distinct(every)).alias("value"))


def correlated(rows: DataFrame, left: str, right: str, every: int) -> DataFrame:
    """Rows with ``right`` made equal to ``left``, but deliberately unequal in one of ``every`` rows; and ``label``."""
    odd = F.pmod(seeded(0, F.col(left), F.col(right)), F.lit(every)) == 0
    return rows.withColumn(right, F.when(odd, F.col(left) + 1).otherwise(F.col(left))).withColumn("label", F.when(F.col(left) == F.col(right), "MATCH").otherwise("INTENTIONAL_MISMATCH"))


def deduplicated(candidates: DataFrame, fingerprint: str, mandatory: str, reason: str, order: str) -> DataFrame:
    """One row for each fingerprint: mandatory if any is, the reason of the first."""
    return candidates.groupBy(fingerprint).agg(F.bool_or(mandatory).alias(mandatory), F.min_by(reason, order).alias(reason), F.min(order).alias(order))


def shortfall(available: Column, chosen: Column, domain: Column, minimum: int) -> Column:
    """Why fewer than ``minimum`` states were chosen; null where there are enough. The budget is only to blame where enough were available."""
    return F.when(chosen >= minimum, F.lit(None).cast("string")).when(domain < minimum, "limited domain").when(available >= minimum, "budget exhausted").otherwise("generation exhausted")


#: Families of generated rule programs.
FAMILIES = ("literal_threshold", "numeric_peer", "and_correlation", "or_and_precedence", "write_then_compare", "ordered_overwrite", "character_peer", "two_group_join", "reversed_literal", "three_rule_feedback")
OPERATORS = ("=", "<>", "<", "<=", ">", ">=")
INVALID = ("negative_numeric", "numeric_overflow", "boolean_numeric", "fractional_type_numeric", "short_character", "long_character", "missing_numeric_field", "extra_field", "null_character", "multiple_layout_errors")
VARIANTS = 20
PROGRAMS = len(FAMILIES) * VARIANTS


def choose(values: Sequence, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def with_specification(cases: DataFrame) -> DataFrame:
    """Cases ``(program_index, case_index)`` with what their program compares: a narrow projection of integer arithmetic."""
    p = F.col("program_index")
    out = cases.withColumns({"family": choose(FAMILIES, p / VARIANTS), "variant": p % VARIANTS})
    v = F.col("variant")
    out = out.withColumns({"width": choose((3, 4, 6, 9, 18), v % 5), "text_width": (2 + v % 4).cast("int"), "operator": choose(OPERATORS, v % 6)})
    out = out.withColumn("maximum", choose([10**w - 1 for w in (3, 4, 6, 9, 18)], v % 5))
    m = F.col("maximum")
    out = out.withColumn("threshold", F.get(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.expr("maximum div 2"), m - 1, m), (F.floor(v / 4) % 5).cast("int")))
    return out.withColumn("assignment", F.when(F.col("threshold") == m, 0).otherwise(F.col("threshold") + 1).cast("long"))


def scenarios(cases: DataFrame, seed: int, valid_of_ten: int = 8) -> DataFrame:
    """Cases with ``label`` and ``raw`` (JSON): four fifths valid, the others invalid in one of ten ways.

    Values come from the case's numbers and the seed alone, so any case can be made again by itself.
    """
    i, m, t = F.col("case_index"), F.col("maximum"), F.col("threshold")
    draw = lambda salt: F.pmod(seeded(seed, F.col("program_index"), i, F.lit(salt)), m + 1)
    near = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), m - 1, m, t, F.greatest(F.lit(0), t - 1), F.least(m, t + 1))
    out = with_specification(cases).withColumn("a", F.when(i % 8 < 4, F.get(near, (F.floor(i / 8) % 7).cast("int"))).otherwise(draw(1)))
    a = F.col("a")
    out = out.withColumn("b", F.when(i % 4 == 0, a).when(i % 4 == 1, F.greatest(F.lit(0), a - 1)).when(i % 4 == 2, F.least(m, a + 1)).otherwise(draw(2)))
    text = lambda salt: F.translate(F.substring(seeded_hex(seed, F.col("program_index"), i, F.lit(salt)), F.lit(1), F.col("text_width")), "0123456789abcdef", " Aaz09* Aaz09*> ")
    out = out.withColumn("ta", F.rpad(text(3), F.col("text_width"), " "))
    out = out.withColumn("tb", F.when(i % 3 == 0, F.col("ta")).otherwise(F.rpad(text(4), F.col("text_width"), " ")))
    out = out.withColumn("flag", choose((" ", "T", "F", "Y", "N"), i % 5))
    bad = F.when(F.pmod(i, F.lit(10)) >= valid_of_ten, choose(INVALID, F.pmod(seeded(seed, F.col("program_index"), i, F.lit(5)), F.lit(10))))
    out = out.withColumn("label", F.coalesce(bad, choose(("valid_equal_peer", "valid_lower_peer", "valid_upper_peer", "valid_independent_peer"), i % 4)))
    is_ = lambda name: F.col("label") == name
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = lambda c: c.cast("string")
    values = {
        "A": F.when(is_("negative_numeric") | is_("multiple_layout_errors"), "-1").when(is_("boolean_numeric"), "true").otherwise(number(a)),
        "B": F.when(is_("numeric_overflow"), number(m + 1)).when(is_("fractional_type_numeric"), F.concat(number(F.col("b")), F.lit(".5"))).otherwise(number(F.col("b"))),
        "FLAG": quoted(F.col("flag")),
        "TEXT-A": F.when(is_("null_character"), "null").when(is_("short_character"), quoted(F.substring("ta", F.lit(2), F.col("text_width")))).otherwise(quoted(F.col("ta"))),
        "TEXT-B": F.when(is_("multiple_layout_errors"), "[]").when(is_("long_character"), quoted(F.concat("tb", F.lit("X")))).otherwise(quoted(F.col("tb"))),
    }
    pair = lambda name: F.concat(F.lit(f'"{name}":'), values[name])
    items = [F.when(~is_("missing_numeric_field"), pair("A")), *[pair(n) for n in list(values)[1:]], F.when(is_("extra_field"), F.lit('"EXTRA":1'))]
    return out.withColumn("raw", F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}")))


def replay(cases: DataFrame, program_index: int, case_index: int, seed: int) -> DataFrame:
    """One scenario made again from its numbers."""
    return scenarios(cases.where((F.col("program_index") == program_index) & (F.col("case_index") == case_index)), seed)


def relation(op: Column, left: Column, right: Column) -> Column:
    return F.when(op == "=", left == right).when(op == "<>", left != right).when(op == "<", left < right).when(op == "<=", left <= right).when(op == ">", left > right).otherwise(left >= right)


def expected(rows: DataFrame) -> DataFrame:
    """Add ``expected`` (status, a, b, flag, branches) by family, written down apart from the rule evaluator."""
    a, b, ta, tb, t, n, op, family = (F.col(c) for c in ("a", "b", "ta", "tb", "threshold", "assignment", "operator", "family"))
    one = (
        F.when(family == "literal_threshold", relation(op, a, t)).when(family == "ordered_overwrite", relation(op, a, t) & (ta != tb))
        .when(family.isin("numeric_peer", "write_then_compare", "three_rule_feedback"), relation(op, a, b))
        .when(family == "and_correlation", relation(op, a, t) & (b >= a)).when(family == "or_and_precedence", relation(op, a, t) | ((b == a) & (ta == tb)))
        .when(family == "character_peer", F.when(F.col("variant") % 2 == 0, ta == tb).otherwise(ta != tb))
        .when(family == "two_group_join", relation(op, a, b) & (ta == tb)).otherwise(relation(op, t, a))
    )
    out = rows.withColumn("_1", one)
    first = F.col("_1")
    written, fed = family == "write_then_compare", family == "three_rule_feedback"
    new_a = F.when(written, F.when(first, n).otherwise(t)).otherwise(a)
    second = F.when(written, new_a == n).when(fed, first & (ta == tb))
    new_b = F.when(fed, F.when(second, n).otherwise(t)).otherwise(b)
    third = F.when(fed, (new_b == n) | (a == new_b))
    flag = F.when(fed, F.when(third, "Y").otherwise("N")).when(F.when(written, second).otherwise(first), "T").otherwise("F")
    good = F.startswith("label", F.lit("valid_"))
    kept = lambda c: F.when(good, c)
    return out.withColumn("expected", F.struct(F.when(good, "ACCEPT_INPUT").otherwise("REJECT_INPUT").alias("status"), kept(new_a).alias("a"), kept(new_b).alias("b"), kept(flag).alias("flag"), kept(F.array_compact(F.array(first, second, third))).alias("branches"))).drop("_1")


def program_rules(program_index: int) -> tuple[list[Field], list[Rule]]:
    """Layout and rules of a generated program."""
    family, v = FAMILIES[program_index // VARIANTS], program_index % VARIANTS
    width, op = (3, 4, 6, 9, 18)[v % 5], OPERATORS[v % 6]
    top = 10**width - 1
    t = (0, 1, top // 2, top - 1, top)[v // 4 % 5]
    n = (t + 1) % (top + 1)
    mirrored = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
    limit, peer, same = Atom("A", op, t), Atom("A", op, peer="B"), Atom("TEXT-A", "=", peer="TEXT-B")
    apart = replace(same, op="<>")
    when = {
        "literal_threshold": ((limit,),), "numeric_peer": ((peer,),), "and_correlation": ((limit, Atom("B", ">=", peer="A")),),
        "or_and_precedence": ((limit,), (Atom("B", "=", peer="A"), same)), "write_then_compare": ((peer,),), "ordered_overwrite": ((limit, apart),),
        "character_peer": ((same if v % 2 == 0 else apart,),), "two_group_join": ((peer, same),), "reversed_literal": ((Atom("A", mirrored, t),),), "three_rule_feedback": ((peer,),),
    }[family]
    yes, no = (("FLAG", "T"),), (("FLAG", "F"),)
    rules = [Rule("R001", when, yes, no)]
    if family == "write_then_compare":
        rules = [Rule("R001", when, (("A", n),), (("A", t),)), Rule("R002", ((Atom("A", "=", n),),), yes, no)]
    elif family == "ordered_overwrite":
        rules = [Rule("R001", when, (("FLAG", "P"), *yes), (("FLAG", "Q"), *no))]
    elif family == "three_rule_feedback":
        rules += [Rule("R002", ((Atom("FLAG", "=", "T"), same),), (("B", n),), (("B", t),)), Rule("R003", ((Atom("B", "=", n),), (Atom("A", "=", peer="B"),)), (("FLAG", "Y"),), (("FLAG", "N"),))]
    text = 2 + v % 4
    return [Field("A", "integer", width), Field("B", "integer", width), Field("FLAG", "string", 1), Field("TEXT-A", "string", text), Field("TEXT-B", "string", text)], rules


def sensitivity(df: DataFrame, rules: Sequence[Rule], outputs: Sequence[str], widths: dict[str, int] | None = None) -> DataFrame:
    """``(mutation, rows, noticed)``: how many rows show each change of the rules. All variants run in one pass over the rows."""
    variants: dict[str, list[Rule]] = {}
    moved = {">": ">=", ">=": ">", "<": "<=", "<=": "<", "=": "<>", "<>": "="}
    for i, r in enumerate(rules):
        put = lambda name, new, i=i: variants.__setitem__(f"{rules[i].rule_id} {name}", [*rules[:i], new, *rules[i + 1 :]])
        put("swapped arms", replace(r, then=r.otherwise, otherwise=r.then))
        put("moved boundary", replace(r, when=((replace(r.when[0][0], op=moved[r.when[0][0].op]), *r.when[0][1:]), *r.when[1:])))
        put("disabled", replace(r, then=(), otherwise=()))
        changed = tuple((f, v + 1 if isinstance(v, int) else "#" * len(v)) for f, v in r.then)
        put("changed effect", replace(r, then=changed))
    base = df.select(F.struct("*").alias("_row"), *[column(c) for c in df.columns])
    out = apply_rules(base, list(rules), widths).drop("trace").select("_row", F.struct(*[column(c) for c in outputs]).alias("_base"))
    results = []
    for k, (_, mutated) in enumerate(variants.items()):
        out = out.select("*", *[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
        out = apply_rules(out, mutated, widths).withColumn(f"_m{k}", F.struct(*[column(c) for c in outputs])).drop("trace", *df.columns)
        results.append(F.struct(F.lit(list(variants)[k]).alias("mutation"), (~F.col(f"_m{k}").eqNullSafe(F.col("_base"))).alias("noticed")))
    return out.select(F.explode(F.array(*results)).alias("r")).groupBy("r.mutation").agg(F.count("*").alias("rows"), F.count_if("r.noticed").alias("noticed"))
