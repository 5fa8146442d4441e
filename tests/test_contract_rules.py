import pytest
from pyspark.sql import functions as F

from tallyfold.operators import contract, rules, testdata
from tallyfold.operators.contract import Field
from tallyfold.operators.rules import Atom, Rule, Step

LAYOUT = [Field("A", "integer", 2), Field("T", "string", 3)]
BAD_A, BAD_T = "A: invalid unsigned integer", "T: invalid fixed-width string"


@pytest.mark.parametrize(
    ("raw", "errors"),
    [
        ('{"A": 5, "T": "abc"}', []),
        ('{"T": "é b", "A": 99}', []),
        ('{"A": 100, "T": "abcd"}', [BAD_A, BAD_T]),
        ('{"A": -1, "T": "abc"}', [BAD_A]),
        ('{"A": true, "T": "abc"}', [BAD_A]),
        ('{"A": 1.0, "T": "abc"}', [BAD_A]),
        ('{"A": "1", "T": 123}', [BAD_A, BAD_T]),
        ('{"A": null, "T": null}', [BAD_A, BAD_T]),
        ('{"A": 12345678901234567890123, "T": "abc"}', [BAD_A]),
        ('{"A": 5}', [contract.BAD_FIELD_SET, BAD_T]),
        ('{"A": 5, "T": "abc", "X": 1}', [contract.BAD_FIELD_SET]),
        ('{"A": 5, "A": 6, "T": "abc"}', [contract.NOT_AN_OBJECT]),
        ("[1]", [contract.NOT_AN_OBJECT]),
        ("{", [contract.NOT_AN_OBJECT]),
        (None, [contract.NOT_AN_OBJECT]),
    ],
)
def test_json_contract(spark, raw, errors):
    row = contract.validate_json(spark.createDataFrame([(raw,)], "raw string"), "raw", LAYOUT).first()
    assert row["errors"] == errors
    assert row["input_status"] == ("REJECT_INPUT" if errors else "ACCEPT_INPUT")
    assert (row["record"] is None) == bool(errors)


def test_typed_contract_lists_all_errors_by_name(spark):
    rows = spark.createDataFrame([(1, 5, "abc"), (2, None, None), (3, 100, "ab ")], "id int, A long, T string")
    got = {r["id"]: r["errors"] for r in contract.validate(rows, LAYOUT).collect()}
    assert got == {1: [], 2: [BAD_A, BAD_T], 3: [BAD_A]}
    good, bad = contract.split_accepted(contract.validate(rows, LAYOUT))
    assert good.count() == 1 and bad.count() == 2


def test_every_invalid_witness_is_rejected(spark):
    made = testdata.invalid_rows(spark, LAYOUT)
    assert made.count() == 2 * 2 + 4 + 3 + 2 + 3
    assert contract.validate_json(made, "raw", LAYOUT).where("input_status = 'ACCEPT_INPUT'").count() == 0
    base = spark.range(1).select(testdata.record_json(LAYOUT).alias("raw"))
    assert contract.validate_json(base, "raw", LAYOUT).first()["record"].asDict() == {"A": 0, "T": "   "}


def test_the_four_rule_example(spark):
    example = [
        Rule("R001", ((Atom("AGE", ">=", 18),),), (("DECISION", "Y"),), (("DECISION", "N"),)),
        Rule("R002", ((Atom("ACTIVE", "=", "N"),),), (("DECISION", "N"),)),
        Rule("R003", ((Atom("CUSTOMER-ID", "<>", peer="REF-CUSTOMER-ID"),),), (("DECISION", "N"),)),
        Rule("R004", ((Atom("AMOUNT", ">", 50000),),), (("DECISION", "R"),)),
    ]
    rows = [(0, 0, " ", 0, 0, " "), (1, 18, "Y", 1, 50000, " "), (1, 18, "N", 1, 0, " "), (1, 20, "Y", 2, 0, " "), (1, 20, "N", 2, 50001, " ")]
    df = spark.createDataFrame(rows, "`CUSTOMER-ID` long, AGE long, ACTIVE string, `REF-CUSTOMER-ID` long, AMOUNT long, DECISION string")
    got = [(r["DECISION"], [t["branch"] for t in r["trace"]]) for r in rules.apply_rules(df, example, {"ACTIVE": 1, "DECISION": 1}).collect()]
    assert got == [("N", [False] * 4), ("Y", [True, False, False, False]), ("N", [True, True, False, False]), ("N", [True, False, True, False]), ("R", [True] * 4)]
    seen = {(r["rule_id"], r["branch"]): r["n"] for r in rules.branch_outcomes(rules.apply_rules(df.limit(1), example), example).collect()}
    assert seen["R001", True] == 0 and seen["R001", False] == 1 and len(seen) == 8


def test_rules_feed_back_and_the_last_effect_wins(spark):
    chain = [
        Rule("1", ((Atom("a", ">", 1), Atom("b", "=", 0)), (Atom("b", "=", 9),)), (("b", 1), ("b", 2)), (("b", 3),)),
        Rule("2", ((Atom("b", "=", 2),),), (("a", 0),)),
        Rule("3", ((Atom("a", "=", 0), Atom("t", "=", "x")),), (("t", "yes"),), (("t", "no"),)),
    ]
    df = spark.createDataFrame([(2, 0, "x  "), (1, 0, "x  "), (0, 9, "y  "), (None, 0, "x  ")], "a int, b int, t string")
    assert [(r["a"], r["b"], r["t"]) for r in rules.apply_rules(df, chain, {"t": 3}).collect()] == [(0, 2, "yes"), (1, 3, "no "), (0, 2, "no "), (None, 3, "no ")]
    with pytest.raises(ValueError, match="wider"):
        rules.predicate(((Atom("t", "=", "abcd"),),), {"t": 3})
    with pytest.raises(ValueError, match="no order"):
        rules.predicate(((Atom("t", "<", "a"),),), {"t": 3})


def test_long_chain(spark):
    chain = [Rule(f"R{i:03d}", ((Atom("a", "=", i),),), (("a", i + 1),)) for i in range(60)]
    assert rules.apply_rules(spark.createDataFrame([(0,), (30,)], "a int"), chain).select("a").distinct().collect()[0][0] == 60


def test_steps(spark):
    add = lambda name, n, cond="Always": Step(name, (Rule("r", ((Atom("a", "<", 10),),), (("a", n),)),), cond)
    df = spark.createDataFrame([(1,), (50,)], "a int")
    out = rules.run_steps(df, [add("ONE", 5), add("TWO", 6, "RC > 0"), add("THREE", 7, " rc=0 ")], F.col("a") < 40).collect()
    assert [(r["a"], r["rc"], [s["status"] for s in r["steps"]]) for r in out] == [(7, 0, ["ACCEPT_INPUT", "SKIPPED", "ACCEPT_INPUT"]), (50, None, ["REJECT_INPUT", "NOT_RUN", "NOT_RUN"])]


def test_rule_checks(spark):
    layout = spark.createDataFrame([("P", "G", "A", "integer", 3, "0"), ("P", "G", "S", "string", 2, " "), ("P", "G", "L", "string", 300, ""), ("P", None, "S", "string", 2, "abc")], "program string, grp string, field string, type string, width int, default string")
    assert {(r["field"], r["violation"]) for r in contract.check_layout(layout).collect()} == {("L", "width"), ("S", "group"), ("S", "default"), ("S", "duplicate name")}
    one = layout.dropDuplicates(["field"])
    corpus = {"P": [Rule("1", ((Atom("A", "<", 3), Atom("S", "=", "abc")), (Atom("S", "<", "a"),))), Rule("2", ((Atom("A", "=", peer="S"), Atom("S", "=", peer="L"), Atom("Q", "=", 1)),))]}
    atoms = rules.atoms_table(spark, corpus)
    assert sorted((r["rule_id"], r["ord"], r["violation"]) for r in rules.check_rules(atoms, one).collect()) == [("1", 1, "literal too wide"), ("1", 2, "strings have no order"), ("2", 0, "types differ"), ("2", 1, "widths differ"), ("2", 2, "unknown field")]
    assert {(r["left"], r["right"]) for r in rules.relationships(atoms).collect()} == {("A", "S"), ("S", "L")}
    assert "A is below 3" in {r["rule_id"]: r["text"] for r in rules.plain_text(atoms).collect()}["1"]
    assert contract.incompatible_fields(one.withColumn("program", F.lit("Q")).where("field <> 'L'").unionByName(one)).first()["field"] == "L"


def test_manifest_and_domain_checks(spark):
    rows = [("p", 1, "J", 1, "S"), ("p", 1, "j", 1, "s"), ("p", 2000, "K", 1, "S"), ("p", 2, "K", 2, "T")]
    got = {(r["job"], r["violation"]) for r in contract.check_manifest(spark.createDataFrame(rows, "process_id string, job_order int, job string, step_order int, step string")).collect()}
    assert {("J", "duplicate step order"), ("J", "duplicate step name"), ("J", "job names collide"), ("K", "job has several orders"), ("K", "job order")} <= got
    counts = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1), ("z", 1)], "key string, n int")
    assert {(r["key"], r["violation"]) for r in contract.check_domain(counts, "key", ["a", "b", "c"], "n").collect()} == {("c", "missing"), ("z", "unknown"), ("b", "count"), ("a", "repeated")}


def test_defaults_and_groups(spark):
    layout = [Field("A", "integer", 2, "G"), Field("B", "string", 2, "H", "x")]
    row = contract.fill_defaults(spark.createDataFrame([(None,)], "A long"), layout)
    assert tuple(row.first()) == (0, "x ")
    groups = contract.project_groups(layout)
    assert row.select(groups["G"], groups["H"]).first().asDict(True) == {"G": {"A": 0}, "H": {"B": "x "}}


def test_campaign_has_no_divergence(spark):
    cases = spark.range(20_000).select((F.col("id") % testdata.PROGRAMS).alias("program_index"), F.expr(f"id div {testdata.PROGRAMS}").alias("case_index"))
    made = testdata.scenarios(cases, 7)
    rows = rules.run_rule_table(rules.checked_by_columns(testdata.expected(made)), rules.rule_table(spark, {i: testdata.program_rules(i)[1] for i in range(testdata.PROGRAMS)}))
    bad = rows.agg(F.expr("count_if(not (expected.status <=> input_status) or (expected.status = 'ACCEPT_INPUT' and not (expected.branches = branches and expected.flag = texts[0] and expected.a = numbers[0] and expected.b = numbers[1]))) as bad"))
    assert bad.first()["bad"] == 0
    labels = {r["label"]: r["n"] for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(testdata.INVALID) <= set(labels) and sum(n for k, n in labels.items() if k.startswith("valid_")) == 16_000
    again = testdata.replay(cases, 3, 5, 7).first()
    assert again["raw"] == made.where("program_index = 3 and case_index = 5").first()["raw"]


def test_typed_rules_agree_with_the_rule_table(spark):
    cases = spark.range(3000).select(F.lit(180).alias("program_index") + F.col("id") % 2, F.col("id").alias("case_index")).toDF("program_index", "case_index")
    rows = rules.checked_by_columns(testdata.expected(testdata.scenarios(cases, 1))).where("input_status = 'ACCEPT_INPUT'")
    for program in (180, 181):
        _, own = testdata.program_rules(program)
        typed = rows.where(F.col("program_index") == program).select("case_index", "expected", F.col("a").alias("A"), F.col("b").alias("B"), F.col("flag").alias("FLAG"), F.col("ta").alias("TEXT-A"), F.col("tb").alias("TEXT-B"))
        out = rules.apply_rules(typed.select("case_index", "expected", "A", "B", "FLAG", "TEXT-A", "TEXT-B"), own)
        assert out.agg(F.expr("count_if(FLAG <> expected.flag or A <> expected.a or B <> expected.b) as bad")).first()["bad"] == 0


def test_sensitivity_and_generation(spark):
    rule = [Rule("R1", ((Atom("a", ">", 5),),), (("d", "Y"),), (("d", "N"),))]
    df = spark.createDataFrame([(5, " "), (6, " ")], "a int, d string")
    got = {r["mutation"]: r["noticed"] for r in testdata.sensitivity(df, rule, ["d"]).collect()}
    assert got == {"R1 swapped arms": 2, "R1 moved boundary": 1, "R1 disabled": 2, "R1 changed effect": 1}
    layout = spark.createDataFrame([("P", "A", "integer", 1), ("P", "T", "string", 2)], "program string, field string, type string, width int")
    atoms = rules.atoms_table(spark, {"P": [Rule("1", ((Atom("A", ">=", 9), Atom("T", "=", "x")),))]})
    values = {(r["field"], r["value"]) for r in testdata.boundaries(atoms, layout).collect()}
    assert {("A", "8"), ("A", "9"), ("A", "0"), ("T", "x "), ("T", "  "), ("T", "ZZ")} <= values and ("A", "10") not in values
    assert {r["value"] for r in testdata.domain_values(layout, 20).collect()} == set(range(10))
    combos = testdata.interactions([spark.range(3).toDF("x"), spark.range(4).toDF("y")], 1)
    assert sorted((r["case_no"], r["x"], r["y"]) for r in combos.collect()) == [(x * 4 + y, x, y) for x in range(3) for y in range(4)]
    pairs = testdata.correlated(spark.range(500).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")), "a", "b", 5)
    assert {r["label"] for r in pairs.select("label").distinct().collect()} == {"MATCH", "INTENTIONAL_MISMATCH"}
    cands = spark.createDataFrame([("f", False, "second", 2), ("f", True, "first", 1)], "fp string, mandatory boolean, reason string, ord int")
    assert testdata.deduplicated(cands, "fp", "mandatory", "reason", "ord").first()[1:3] == (True, "first")
    why = spark.createDataFrame([(9, 9, 99), (9, 3, 5), (9, 3, 99), (3, 3, 99)], "av int, ch int, dom int")
    assert [r[0] for r in why.select(testdata.shortfall(F.col("av"), F.col("ch"), F.col("dom"), 8)).collect()] == [None, "limited domain", "budget exhausted", "generation exhausted"]
