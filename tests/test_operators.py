from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import contract, lineage, lines, reconcile, review, windows


def col(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_text_functions(spark):
    assert col(spark, "a\r\nb\nc d\x85", T.physical_lines) == ["a", "b", "c", "d"]
    assert col(spark, "", T.physical_lines) == [] and col(spark, "\n\n", T.physical_lines) == ["", ""]
    assert col(spark, None, T.physical_lines) is None
    assert col(spark, "MOVE '*>' TO A *> note '", T.without_comment) == "MOVE '*>' TO A "
    assert col(spark, "x \"a*>b\" * y", T.without_comment) == "x \"a*>b\" * y"
    assert (col(spark, "a/b.c/name.tar.GZ", T.stem), col(spark, "a/b.c/name.tar.GZ", T.suffix)) == ("name.tar", ".gz")
    assert (col(spark, "a.b/plain", T.stem), col(spark, "a.b/plain", T.suffix)) == ("plain", "")
    assert tuple(col(spark, " lib.x(mem) ", T.member_of)) == ("LIB.X", "MEM") and tuple(col(spark, "mem", T.member_of)) == (None, "MEM")
    assert col(spark, "select * from a.b join c on 'from d' = 'x' update E", T.table_references) == ["A.B", "C", "E"]
    assert col(spark, " a; b,,c ;", T.list_cell) == ["a", "b", "c"]
    summary = lambda c: T.list_summary(c, 8)
    assert col(spark, ["ab", "cd", "efgh", "i"], summary, "array<string>") == "ab, cd (+2 more; 4 total)"
    assert col(spark, ["a much longer name"], summary, "array<string>") == "a much longer name" and col(spark, [], summary, "array<string>") == ""
    assert [col(spark, v, T.guarded) for v in ("=1", " @x", "a=1", None)] == ["'=1", "' @x", "a=1", None]
    assert [col(spark, v, T.valid_identifier) for v in ("A-1_b", "1a", "", None, "a b")] == [True, False, False, False, False]
    assert [col(spark, v, lambda c: T.condition_met(c, F.lit(4))) for v in ("always", " ", None, "RC <= 4", "rc=0", "RC<>1")] == [True, True, True, True, False, None]
    assert col(spark, "In Put", lambda c: T.location_key(c, {"input": "inbound"})) == "inbound"
    assert col(spark, 3, lambda c: T.percent(c, F.lit(0)), "int") is None and col(spark, 1, lambda c: T.percent(c, F.lit(3)), "int") == 33.33
    assert (col(spark, "ab", lambda c: T.fixed_width(c, 3)), col(spark, "abcd", lambda c: T.fixed_width(c, 3))) == ("ab ", None)
    a = spark.createDataFrame([(1, None)], "x int, y string")
    assert a.select(T.record_fingerprint("x", "y")).first() == a.select(T.record_fingerprint("y", "x")).first()


def test_lines(spark):
    source = "000100 IDENTIFICATION DIVISION.\n000200* note\n000300\n\n*> free\nMOVE A TO B\n000400-    'x'"
    got = lines.normalize_fixed(lines.explode_lines(spark.createDataFrame([("p", source)], "path string, text string")))
    assert [r["class"] for r in got.orderBy("line_no").collect()] == ["code", "comment", "blank", "blank", "comment", "code", "unsupported"]
    assert tuple(lines.line_counts(got).first()) == ("p", 7, 2, 2, 2)
    text = "A /* one\ntwo */ B 'it*/s' \"q\"\n//IN DD *\nCALL 'X'\n/*\n//OUT DD SYSOUT=A"
    cleaned = lines.clean_text(text)
    assert [len(x) for x in cleaned.split("\n")] == [len(x) for x in text.split("\n")]
    assert "one" not in cleaned and "two" not in cleaned and "CALL" not in cleaned and "DD SYSOUT" in cleaned and " B '" in cleaned
    assert spark.createDataFrame([(text,), (None,)], "t string").select(lines.cleaned("t")).collect()[0][0] == cleaned


def test_classification(spark):
    files = {
        "a/X.cbl": "IDENTIFICATION DIVISION.\nPROGRAM-ID. X.\n01 REC.\n SELECT A FROM B", "a/J.jcl": "//J1 JOB\n//S EXEC PGM=X\n//I DD *", "c/L.cpy": "01 REC.\n  05 A PIC X.",
        "m.map": "M DFHMSD\nX START", "t.sql": "CREATE TABLE T", "both.txt": "/* REXX */\nPROC 1", "late.txt": "\n" * 6 + "/* REXX */", "used.txt": "nothing", "none.txt": "nothing",
    }
    rows = lines.explode_lines(spark.createDataFrame(list(files.items()), "path string, text string"))
    got = {r["path"]: r for r in lines.classify(rows, referenced=spark.createDataFrame([("USED",)], "stem string")).collect()}
    kinds = {p: (r["kind"], r["confidence"]) for p, r in got.items()}
    assert kinds == {
        "a/X.cbl": ("cobol_program", "structural"), "a/J.jcl": ("jcl_job", "structural"), "c/L.cpy": ("copybook", "structural"), "m.map": ("bms_map", "structural"), "t.sql": ("sql", "structural"),
        "both.txt": ("ambiguous", "conflicting"), "late.txt": ("unknown", "unresolved"), "used.txt": ("copybook", "structural"), "none.txt": ("unknown", "unresolved"),
    }
    assert got["a/X.cbl"]["hint"] == ".cbl" and len(got["a/X.cbl"]["evidence"]) == 3 and got["none.txt"]["evidence"] is None
    found = lines.entities(rows, {"job": r"^//(\S+)\s+JOB", "program": r"PROGRAM-ID\.\s*([A-Z]+)"})
    assert {(r["kind"], r["name"]) for r in found.collect()} == {("job", "J1"), ("program", "X")}
    ordered = spark.createDataFrame([("p", 1, 1), ("p", 2, 3), ("p", 3, 2), ("p", 4, None)], "path string, line_no int, section int")
    assert [r["line_no"] for r in lines.out_of_order(ordered, "path", "line_no", F.col("section")).collect()] == [3]
    assert lines.unaccounted(ordered, ordered.where("line_no < 4"), ["path", "line_no"]).count() == 1


def test_windows(spark):
    numbers = spark.createDataFrame([("a", n) for n in (1, 2, 2, 3, 7, 8, 10)] + [("b", 5)], "k string, n int")
    assert sorted(map(tuple, windows.spans(numbers, ["k"], "n").collect())) == [("a", 1, 3), ("a", 7, 8), ("a", 10, 10), ("b", 5, 5)]
    ranges = spark.createDataFrame([("full", 1, 4, 9), ("full", 3, 9, 9), ("hole", 1, 3, 9), ("hole", 5, 9, 9), ("short", 1, 8, 9), ("late", 2, 9, 9)], "k string, a int, b int, total int")
    assert dict(map(tuple, windows.covers(ranges, ["k"], "a", "b", F.col("total")).collect())) == {"full": True, "hole": False, "short": False, "late": False}
    log = spark.createDataFrame([(1, "J", None), (2, None, None), (3, None, "end"), (4, None, None), (5, "K", None), (6, None, None)], "n int, job string, mark string").withColumn("p", F.lit(0))
    held = windows.carry_forward(log, ["p"], ["n"], F.col("job"), "ctx", F.col("mark").isNotNull())
    assert [r["ctx"] for r in held.orderBy("n").collect()] == ["J", "J", None, None, "K", "K"]
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), F.col("id"), (F.col("id") % 7).alias("s"))
    ranked = windows.global_rank(rows, ["h"], "rank", {"run": "s"}).orderBy("h").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 1001)) and ranked[-1]["run"] == sum(i % 7 for i in range(1000))
    assert all(b["run"] == a["run"] + b["s"] for a, b in zip(ranked, ranked[1:]))
    assert windows.prefix_budget(spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, None)], "k int, n int"), ["k"], "n", 10).count() == 2
    shown = windows.capped_list(numbers, ["k"], F.col("n").cast("string"), ["n"], 3).collect()
    assert {r["k"]: (r["items"], r["truncated"]) for r in shown} == {"a": (["1", "2", "2"], True), "b": (["5"], False)}


def test_greedy_selection_equals_the_loop(spark):
    import random

    rng = random.Random(8)
    cands = [(c, rng.choice("rst"), rng.random() < 0.3, rng.randrange(6)) for c in range(120)]
    chosen, seen, states = [], set(), {}
    for c, r, b, s in cands:  # witnesses first
        if (r, b) not in seen:
            seen.add((r, b))
            chosen.append(c)
            states.setdefault(r, set()).add(s)
    extra = []
    for c, r, _, s in cands:
        if s not in states[r] and len(states[r]) < 5:
            states[r].add(s)
            extra.append(c)
    want = (chosen + [c for c in extra if c not in chosen])[:12]
    df = spark.createDataFrame(cands, "c int, r string, b boolean, s int")
    assert [x["cand"] for x in windows.select_under_budget(df, "r", "b", "s", "c", 5, 12).collect()] == want


def test_reconcile(spark):
    e = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    a = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "k int, x string, y int")
    got = {r["k"]: (r["outcome"], r["differing"]) for r in reconcile.compare(e, a, ["k"]).collect()}
    assert got == {1: ("matched", []), 2: ("mismatch", ["y"]), 3: ("left_only", None), 4: ("right_only", None)}
    assert reconcile.verdict(reconcile.compare(e, a, ["k"]), 0).first()["status"] == "MISMATCH"
    assert reconcile.verdict(reconcile.compare(e, e, ["k"]), 1).first()["status"] == "MATCHED_WITH_GAPS"
    assert reconcile.same_set(e, e).first()["equal"] and not reconcile.same_set(e, a).first()["equal"]
    empty = e.limit(0).select(F.col("x").alias("d"))
    assert {(r["n"], r["share"]) for r in reconcile.disposition_counts(empty, "d", ["blocked"]).collect()} == {(0, None)}
    assert tuple(reconcile.coverage_summary(empty, "d").first()) == (0, 0, 0, 0, None, False)
    base = spark.createDataFrame([("jobs", 3), ("maps", 1)], "category string, declared long")
    assets = spark.createDataFrame([("jobs", "J", "h1", 1, False), ("jobs", "J", "h2", 2, False), ("jobs", "Z", "h", 3, True)], "category string, name string, hash string, process_id int, demo boolean")
    rows = {r["category"]: tuple(r)[1:] for r in reconcile.inventory(base, assets).collect()}
    assert rows == {"jobs": (3, 1, 2, 2, 2), "maps": (1, None, None, None, None)}
    assert [tuple(r) for r in reconcile.metrics_long(spark.createDataFrame([(1, None)], "a int, b int")).collect()] == [("a", "1"), ("b", "Unknown")]
    lines_ = spark.createDataFrame([("f", n) for n in (1, 5, 9, 100)], "path string, n int")
    spans = spark.createDataFrame([("f", "r1", 1, 5), ("f", "r2", 5, 99), ("g", "r3", 1, 9)], "path string, rule string, a int, b int")
    assert sorted((r["n"], r["rule"]) for r in reconcile.range_join(lines_, spans, "path", "n", "a", "b", 4).collect()) == [(1, "r1"), (5, "r1"), (5, "r2"), (9, "r2")]
    gaps = spark.createDataFrame([("MATCH",), ("MATCH",)], "label string").withColumns({"l": F.lit("x"), "r": F.lit("y")})
    assert tuple(reconcile.label_gaps(gaps, "l", "r").first()) == ("x", "y", 2, 0, True)
    assert reconcile.overall_status(gaps.limit(0).withColumn("status", F.lit("")), ["missing"]).first()["status"] == "COMPLETE"
    assert reconcile.actions(base.limit(1), [(F.col("declared") > 9, "no"), (F.col("declared") > 1, "a"), (F.lit(True), "b"), (F.lit(True), "c"), (F.lit(True), "d")]).first()["actions"] == ["a", "b", "c"]
    one = reconcile.snapshot_hash(e, "k", "x").first()[0]
    assert one == reconcile.snapshot_hash(e.orderBy(F.desc("k")), "k", "x").first()[0] != reconcile.snapshot_hash(a, "k", "x").first()[0]


def test_dispositions(spark):
    base = {"selected": True, "hash_ok": True, "kind": "program", "line_class": "code", "modeled": False, "terminal": False, "users_verified": None, "verified": True, "integrity_ok": True}
    cases = [
        ({"selected": False}, "out_of_scope"), ({"hash_ok": False}, "blocked"), ({"line_class": "blank"}, "non_executable"), ({"line_class": "paragraph"}, "non_executable"),
        ({"modeled": True}, "mapped_verified"), ({"modeled": True, "verified": False}, "mapped_unverified"), ({"terminal": True}, "platform_replaced_verified"), ({"modeled": True, "integrity_ok": False}, "mapped_unverified"),
        ({"kind": "copybook", "users_verified": False}, "mapped_unverified"), ({"kind": "copybook", "line_class": "group"}, "non_executable"), ({"kind": "job", "line_class": "exec"}, "mapped_verified"),
        ({"kind": "job", "line_class": "card", "verified": False}, "platform_replaced_unverified"), ({}, "blocked"),
    ]
    schema = "i int, selected boolean, hash_ok boolean, kind string, line_class string, modeled boolean, terminal boolean, users_verified boolean, verified boolean, integrity_ok boolean"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    assert [r["disposition"] for r in reconcile.dispose(df).orderBy("i").collect()] == [d for _, d in cases]


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "y"), ("c", "d", "x"), ("e", "f", "x")], "source string, target string, kind string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert dict(map(tuple, lineage.closure(edges, roots).collect())) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["id"] for r in lineage.closure(edges, roots, ["y"]).collect()} == {"a"}
    assert {r["id"] for r in lineage.on_cycle(edges).collect()} == {"a", "b", "c"}
    two = edges.union(spark.createDataFrame([("d", "g", "x"), ("g", "h", "x"), ("h", "g", "x")], edges.schema))
    assert {r["id"] for r in lineage.on_cycle(two).collect()} == {"a", "b", "c", "g", "h"}  # d lies between two cycles
    assert lineage.on_cycle(edges.where("kind = 'x'")).count() == 0
    refs = spark.createDataFrame([("j", "program", n, n.startswith("&")) for n in ("ONE", "TWO", "NONE", "&DYN", "SORT", "FAR", "TWICE")] + [("j", "dataset", "D", False)], "source string, kind string, name string, dynamic boolean")
    decl = spark.createDataFrame([("program", "ONE", "1"), ("program", "TWO", "2a"), ("program", "TWO", "2b")], "kind string, name string, target string")
    far = spark.createDataFrame([("program", "FAR", "f"), ("program", "TWICE", "t1"), ("program", "TWICE", "t2")], "kind string, name string, target string")
    got = {r["name"]: (r["resolution"], r["target"], r["gap"]) for r in lineage.resolve(refs, decl, spark.createDataFrame([("SORT",)], "key string"), far).collect()}
    assert got == {
        "ONE": ("resolved", "1", None), "TWO": ("ambiguous", None, "ambiguous"), "NONE": ("missing", None, "missing"), "&DYN": ("dynamic", None, "dynamic_unknown"), "SORT": ("utility", None, None),
        "FAR": ("resolved", "f", None), "TWICE": ("conflict", None, "source_conflict"), "D": ("missing", None, "unverified"),
    }
    source = lines.explode_lines(spark.createDataFrame([("p", "//S1 EXEC PGM=MAIN\n//S2 EXEC &P\n     CALL 'SUB'.\n COPY LAY.\n//D DD DISP=SHR,DSN=A.B")], "path string, text string"))
    found = {(r["relation"], r["name"], r["dynamic"]) for r in lineage.extract(source, lineage.REFERENCES).collect()}
    assert {("executes", "MAIN", False), ("invokes_proc", "&P", True), ("calls", "SUB", False), ("copies", "LAY", False), ("dd_dataset", "A.B", False)} <= found
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    fresh, conflicts = lineage.merge_sources(known, spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], known.schema))
    assert [r["path"] for r in fresh.collect()] == ["c"] and [r["path"] for r in conflicts.collect()] == ["b"]
    fresh, conflicts = lineage.merge_sources(known, spark.createDataFrame([("c", "3"), ("c", "4"), ("d", "1"), ("d", "1")], known.schema))
    assert [r["path"] for r in fresh.collect()] == ["d"] and {tuple(r) for r in conflicts.collect()} == {("c", None, "3"), ("c", None, "4")}
    runs = spark.createDataFrame([("k", 2, "b", 1), ("k", 2, "a", 9), ("k", 1, "z", 9)], "k string, v int, x string, y int")
    assert tuple(windows.latest(runs, ["k"], F.col("v"), "x", "y").first()) == ("k", "b", 1)  # both of one row
    bound = spark.createDataFrame([("x", True), ("x", False), ("y", False), ("z", True), ("z", True)], "logical_id string, available boolean")
    assert dict(map(tuple, lineage.binding_status(bound).collect())) == {"x": "resolved", "y": "input_unavailable", "z": "ambiguous"}
    ev = spark.createDataFrame([("n", "k", "N", ["e1"]), ("n", "k", "N", ["e2", "e1"])], "id string, kind string, name string, evidence array<string>")
    assert lineage.merged_nodes(ev).first()["evidence"] == ["e1", "e2"]
    libs = spark.createDataFrame([("A.LIB", "x/a/lib/m"), ("B.LIB", "x/a/lib/m"), (None, "q")], "lib string, path string")
    assert lineage.with_library(libs, "lib", "path").count() == 2


def test_review(spark):
    asked = review.items(spark.createDataFrame([(i, f"q{i}", "e", "rule") for i in range(5)], "id int, question string, evidence string, kind string"))
    back = [(0, "q0", "e", "rule", "Yes", None, None), (1, "q1", "e", "rule", " ", None, "ann"), (2, "changed", "e", "rule", "No", None, None), (3, "q3", "e", "rule", "Maybe", "c" * 3000, None), (9, "q9", "e", "rule", "Yes", None, None)]
    asked = asked.unionByName(review.items(spark.createDataFrame([(7, "q7", "e", "rule")], "id int, question string, evidence string, kind string")))
    back += [(7, "q7", "e", "rule", "Yes", None, None), (7, "q7", "e", "rule", "No", None, None)]
    good, bad = review.read_answers(asked, spark.createDataFrame(back, "id int, question string, evidence string, kind string, answer string, correction string, reviewer string"), "bob")
    assert {(r["id"], r["answer"], r["actor"]) for r in good.collect()} == {(0, "Yes", "bob"), (1, "Unanswered", "ann")}
    assert {(r["id"], r["violation"]) for r in bad.collect()} == {(2, "question changed"), (3, "unknown answer"), (3, "correction too long"), (4, "not returned"), (7, "returned twice"), (9, "not asked")}
    rules_ = spark.createDataFrame([(0, "P", "t"), (1, "P", "t"), (2, "Q", "t")], "id int, program string, text string")
    programs = spark.createDataFrame([("P", True, 0), ("Q", True, 3)], "program string, verified boolean, differences int")
    assert tuple(review.rule_credit(rules_, good, programs).first()) == (3, 1)
    assert review.check_items(asked.union(asked.limit(1)), 5).count() == 2
    fresh, conflicts = review.confirmed_knowledge(rules_, good, spark.createDataFrame([], "key string, text string"))
    assert fresh.count() == 1 and conflicts.count() == 0
    twice = rules_.unionByName(spark.createDataFrame([(0, "P", "other")], rules_.schema))
    fresh, conflicts = review.confirmed_knowledge(twice, good, spark.createDataFrame([], "key string, text string"))
    assert fresh.count() == 0 and conflicts.count() == 2
    assert contract.check_unique(asked, ["id"]).count() == 0


def test_masks_keep_places(spark):
    line = """a = 'it "is' b "x'y" c 'open"""
    assert col(spark, line, T.masked_literals) == """a = '      ' b "   " c '    """
    assert [col(spark, v, T.masked_literals) for v in ("", "''", None)] == ["", "''", None]


def test_constructs(spark):
    want = {
        "": [], "* MOVE A": [], "//* DD": [], "move a to b": ["assignment"], "IF A = 'MOVE' GO TO X": ["conditional", "control_flow"],
        "//S1 EXEC PGM=A": ["jcl_execution"], "// IF RC = 0 THEN": ["conditional"], "//X SYSOUT": ["unclassified_source"], "//D DD DSN=CALL": ["jcl_data"],
        "CALL 'MQPUT1' USING A": ["messaging"], "CALL 'MQX' USING A": ["calling"], "EXEC CICS READ FILE": ["cics"], "JOB, JOB=A": ["scheduling"],
        "01 MOVE-COUNT PIC 9": ["data_layout"], "MY-MOVE": ["unclassified_source"], None: ["unlocated_source"],
    }
    rows = lines.constructs(spark.createDataFrame([(k,) for k in want], "line string")).collect()
    assert {r["line"]: r["constructs"] for r in rows} == want


def test_answers_from_outside(spark):
    rows = [("s", "dataset", n, False) for n in ("ONE", "NONE", "TWO", "META", "UNKNOWN")] + [("s", "dataset", "&D", True), ("s", "db2_table", "PART", False), ("s", "program", "META", False)]
    resolved = lineage.resolve(spark.createDataFrame(rows, "source string, kind string, name string, dynamic boolean"), spark.createDataFrame([], "kind string, name string, target string"))
    bound = spark.createDataFrame([("ONE", "a", True), ("ONE", "b", False), ("NONE", "a", None), ("TWO", "a", True), ("TWO", "b", True), ("&D", "a", True)], "name string, location string, available boolean")
    known = spark.createDataFrame([("dataset", "META", True), ("db2_table", "PART", True), ("db2_table", "PART", None), ("program", "META", True)], "kind string, name string, complete boolean")
    got = {(r["kind"], r["name"]): (r["resolution"], r["gap"], r["target"]) for r in lineage.answered_outside(resolved, bound, known).collect()}
    assert got == {
        ("dataset", "ONE"): ("resolved", None, "a"), ("dataset", "NONE"): ("missing", "input_unavailable", None), ("dataset", "TWO"): ("ambiguous", "ambiguous", None),
        ("dataset", "META"): ("external", None, None), ("dataset", "UNKNOWN"): ("missing", "unverified", None), ("dataset", "&D"): ("dynamic", "dynamic_unknown", None),
        ("db2_table", "PART"): ("external", "partial_discovery", None), ("program", "META"): ("missing", "missing", None),
    }
    files = spark.createDataFrame([("a", "cobol"), ("b", "unknown"), ("c", "pli")], "path string, kind string")
    assert sorted(tuple(r) for r in lineage.unparsed(files).collect()) == [("source_file", "b", "unresolved_parser"), ("source_file", "c", "unresolved_parser")]


def test_denominators_with_unknown_and_negative_counts(spark):
    rows = spark.createDataFrame([("a", "blocked"), ("a", "out_of_scope"), ("a", "non_executable"), ("b", None), ("b", "mapped_verified"), ("c", "mapped_unverified")], "u string, d string")
    profile = reconcile.line_profile(rows, ["u"], "d")
    got = {r["u"]: (r["scope_adds_up"], r["applicable_adds_up"], r["verified_adds_up"], r["reconciled"]) for r in reconcile.denominators(profile).collect()}
    assert got == {"a": (True, True, True, True), "b": (True, True, False, False), "c": (True, True, True, True)}
    unknown = profile.where("u = 'c'").withColumn("lines", F.lit(None).cast("long"))
    assert [r["reconciled"] for r in reconcile.denominators(unknown).collect()] == [False]
    negative = profile.where("u = 'c'").withColumns({"blocked": F.lit(-1), "unverified": F.col("unverified") + 1})
    assert [(r["verified_adds_up"], r["reconciled"]) for r in reconcile.denominators(negative).collect()] == [(True, False)]


def test_validation_rollup_of_no_programs_and_of_missing_validations(spark):
    rows = spark.createDataFrame([("x", 4, 5, 0, True, 0), ("y", 4, 1, 2, True, 0), ("y", 3, None, None, None, 0), ("z", 1, 1, 0, True, 2), ("w", 1, 1, 0, None, 0)], "k string, known long, meeting long, gaps long, complete boolean, blocked long")
    got = {r["k"]: (r["validated"], r["known"], r["missing"], r["gaps"], r["complete"]) for r in reconcile.validation_rollup(rows, ["k"]).collect()}
    assert got == {"x": (1, 4, 0, 0, True), "y": (1, 7, 6, 2, True), "z": (1, 1, 0, 0, False), "w": (1, 1, 0, 0, False)}
    assert tuple(reconcile.validation_rollup(rows.limit(0)).first()) == (0, 0, 0, 0, False, 0)


def test_invalid_witnesses_keep_the_other_values(spark):
    from tallyfold.operators import contract, testdata

    layout = [contract.Field("n", "integer", 3), contract.Field("t", "string", 2)]
    rows = spark.createDataFrame([(1, 7, '"\\'), (2, None, "ab"), (3, 999, "\n}")], "id int, n int, t string")
    made = testdata.invalid_witnesses(rows, layout, ["id"])
    assert made.count() == 3 * 16 and contract.validate_json(made, "raw", layout).where("input_status = 'ACCEPT_INPUT'").count() == 0
    short = {r["id"]: r["errors"] for r in contract.validate_json(made.where("case = 't short'"), "raw", layout).collect()}
    assert short == {1: ["t: invalid fixed-width string"], 2: ["n: invalid unsigned integer", "t: invalid fixed-width string"], 3: ["t: invalid fixed-width string"]}
    number = {r["id"]: r["errors"] for r in contract.validate_json(made.where("case = 'n negative'"), "raw", layout).collect()}
    assert set(map(tuple, number.values())) == {("n: invalid unsigned integer",)}


def test_seeded_numbers_are_those_of_md5(spark):
    import hashlib

    from tallyfold.operators import testdata

    rows = spark.range(50).select("id", testdata.seeded(9, F.col("id"), F.lit("x")).alias("n")).collect()
    assert all(r["n"] == int(hashlib.md5(f"9:{r['id']}:x".encode()).hexdigest()[:15], 16) for r in rows)
