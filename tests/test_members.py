"""Members over several lines: the scanner, open steps and procedures, SQL regions, resource statements."""

from tallyfold.operators import members


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def scanned(text):
    return list(members.Scanner().lines(text))


def test_scanner_follows_comments_literals_and_data_over_lines():
    assert scanned("A /* one /* two\nthree */ four */ B -- gone\nC *> gone\n*> gone\n-- gone\n//* gone") == [(1, "A "), (2, "  B "), (3, "C ")]
    assert scanned("MOVE 'it''s -- in' TO X\nMOVE 'open CALL\nCALL \"X\" still' TO Y") == [(1, "MOVE 'it''s -- in' TO X"), (2, "MOVE 'open CALL"), (3, " " * 15 + " TO Y")]
    assert scanned("//A DD *\nCALL X\n//B DD DATA\n//C DD SYSOUT=*\n/*\n//D DD *,DLM='@@'\n//E DD X\n/*\n@@ end\n//F DD DATA,DLM=ZZ\nx\nZZ\n//G EXEC P\n/*") == [(1, "//A DD *"), (3, "//B DD DATA"), (6, "//D DD *,DLM='@@'"), (10, "//F DD DATA,DLM=ZZ"), (13, "//G EXEC P")]
    fixed = "000100* CALL A\n000200 MOVE A TO B." + " " * 60 + "TAIL\n      D COPY DEBUG.\n      * gone\n      / gone\n       CALL 'X'.\n      DELETE FROM T\n000300-    'rest'"
    assert [(n, c.rstrip()) for n, c in scanned(fixed)] == [(2, "MOVE A TO B."), (3, " COPY DEBUG."), (6, "CALL 'X'."), (7, "      DELETE FROM T"), (8, "    'rest'")]
    assert scanned("/* REXX */\nsay 1") == [(1, "/* REXX */ "), (2, "say 1")] and scanned("") == []


def jobs(spark, **texts):
    context = members.job_context(members.scan(files(spark, **texts)))
    rows = members.job_references(context).collect()
    name = lambda x: None if x is None else x["name"]
    return {(r["path"], r["line_no"], name(r["owner"]), name(r["step"]), r["relation"], r["name"], r["library"], r["dynamic"]) for r in rows}


def test_steps_belong_to_jobs_and_procedures(spark):
    text = "\n".join([
        "//NIGHT JOB", "//S1 EXEC PGM=MAIN", "//IN DD DSN=APP.LIB(MEM),DISP=SHR", "//INNER PROC", "//P1 EXEC PGM=LIB.DEEP", "// PEND",
        "//OUT DD DSN=APP.OUT", "//S2 EXEC INNER", "//X DD DSN='A.B',", "// INCLUDE MEMBER=SETUP", "//SYSIN DD *,DLM=@@", "//FAKE EXEC PGM=PAYLOAD", "@@", "// PEND", "// EXEC PGM=&WHAT",
    ])
    assert jobs(spark, a=text) == {
        ("a", 2, "NIGHT", None, "contains_step", "S1", None, False), ("a", 2, "NIGHT", "S1", "executes", "MAIN", None, False),
        ("a", 3, "NIGHT", "S1", "dd_dataset", "APP.LIB(MEM)", None, False), ("a", 3, "NIGHT", "S1", "dd_member", "MEM", "APP.LIB", False),
        ("a", 5, "INNER", None, "contains_step", "P1", None, False), ("a", 5, "INNER", "P1", "executes", "DEEP", "LIB", False),
        ("a", 7, "NIGHT", None, "dd_dataset", "APP.OUT", None, False), ("a", 8, "NIGHT", None, "contains_step", "S2", None, False), ("a", 8, "NIGHT", "S2", "invokes_proc", "INNER", None, False),
        ("a", 9, "NIGHT", "S2", "dd_dataset", "A.B", None, False), ("a", 9, "NIGHT", "S2", "requires_interpretation", "JCL_DD_CONTINUATION", None, True),
        ("a", 10, "NIGHT", None, "includes", "SETUP", None, False), ("a", 11, "NIGHT", "S2", "dd_instream_data", "11", None, False),
        ("a", 15, None, None, "contains_step", "<unnamed>", None, False), ("a", 15, None, "<unnamed>", "executes", "&WHAT", None, True),
    }


def test_nested_procedures_close_in_order(spark):
    text = "//A PROC\n//B PROC\n//C JOB\n//S1 EXEC PGM=X\n// PEND\n//S2 EXEC PGM=X\n//D PROC\n// PEND\n//S3 EXEC PGM=X\n// PEND\n//S4 EXEC PGM=X\n// PEND\n//E JOB\n//S5 EXEC PGM=X"
    owners = {r[5]: r[2] for r in jobs(spark, a=text) if r[4] == "contains_step"}
    assert owners == {"S1": "C", "S2": "A", "S3": "A", "S4": None, "S5": "E"}


def test_program_references_skip_literals_and_comments(spark):
    text = "\n".join([
        "COPY EARLY.", "PROGRAM-ID. MAIN.", "000100*CALL \"COMMENT\".", "MOVE \"CALL 'SHOWN' COPY FAKE\" TO T.", "CALL \"REAL\" *> CALL \"INLINE\".", "CALL TARGET-NAME. CALL 'LIB.SUB'.",
        "CALL \"MQPUT\".", "COPY REC OF LIBB.", "EXEC CICS LINK PROGRAM(PGM-VAR) END-EXEC.", "EXEC CICS XCTL PROGRAM('NEXT') END-EXEC.", "EXEC CICS SEND MAP('M1') MAPSET('S1') END-EXEC.", "CALL", "EXEC SQL INCLUDE SQLCA END-EXEC.",
    ])
    rows = members.program_references(members.program_context(members.scan(files(spark, a=text)))).collect()
    assert {(r["line_no"], r["program"], r["relation"], r["kind"], r["name"], r["library"], r["dynamic"]) for r in rows} == {
        (1, None, "copies", "copybook", "EARLY", None, False), (5, "MAIN", "calls", "program", "REAL", None, False), (6, "MAIN", "calls", "program", "TARGET-NAME", None, True),
        (6, "MAIN", "calls", "program", "SUB", "LIB", False), (7, "MAIN", "calls", "platform_api", "MQPUT", None, False), (7, "MAIN", "uses_mq", "mq_interface", "<dynamic queue binding>", None, True),
        (8, "MAIN", "copies", "copybook", "REC", "LIBB", False), (9, "MAIN", "cics_link", "program", "PGM-VAR", None, True), (10, "MAIN", "cics_link", "program", "NEXT", None, False),
        (11, "MAIN", "uses_map", "bms_map", "M1", None, False), (11, "MAIN", "uses_mapset", "bms_mapset", "S1", None, False), (12, "MAIN", "calls", "program", "<continued CALL operand>", None, True),
        (13, "MAIN", "sql_includes", "copybook", "SQLCA", None, False),
    }


def sql(spark, whole=None, **texts):
    lines = members.program_context(members.scan(files(spark, **texts)))
    listed = spark.createDataFrame([(w,) for w in whole], "path string") if whole else None
    rows = members.sql_references(members.sql_regions(lines, whole=listed)).collect()
    return {(r["path"], r["line_no"], r["end_line"], r["program"], r["relation"], r["name"], r["dynamic"]) for r in rows}


def test_sql_regions_name_tables_and_gaps(spark):
    static = "PROGRAM-ID. MAIN.\nMOVE \"SELECT * FROM FAKE.T\" TO TEXT.\nEXEC SQL\nSELECT X FROM APP.T -- JOIN BAD.T\nJOIN APP.U ON U.X = T.X\nEND-EXEC.\n*> EXEC SQL SELECT * FROM COMMENT.T END-EXEC.\nMOVE X FROM Y."
    assert sql(spark, a=static) == {("a", 4, 4, "MAIN", "sql_table", "APP.T", False), ("a", 5, 5, "MAIN", "sql_table", "APP.U", False)}
    odd = "EXEC SQL PREPARE S FROM TEXT END-EXEC.\nEXEC SQL SELECT X FROM \"APP\".\"T\" END-EXEC.\nEXEC SQL WITH C AS (SELECT * FROM B) SELECT * FROM C, D END-EXEC.\nEXEC SQL UPDATE\n  APP.V SET X = 'FROM Q' END-EXEC."
    assert sql(spark, b=odd) == {
        ("b", 1, 1, None, "dynamic_sql", "<dynamic SQL>", True), ("b", 2, 2, None, "sql_table", "<delimited SQL identifier>", True), ("b", 3, 3, None, "requires_interpretation", "SQL_CTE_SCOPE", True),
        ("b", 3, 3, None, "requires_interpretation", "SQL_COMPLEX_FROM", True), ("b", 3, 3, None, "sql_table", "B", False), ("b", 4, 5, None, "sql_table", "APP.V", False),
    }
    ddl = "CREATE TABLE APP.T (X INTEGER\n REFERENCES APP.W);\nSELECT A FROM (SELECT B FROM\nAPP.Z);"
    assert sql(spark, ["c"], c=ddl, d="DELETE FROM NOT.SQL") == {("c", 1, 1, None, "declares", "APP.T", False), ("c", 2, 2, None, "sql_table", "APP.W", False), ("c", 3, 4, None, "sql_table", "APP.Z", False)}


def test_resource_statements_over_lines(spark):
    text = "leading\nDEFINE TRANSACTION(T1) GROUP(G)\n  PROFILE(P)\n  PROGRAM(MAIN)\nDEFINE MAPSET(MS)\nDEFINE PROGRAM(PX) LANGUAGE(COBOL)\nLJOB,JOB=NIGHT,\n  PRED=DAY,DEPJOB=WEEK\nDEFINE QLOCAL('APP.Q1')\nDEFINE QALIAS(&Q)\nLIST GROUP(G)"
    rows = members.resource_references(members.resource_statements(members.scan(files(spark, a=text)))).collect()
    assert {(r["line_no"], r["source_kind"], r["source"], r["relation"], r["name"], r["dynamic"]) for r in rows} == {
        (2, "cics_transaction", "T1", "declares", "T1", False), (2, "cics_transaction", "T1", "binds_program", "MAIN", False),
        (5, "cics_mapset_definition", "MS", "declares", "MS", False), (5, "cics_mapset_definition", "MS", "defines_mapset", "MS", False), (6, "cics_program_definition", "PX", "declares", "PX", False),
        (7, "ca7_definition", "NIGHT", "declares", "NIGHT", False), (7, "ca7_definition", "NIGHT", "schedules_job", "NIGHT", False), (7, "ca7_definition", "NIGHT", "job_dependency", "DAY", False), (7, "ca7_definition", "NIGHT", "job_dependency", "WEEK", False),
        (9, "mq_interface", "APP.Q1", "declares", "APP.Q1", False), (10, None, None, "defines_mq", "&Q", True),
    }


def test_constructs_over_lines(spark):
    text = "\n".join(["MOVE A TO B. EXEC SQL", "SELECT X", "FROM T", "END-EXEC. ADD 1 TO C", "IF A", "EXEC CICS SEND MAP('M') END-EXEC", "DISPLAY 'EXEC SQL'.", "000100* MOVE A TO B.", "MOVE 'open", "CALL still' TO B", "05 X PIC 9.", "nothing known"])
    rows = members.constructs(members.scan(files(spark, a=text))).collect()
    assert {r["line_no"]: r["constructs"] for r in rows} == {
        1: ["assignment", "embedded_sql"], 2: ["embedded_sql"], 3: ["embedded_sql"], 4: ["arithmetic", "embedded_sql"], 5: ["conditional"], 6: ["cics"], 7: ["file_io"],
        9: ["assignment"], 10: ["unclassified_source"], 11: ["data_layout"], 12: ["unclassified_source"],
    }
