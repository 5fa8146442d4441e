import json

from pyspark.sql import functions as F

from tallyfold.plans.ledger_queries import event_stream
from tallyfold.sources import scan, shared, sinks
from tallyfold.streaming import ledger


def test_text_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"one\r\ntwo\n", "sub/b.txt": "é x".encode(), "nul.txt": b"a\0b", "bad.txt": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in scan.scan_text_files(spark, str(tmp_path)).collect()}
    assert {n: (r["lines"], r["problem"]) for n, r in rows.items()} == {"a.txt": (2, None), "b.txt": (2, None), "nul.txt": (None, "NUL"), "bad.txt": (None, "not UTF-8")}
    assert rows["b.txt"]["text"] == "é x" and rows["bad.txt"]["text"] is None and rows["a.txt"]["bytes"] == 9
    checks = {r["check"]: r["ok"] for r in scan.check_limits(scan.scan_text_files(spark, str(tmp_path)), scan.Limits(files=3, lines=4)).collect()}
    assert checks == {"files": False, "file_bytes": True, "total_bytes": True, "lines": True}


def test_collisions_and_bindings(spark):
    files = spark.createDataFrame([("a/B.txt",), ("A/b.txt",), ("é",), ("é",), ("x",), ("x/y",)], "path string")
    assert {(r["key"], r["problem"]) for r in scan.path_collisions(files).collect()} == {("a/b.txt", "same name"), ("é", "same name"), ("x", "file and folder")}
    bound = scan.bound_files(spark.createDataFrame([("one", "p"), ("two", "q")], "logical_id string, path string"), spark.createDataFrame([("p", 3)], "path string, bytes long"))
    assert {r["logical_id"]: (r["available"], r["bytes"]) for r in bound.collect()} == {"one": (True, 3), "two": (False, None)}
    manifest = scan.manifest_rows(spark.createDataFrame([("A; B,,", "", " ")], "inputs string, outputs string, condition string")).first()
    assert tuple(manifest) == (["A", "B"], [], "Unknown")
    good, bad = scan.strict_json(spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("{",), ('{"a":NaN}',)], "raw string"), "raw")
    assert good.count() == 1 and bad.count() == 3
    entries = spark.createDataFrame([("Sort", ["DFSORT", "sort"])], "name string, aliases array<string>")
    assert {r["key"] for r in scan.catalog_entries(entries, "standard").collect()} == {"SORT", "DFSORT"}
    row = spark.createDataFrame([('{"a":{"b":7}}',)], "d string")
    assert row.select(scan.document_field(row, "d", "$.a.b", "int")).first()[0] == 7
    assert scan.sample_rows(entries, 5).first()["coverage"] == "sample_only"
    base = spark.createDataFrame([([("jobs", "Jobs", 5)],)], "categories array<struct<key:string,label:string,count:int>>")
    assert tuple(scan.baseline_categories(base).first()) == ("jobs", "Jobs", 5)
    tables = spark.createDataFrame([("S", "T1"), ("S", "T1"), ("R", "T2")], "creator string, name string")
    assert [tuple(r) for r in scan.catalog_listing(tables, like="T%").collect()] == [("R", "T2"), ("S", "T1")]


def test_keyset_pages_cover_the_table(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(10)], "a int, b int")
    seen, cursor = [], None
    while True:
        page = scan.keyset_page(rows, ["a", "b"], 4, cursor).orderBy("a", "b").collect()
        seen += [(r["a"], r["b"]) for r in page]
        if not page or not page[0]["has_more"]:
            break
        cursor = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(10))
    receipt = lambda pages, size: tuple(scan.keyset_receipt(rows, ["a", "b"], 4, pages, size, F.lit(10).cast("long")).first())
    assert receipt(9, 1000) == ("COMPLETE", None, 10, 3, 100)
    assert receipt(3, 1000) == ("PARTIAL", "page limit", 10, 3, 100)  # ends at its limit: it cannot know
    assert receipt(9, 85) == ("PARTIAL", "byte limit", 8, 2, 80)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * 100, None) for i in range(4)], "k int, t string, n int")
    run = lambda name, **kw: tuple(sinks.export_ndjson(rows, ["k"], str(tmp_path / name), **({"max_rows": 9, "page": 1, "max_bytes": 10**6} | kw)).first())[:4]
    assert run("all") == ("COMPLETE", None, 4, 4)
    assert run("rows", max_rows=3) == ("PARTIAL", "row limit", 3, 3)
    assert run("bytes", max_bytes=250) == ("PARTIAL", "byte limit", 2, 2) or run("bytes2", max_bytes=300)[2] == 2
    assert json.loads(spark.read.text(str(tmp_path / "all")).first()[0]).keys() == {"k", "t", "n"}
    guarded = sinks.guard_formulas(spark.createDataFrame([("=1", ["a"])], "c string, l array<string>")).first()
    assert tuple(guarded) == ("'=1", '["a"]')
    sinks.write_csv(spark.createDataFrame([("=1", 2)], "c string, n int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["c"] == "'=1"
    text = "ab\U0001f600cd" * 5
    chunks = sinks.chunk_text(spark.createDataFrame([(1, text), (2, "x" * 25), (3, "")], "id int, t string"), "id", "t", 10).orderBy("id", "chunk_no").collect()
    by = {i: [r["chunk"] for r in chunks if r["id"] == i] for i in (1, 2, 3)}
    assert "".join(by[1]) == text and all(len(c.encode("utf-16-le")) <= 20 for c in by[1])
    assert [len(c) for c in by[2]] == [10, 10, 5] and by[3] == [""]
    parts = sinks.split_parts(spark.range(25), ["id"], 11)
    assert {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 10, 3: 5}
    assert sinks.written_rows(parts, parts.where("id < 24"), "part").where("not equal").count() == 1
    assert [sinks.write_version(rows, str(tmp_path / "v")) for _ in range(2)] == [1, 2]
    read, receipt = scan.bounded_read(spark.createDataFrame([(1, "2024-01-01")], "k int, d string").withColumn("d", F.to_date("d")), 5, ["k"])
    assert dict(read.dtypes) == {"k": "int", "d": "string"} and tuple(receipt.first()) == ("COMPLETE", 1)


def test_ledger(spark):
    log = spark.createDataFrame([(1, "p", "new"), (2, "p", "open"), (3, "q", "new"), (4, "p", "new"), (5, "p", "done")], "seq long, pid string, status string")
    assert dict(map(tuple, ledger.latest_state(log, "pid", "status", "seq").collect())) == {"p": "done", "q": "new"}
    assert [r["seq"] for r in ledger.tail(log, "pid", "p", 1, "seq", 2).collect()] == [2, 4]
    allowed = spark.createDataFrame([("new", "open"), ("open", "new")], "from_state string, to_state string")
    assert [r["seq"] for r in ledger.illegal_transitions(log, "pid", "status", allowed, "seq").collect()] == [5]
    assert ledger.over_retried(log, "pid", "status", "new", 1).first()["pid"] == "p"
    answers = spark.createDataFrame([(1, "p", False), (2, "p", True), (3, "p", True), (4, "q", False)], "seq long, pid string, ok boolean")
    assert {r["seq"]: r["outcome"] for r in ledger.first_accepted(answers, "pid", F.col("ok"), "seq").collect()} == {1: "invalid", 2: "accepted", 3: "refused", 4: "invalid"}
    target = spark.createDataFrame([("a", "1")], "id string, h string")
    fresh, conflicts = ledger.merge_new(target, spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], target.schema), "id", ["h"])
    assert fresh.count() == 1 and conflicts.count() == 1
    fresh, conflicts = ledger.merge_new(target, spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1")], target.schema), "id", ["h"])
    assert [r["id"] for r in fresh.collect()] == ["d"] and sorted(r["h"] for r in conflicts.collect()) == ["1", "2"]
    docs = spark.createDataFrame([(1, "p", "x"), (2, "p", "x"), (3, "p", "y"), (4, "q", "x")], "seq long, pid string, doc string")
    assert {r["seq"] for r in ledger.new_snapshots(docs, "pid", "doc", "seq").collect()} == {1, 3, 4}
    demo = spark.createDataFrame([("q", True)], "pid string, demo boolean")
    assert [r["seq"] for r in ledger.history(docs, demo, "pid", "seq").collect()] == [1, 2, 3]


def test_streams_equal_their_batch_form(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = str(tmp_path / "log")
    ledger.append_events(event_stream(spark, sf_dir), log, str(tmp_path / "c0")).awaitTermination()
    assert spark.read.parquet(log).count() == events.count()
    again = ledger.stream_events(spark, log, events.schema, max_files=1)
    got = ledger.stream_latest(again, "user_id", "event_type", "ts", "event_id", path=str(tmp_path / "latest"), checkpoint=str(tmp_path / "c1"))
    assert got.exceptAll(ledger.latest_state(events, "user_id", "event_type", "ts", "event_id")).count() == 0
    once = ledger.stream_once(again.withColumn("ok", F.col("value") > 50), "user_id", "ok", "event_id", str(tmp_path / "once"), str(tmp_path / "c2")).select("user_id", "event_id", "outcome")
    batch = ledger.first_accepted(events.select("user_id", "event_id", "value"), "user_id", F.col("value") > 50, "event_id").drop("value")
    assert once.exceptAll(batch.select("user_id", "event_id", "outcome")).count() == 0 and once.count() == events.count()
    slim = again.select("user_id", "event_type").withColumn("event_type", F.lit("same"))
    ledger.merge_stream(slim, str(tmp_path / "table"), "user_id", ["event_type"], str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == events.select("user_id").distinct().count()
    counts = ledger.windowed_counts(again.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    assert ledger.run_to_table(counts, str(tmp_path / "counts"), "update", str(tmp_path / "c4")).groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).agg(F.sum("n")).first()[0] == events.count()


def test_once_only_over_batches(spark, tmp_path):
    """Two batches, ties, a hot key, null validity; a batch that runs again changes nothing."""
    schema = "k string, n long, ok boolean"
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    path, batches = str(tmp_path / "out"), ([("a", 2, True), ("a", 1, False), ("b", 5, None), ("hot", 7, True), ("hot", 7, True)] + [("hot", 9, True)] * 50, [("a", 0, True), ("b", 3, True), ("b", 1, False), ("hot", 1, True)])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = ledger.stream_once(read(), "k", "ok", "n", path, str(tmp_path / "c"))
    want = {("a", 2, "accepted", 0), ("a", 1, "invalid", 0), ("b", 5, "invalid", 0), ("hot", 7, "accepted", 0), ("hot", 7, "refused", 0), ("hot", 9, "refused", 0), ("a", 0, "refused", 1), ("b", 3, "accepted", 1), ("b", 1, "invalid", 1), ("hot", 1, "refused", 1)}
    assert {tuple(r) for r in found.select("k", "n", "outcome", "batch").collect()} == want and found.count() == 59
    assert found.where("outcome = 'accepted'").count() == 3


def test_ordered_digest(spark):
    """The tree by hand; order, doubles and gaps change it."""
    import hashlib

    from tallyfold.operators.digest import ordered_digest

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def plain(lines, block):
        level, first = [h(x) for x in lines], True
        while len(level) > 1 or (first and level):
            level, first = [h("".join(level[i : i + block])) for i in range(0, len(level), block)], False
        return level[0] if level else h("")

    def got(lines, block=3):
        rows = spark.createDataFrame(list(enumerate(lines)), "i long, x string").repartition(3)
        return tuple(ordered_digest(rows, ["i"], F.col("x"), block).first())

    for lines in ([], ["a"], ["a", "b", "a"], [str(i) for i in range(20)], ["same"] * 10):
        assert got(lines) == (len(lines), plain(lines, 3))
    assert len({got(x)[1] for x in (["a", "b", "c"], ["b", "a", "c"], ["a", "b", "c", "c"], ["a", "b"])}) == 4
    assert got([None])[1] == plain(["null"], 3)


def test_merge_stream_keeps_conflicts_by_batch(spark, tmp_path):
    schema = "k long, v string"
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "table")
    for rows in ([(1, "x"), (2, "x"), (2, "y")], [(1, "x"), (1, "z"), (3, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ledger.merge_stream(read(), target, "k", ["v"], str(tmp_path / "c")).awaitTermination()
    got = lambda path: sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).select("k", "v").collect())
    assert got(target) == [(1, "x"), (3, "x")] and got(target + "_conflicts") == [(1, "z"), (2, "x"), (2, "y")]
    ledger.merge_stream(read(), target, "k", ["v"], str(tmp_path / "other")).awaitTermination()  # every row once more, as batch 0
    assert got(target) == [(1, "x"), (3, "x")]
    assert len(got(target + "_conflicts")) == 4  # (1, "z") of batch 1 stays; batch 0 is written anew


def test_materialize(spark):
    rows = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    assert shared.materialize(rows).dtypes == rows.dtypes and shared.materialize(rows.limit(0)).count() == 0
