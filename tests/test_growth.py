"""Queries against their SQL where the smallest tables alone would not tell, and steps that must not grow faster than their input."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyfold import plans
from tallyfold.operators import digest, windows
from tallyfold.plans import reconcile_queries
from tallyfold.sources import shared

DUCK = pytest.importorskip("duckdb")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def compared(spark, sf_dir, name, sql=None):
    con = DUCK.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = plans.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql or plans.oracles()[name]})").fetchall()
    key = lambda row: tuple(str(v) for v in row)
    return sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want, key=key)


def test_all_quantifier_equals_its_sql(spark, sf_dir):
    got, want = compared(spark, sf_dir, "all_quantifier")
    assert got == want and len(got) == 10


def test_sequence_digest_joins_all_blocks_of_its_third_level(spark, sf_dir, monkeypatch):
    """Blocks of four lines make the smallest table as deep as blocks of 256 make one of more than 16.7 million lines."""
    monkeypatch.setattr(reconcile_queries, "DIGEST_BLOCK", 4)
    got, want = compared(spark, sf_dir, "sequence_digest", plans.oracles()["sequence_digest"].replace("// 256", "// 4"))
    assert got == want and want[0][1] > 4**3


def test_sequence_digest_shuffles_and_writes_no_hash_of_a_line(spark, sf_dir, monkeypatch):
    """One table has a row for each line, and only the columns that lines are made of; a hash is longer than all of them."""
    written = []

    def kept(df):
        written.append((sorted(df.columns), shared.materialize(df)))
        return written[-1][1]

    monkeypatch.setattr(windows, "materialize", kept)
    monkeypatch.setattr(digest, "materialize", kept)
    n = plans.queries()["sequence_digest"](spark, sf_dir).first()["n"]
    assert [columns for columns, table in written if table.count() > n // 200] == [["_part", "_row", "_run", "l_linenumber", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"]]


def test_ranks_take_one_shuffle(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), (F.col("id") % 5).alias("x"))
    ranked = windows.global_rank(rows, [F.asc_nulls_last("x"), F.desc("h")], "rank")
    assert exchanges(ranked) == 1  # of each partition's one row; rows are range-partitioned and written
    assert [r["rank"] for r in ranked.orderBy("x", F.desc("h")).collect()] == list(range(1, 1001))


def test_pieces_of_blocks_in_any_order(spark):
    """Rows by place leave a hash for each block; rows in another order, batches and tasks that end inside a block only leave more pieces."""
    n, block, batch = 50, 4, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hashes = [h(str(i)) for i in range(n)]
    want = {b: h("".join(hashes[b * block : (b + 1) * block])) for b in range(13)}
    level = spark.range(n).select(F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    try:
        for order, parts, most in (("place", 1, 13), ("place", 3, 15), (F.desc("place"), 1, n), (F.xxhash64("place"), 2, n)):
            found = digest.pieces(level.repartitionByRange(parts, order).sortWithinPartitions(order), block).orderBy("place").collect()
            assert 13 <= len(found) <= most and sum(r["n"] for r in found) == n
            for b, whole in want.items():
                own = [r for r in found if r["_block"] == b]
                assert (own[0]["text"] if own[0]["n"] == block else h("".join(r["text"] for r in own))) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("kept", ["true", "l_orderkey < 60", "l_orderkey < 1", "false"])
def test_sequence_digest_orders_nulls_and_doubles_as_its_sql(spark, sf_dir, tmp_path, kept):
    gone = lambda c, k: f"case when l_extendedprice::bigint % {k} > 0 then {c} end as {c}"
    odd = ", ".join([*(gone(c, k) for c, k in (("l_orderkey", 5), ("l_linenumber", 3), ("l_partkey", 2), ("l_suppkey", 2))), "case l_returnflag when 'N' then null when 'R' then '' else l_returnflag end as l_returnflag"])
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    DUCK.connect().sql(f"copy (select {odd} from '{sf_dir}/lineitem.parquet', range(2) where {kept}) to '{tmp_path}/lineitem.parquet' (format parquet)")
    got, want = compared(spark, tmp_path, "sequence_digest")
    assert got == want and (want[0][0] is None) == (kept == "false")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_job_references_place_lines_once(spark, sf_dir):
    assert exchanges(plans.queries()["job_step_references"](spark, sf_dir)) == 1


def test_equal_members_are_scanned_once(spark, sf_dir):
    plan = plans.queries()["construct_regions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan[plan.index("ArrowEvalPython") :]  # below the scan


def test_spans_take_one_sort_and_keep_no_groups(spark, sf_dir):
    from tallyfold.operators import reconcile, windows

    rows = spark.createDataFrame([("a", "x", n) for n in (5, 1, 2, 2, 3, 7, 7, 8)] + [("a", "y", 4), ("a", "z", None), ("a", "z", None), ("b", None, None), ("b", None, 2), ("b", None, 9)], "f string, p string, n int")
    assert sorted(map(tuple, windows.spans(rows.where("p is not null"), ["f", "p"], "n").collect()), key=str) == sorted([("a", "x", 1, 3), ("a", "x", 5, 5), ("a", "x", 7, 8), ("a", "y", 4, 4), ("a", "z", None, None)], key=str)
    found = {(r["f"], r["p"]): (r["spans"], r["n"]) for r in reconcile.gap_spans(rows, "f", "p", "n").collect()}
    assert found == {("a", "x"): ("1-3,5-5,7-8", 6), ("a", "y"): ("4-4", 1), ("a", "z"): ("", None), ("b", None): ("2-2,9-9", 2)}
    plan = plans.queries()["gap_compaction"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Aggregate(" in line for line in plan) == 2 and sum(" Sort [" in line for line in plan) == 1  # the aggregate that makes rows distinct


def test_invalid_witnesses_are_validated_after_repeats_are_gone(spark, sf_dir):
    plan = plans.queries()["invalid_witnesses"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "case#" in below and "input_status" not in below
