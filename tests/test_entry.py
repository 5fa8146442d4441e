import pytest

import __spark_entry__
from tallyfold import plans

DUCK = pytest.importorskip("duckdb")
SMALL = ("order_eligibility", "json_contract", "select_under_budget", "resolve_multiplicity", "unit_verification", "keyset_receipt", "gap_compaction")
LATER = (
    "cycle_components", "job_step_references", "embedded_sql_references", "program_call_references", "resource_definitions", "construct_regions", "construct_families", "member_search", "member_kinds", "resolve_by_stem", "manifest_lineage",
    "gaps_by_family", "gaps_by_program", "file_scan", "file_limits", "campaign_three_ways", "sequence_digest", "stream_latest_state", "stream_once_only", "token_family_counts",
    "describe_columns", "scenario_campaign", "scenario_duplicates", "invalid_witnesses", "denominator_checks", "validation_rollup",
)
NEW = sorted(n for n, f in plans.queries().items() if f.__module__.rpartition(".")[2] in ("check_queries", "object_queries") and n in plans.oracles())


def test_entry_counts_all_orders(spark, sf_dir):
    rows = {r["decision"]: r["orders"] for r in __spark_entry__.entry(spark).collect()}
    assert set(rows) == {"Y", "N", "R"} and sum(rows.values()) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_oracles_have_queries():
    assert set(plans.oracles()) <= set(plans.queries()) and len(plans.queries()) >= 80


@pytest.mark.parametrize("name", [*SMALL, *LATER, *NEW])
def test_query_equals_oracle(spark, sf_dir, name):
    con = DUCK.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = plans.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({plans.oracles()[name]})").fetchall()
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key)
