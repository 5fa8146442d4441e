"""Queries of the event log, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.plans.registry import query, table
from tallyfold.sources.shared import fresh_path
from tallyfold.streaming import ledger


def event_stream(spark, sf_dir):
    """The events table as a file stream (a Parquet file or a folder of such)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")


LATEST_SQL = "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1"


@query(LATEST_SQL)
def event_latest_state(spark, sf_dir):
    return ledger.latest_state(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(LATEST_SQL)
def stream_latest_state(spark, sf_dir):
    """The stream's written table, read back."""
    return ledger.stream_latest(event_stream(spark, sf_dir), "user_id", "event_type", "ts", "event_id", path=fresh_path(spark), checkpoint=fresh_path(spark))


ONCE_SQL = """
with e as (select user_id, event_id, value > 50 as ok from events), r as (select *, row_number() over (partition by user_id order by (not ok)::int, event_id) as n from e)
select user_id, event_id, case when not ok then 'invalid' when n = 1 then 'accepted' else 'refused' end as outcome from r
"""


@query(ONCE_SQL)
def once_only(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return ledger.first_accepted(e, "user_id", F.col("value") > 50, "event_id").drop("value")


@query(ONCE_SQL)
def stream_once_only(spark, sf_dir):
    """The stream's written table, read back."""
    e = event_stream(spark, sf_dir).withColumn("ok", F.col("value") > 50)
    return ledger.stream_once(e, "user_id", "ok", "event_id", fresh_path(spark), fresh_path(spark)).select("user_id", "event_id", "outcome")


@query("""
with s as (select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as from_state, event_type as to_state from events)
select from_state, to_state, count(*) as n from s where from_state is not null and not (from_state = to_state or (from_state, to_state) in (('view', 'click'), ('click', 'purchase'), ('login', 'view'))) group by all
""")
def transition_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    steps = [("view", "click"), ("click", "purchase"), ("login", "view")]
    allowed = e.select(F.col("event_type").alias("from_state"), F.col("event_type").alias("to_state")).union(spark.createDataFrame(steps, "from_state string, to_state string"))
    return ledger.illegal_transitions(e, "user_id", "event_type", allowed, "ts", "event_id").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@query("select user_id, count(*) as retries from events where event_type = 'error' group by 1 having count(*) > 3")
def retry_limits(spark, sf_dir):
    return ledger.over_retried(table(spark, sf_dir, "events"), "user_id", "event_type", "error")


@query("select event_id, event_type, value from events where user_id = 7 and event_id > 100 order by event_id limit 2000")
def event_tail(spark, sf_dir):
    return ledger.tail(table(spark, sf_dir, "events"), "user_id", 7, 100, "event_id").select("event_id", "event_type", "value")


@query("select source, sha256(text) as digest, min(doc_id) as doc_id from documents group by 1, 2")
def snapshot_if_new(spark, sf_dir):
    return ledger.new_snapshots(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


@query("""
with r as (select o_orderkey, o_custkey, o_orderkey % 4 as rev from orders), c as (select o_custkey, max(o_orderkey % 4) as latest from orders where o_orderstatus <> 'P' group by 1)
select o_orderkey, rev is not distinct from latest as accepted from r left join c using (o_custkey)
""")
def report_acceptance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 4).alias("control_revision"))
    return ledger.accept_reports(o, o.where("o_orderstatus <> 'P'"), "o_custkey").select("o_orderkey", "accepted")


@query("""
with s as (select p_partkey as id, p_name as name from part where p_partkey % 3 <> 0 union all select p_partkey, case when p_partkey % 2 = 0 then 'new ' || p_name else p_name end from part where p_partkey % 6 in (0, 3)), t as (select p_partkey as id, p_name as name from part where p_partkey % 3 = 0 or p_partkey % 5 = 0)
select 'fresh' as side, count(*) as n from (select distinct * from s) s where id not in (select id from t) union all select 'conflict', count(*) from (select distinct * from s) s join t using (id) where s.name <> t.name
""")
def idempotent_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    changed = p.where("id % 6 in (0, 3)").withColumn("name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name")))
    fresh, conflicts = ledger.merge_new(p.where("id % 3 = 0 or id % 5 = 0"), p.where("id % 3 <> 0").union(changed), "id", ["name"])
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(fresh, "fresh").union(count(conflicts, "conflict"))


@query("select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ledger.windowed_counts(e, "ts", "event_type", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
