"""Queries of windows, budgets, pages and bounded reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import windows
from tallyfold.plans.registry import query, table
from tallyfold.sources import scan, sinks

LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def line_items(spark, sf_dir, *more: str):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *more)


@query("""
with d as (select distinct l_orderkey, l_linenumber as n from lineitem), i as (select *, n - row_number() over (partition by l_orderkey order by n) as g from d)
select l_orderkey, min(n) as first, max(n) as last from i group by l_orderkey, g
""")
def spans_of_numbers(spark, sf_dir):
    return windows.spans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
select event_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_error from events
""")
def context_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.carry_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "last_error").select("event_id", "last_error")


@query("""
with m as (select *, case when event_type = 'purchase' then '' when event_type = 'error' then event_id::varchar end as v from events)
select event_id, nullif(last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), '') as job from m
""")
def context_with_reset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    value, reset = F.when(F.col("event_type") == "error", F.col("event_id")), F.col("event_type") == "purchase"
    return windows.carry_forward(e, ["user_id"], ["ts", "event_id"], value, "job", reset).select("event_id", "job")


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def first_witness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return windows.first_witness(e, ["user_id", "event_type"], ["event_id"])


@query("""
with s as (select event_type, user_id, min(event_id) as event_id from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by event_id, user_id) as n from s)
select event_type, user_id, event_id from r where n <= 12
""")
def first_k_distinct_states(spark, sf_dir):
    return windows.first_k_states(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id", 12)


@query("""
with e as (select event_type as r, value > 50 as b, user_id as s, event_id as c from events),
w as (select r, b, min(c) as c from e group by 1, 2), seeds as (select distinct e.r, e.s from e join w on e.c = w.c),
st as (select r, s, min(c) as c from e group by 1, 2), fresh as (select st.* from st anti join seeds on st.r = seeds.r and st.s = seeds.s),
rk as (select *, row_number() over (partition by r order by c, s) as n from fresh), held as (select r, count(*) as h from seeds group by 1),
m as (select c from rk left join held using (r) where n + coalesce(h, 0) <= 8),
u as (select c, min(p) as p from (select c, 1 as p from w union all select c, 2 from m) group by 1)
select c as cand, p as pass from u order by p, c limit 40
""")
def select_under_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("r"), (F.col("value") > 50).alias("b"), F.col("user_id").alias("s"), F.col("event_id").alias("c"))
    return windows.select_under_budget(e, "r", "b", "s", "c", 8, 40)


@query("""
with r as (select doc_id, n_chars, sum(n_chars) over (order by doc_id rows unbounded preceding) as running from documents)
select doc_id, running::bigint as running from r where running <= 500000
""")
def prefix_budget(spark, sf_dir):
    return windows.prefix_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 500000).select("doc_id", "running")


@query("""
with a as (select l_orderkey as k, count(distinct l_linenumber) = max(l_linenumber) and min(l_linenumber) = 1 as covered, 'order' as what from lineitem group by 1),
b as (select conv_id as k, count(distinct turn) = max(turn) - min(turn) + 1 as covered, 'conversation' as what from conversations group by 1)
select * from a union all select * from b
""")
def interval_coverage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"))
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    c = c.join(first, "conv_id").select(F.col("conv_id").alias("k"), (F.col("turn") - F.col("first") + 1).alias("n"))
    top = lambda df: df.withColumn("m", F.col("n"))
    orders = windows.covers(top(l), ["k"], "n", "m", F.col("n")).withColumn("what", F.lit("order"))
    return orders.unionByName(windows.covers(top(c), ["k"], "n", "m", F.col("n")).withColumn("what", F.lit("conversation")))


@query("select n_nationkey, format('{}_R{:03d}', 'NATION', row_number() over (partition by n_regionkey order by n_nationkey)) as id from nation")
def sequential_ids(spark, sf_dir):
    return windows.numbered(table(spark, sf_dir, "nation"), "NATION", ["n_regionkey"], ["n_nationkey"]).select("n_nationkey", "id")


@query("""
select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as o_orderstatus from orders group by 1
""")
def latest_version(spark, sf_dir):
    return windows.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_orderstatus")


@query("""
with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as c from events where event_type <> 'view')
select user_id, string_agg(event_id::varchar, ',' order by event_id) filter (n <= 8) as items, bool_or(c > 8) as truncated from r group by 1
""")
def capped_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").select("user_id", "event_id")
    out = windows.capped_list(e, ["user_id"], F.col("event_id").cast("string"), ["event_id"], 8)
    return out.select("user_id", F.array_join("items", ",").alias("items"), "truncated")


@query("select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rank from lineitem")
def global_ranks(spark, sf_dir):
    return windows.global_rank(line_items(spark, sf_dir), LINE_ORDER.split(", ")).select("l_orderkey", "l_linenumber", "rank")


@query("""
with p as (select c_nationkey, c_custkey from customer where c_nationkey > 7 or (c_nationkey = 7 and c_custkey > 100) order by 1, 2 limit 101)
select c_nationkey, c_custkey, (select count(*) from p) > 100 as has_more from p order by 1, 2 limit 100
""")
def keyset_page(spark, sf_dir):
    return scan.keyset_page(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], 100, (7, 100))


@query("""
with r as (select row_number() over (order by c_nationkey, c_custkey) as n, length(c_name) + 1 as b from customer),
p as (select (n - 1) // 40 as page, count(*) as n, sum(b) as b from r group by 1), q as (select *, sum(b) over (order by page) as upto from p),
f as (select *, page < 100 and upto <= 9000 as fits from q)
select case when count(*) filter (fits) >= 100 or bool_or(upto > 9000) then 'PARTIAL' else 'COMPLETE' end as status, case when count(*) filter (fits) >= 100 then 'page limit' when bool_or(upto > 9000) then 'byte limit' end as reason,
  coalesce(sum(n) filter (fits), 0)::bigint as "rows", count(*) filter (fits) as pages, coalesce(sum(b) filter (fits), 0)::bigint as bytes from f
""")
def keyset_receipt(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return scan.keyset_receipt(rows, ["c_nationkey", "c_custkey"], 40, 100, 9000, (F.length("c_name") + 1).cast("long"))


@query("select case when count(*) >= 5000 then 'PARTIAL' else 'COMPLETE' end as status, least(count(*), 5000) as \"rows\" from orders")
def bounded_read_receipt(spark, sf_dir):
    return scan.bounded_read(table(spark, sf_dir, "orders"), 5000, ["o_orderkey"])[1]


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate from orders order by o_orderkey limit 5000")
def bounded_read(spark, sf_dir):
    return scan.bounded_read(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 5000, ["o_orderkey"])[0]


@query(f"""
with r as (select l_orderkey, l_linenumber, row_number() over (order by {LINE_ORDER}) as n from lineitem)
select ((n - 1) // 999 + 1)::int as part, count(*) as "rows", min(l_orderkey) as first_key, max(l_orderkey) as last_key from r group by 1
""")
def split_parts(spark, sf_dir):
    parts = sinks.split_parts(line_items(spark, sf_dir), LINE_ORDER.split(", "), 1000)
    return parts.groupBy("part").agg(F.count("*").alias("rows"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@query("select l_orderkey, sum(l_linenumber)::bigint as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') group by 1")
def semi_join_sums(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("n"))
