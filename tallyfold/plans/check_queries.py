"""Queries of layout and rule checks, dispositions, review credit and case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import contract, lines, reconcile, review, rules, testdata, windows
from tallyfold.operators.contract import Field
from tallyfold.plans import rule_queries
from tallyfold.plans.registry import query, table
from tallyfold.streaming import ledger

text = lambda c: F.col(c).cast("string")


def named(letter: str, number):
    return F.concat(F.lit(letter), number.cast("string"))


@query("""
with f as (select 'P' || l_suppkey as program, 'F' || l_linenumber as field, case when l_returnflag = 'R' then 'string' else 'integer' end as type, l_quantity::int - 30 as width,
  case l_linestatus when 'F' then 'G' else ' ' end as grp, l_partkey::varchar as filled from lineitem),
v as (
  select program, field, 'width' as violation from f where not (case when type = 'integer' then width between 1 and 18 else width between 1 and 256 end)
  union all select program, field, 'group' from f where trim(grp) = ''
  union all select program, field, 'default' from f where length(filled) > width
  union all select program, field, 'duplicate name' from f group by program, field having count(*) > 1)
select violation, count(*) as n, count(distinct program) as programs from v group by 1
""")
def layout_checks(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    layout = l.select(named("P", F.col("l_suppkey")).alias("program"), named("F", F.col("l_linenumber")).alias("field"), F.when(F.col("l_returnflag") == "R", "string").otherwise("integer").alias("type"),
        (F.col("l_quantity") - 30).cast("int").alias("width"), F.when(F.col("l_linestatus") == "F", "G").otherwise(" ").alias("grp"), text("l_partkey").alias("default"))
    return contract.check_layout(layout).groupBy("violation").agg(F.count("*").alias("n"), F.count_distinct("program").alias("programs"))


@query("""
with f as (select l_suppkey as program, 'F' || l_linenumber as field, 5 + (l_suppkey % 50 = 0 and l_linenumber < 4)::int as width from lineitem where not (l_linenumber = 7 and l_suppkey % 3 = 0))
select field, count(distinct width) as shapes, count(distinct program) as programs from f group by 1
having count(distinct width) > 1 or count(distinct program) < (select count(distinct program) from f)
""")
def chained_layouts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("not (l_linenumber = 7 and l_suppkey % 3 = 0)")
    wide = ((F.col("l_suppkey") % 50 == 0) & (F.col("l_linenumber") < 4)).cast("int")
    layout = l.select(F.col("l_suppkey").alias("program"), named("F", F.col("l_linenumber")).alias("field"), F.lit("integer").alias("type"), (wide + 5).alias("width"))
    return contract.incompatible_fields(layout)


@query("""
with e as (select event_type, count(*) filter (value > 50) - count(*) filter (value <= 20) as n from events group by 1), d(event_type) as (values ('view'), ('click'), ('purchase'), ('refund'))
select event_type, 'missing' as violation from d where event_type not in (select event_type from e)
union all select event_type, 'unknown' from e where event_type not in (select event_type from d) union all select event_type, 'count' from e where n < 0
""")
def baseline_domain(spark, sf_dir):
    """Which event types a declared domain lacks or does not know."""
    n = F.count_if(F.col("value") > 50) - F.count_if(F.col("value") <= 20)
    seen = table(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("n"))
    return contract.check_domain(seen, "event_type", ["view", "click", "purchase", "refund"], "n")


@query("""
with c as (select c_nationkey, count(*) as customers, max(c_mktsegment) as segment from customer where c_nationkey <> 7 group by 1)
select n_nationkey, coalesce(customers, 0) as customers, coalesce(segment, 'NONE        ') as segment, '   ' as remark from nation left join c on n_nationkey = c_nationkey
""")
def filled_defaults(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey <> 7").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.max("c_mktsegment").alias("segment"))
    rows = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "customers", "segment")
    return contract.fill_defaults(rows, [Field("customers", "integer", 5), Field("segment", "string", 12, default="NONE"), Field("remark", "string", 3)])


@query("""
with c as (select c_custkey, length(c_mktsegment) = 9 and c_nationkey between 0 and 9 as ok from customer)
select 'accepted' as side, count(*) as n, sum(c_custkey)::bigint as keys from c where ok union all select 'rejected', count(*), sum(c_custkey)::bigint from c where not ok
""")
def accept_reject_split(spark, sf_dir):
    checked = contract.validate(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), [Field("c_mktsegment", "string", 9), Field("c_nationkey", "integer", 1)])
    count = lambda df, side: df.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit(side).alias("side"), "n", "keys")
    good, bad = contract.split_accepted(checked)
    return count(good, "accepted").union(count(bad, "rejected"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return contract.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


ATOMS_SQL = """
a as (select 'P' || (l_suppkey % 5) as program, 'R' || l_orderkey as rule_id, l_linenumber as ord, 'F' || (l_partkey % 9) as lhs, case l_returnflag when 'A' then '=' when 'N' then '>' else '<>' end as op,
  case when l_linenumber % 2 = 1 then l_quantity::int::varchar end as literal, case when l_linenumber % 2 = 0 then 'F' || (l_suppkey % 9) end as peer from lineitem)
"""


def atoms(spark, sf_dir):
    """Comparisons of a rule corpus, one for each line item."""
    n = F.col("l_linenumber")
    op = F.when(F.col("l_returnflag") == "A", "=").when(F.col("l_returnflag") == "N", ">").otherwise("<>")
    return table(spark, sf_dir, "lineitem").select(
        named("P", F.col("l_suppkey") % 5).alias("program"), named("R", F.col("l_orderkey")).alias("rule_id"), n.alias("ord"), named("F", F.col("l_partkey") % 9).alias("left"), op.alias("op"),
        F.when(n % 2 == 1, F.col("l_quantity").cast("int").cast("string")).alias("literal"), F.when(n % 2 == 0, named("F", F.col("l_suppkey") % 9)).alias("peer"),
    )


@query(f"""
with {ATOMS_SQL}, f as (select distinct 'P' || (l_suppkey % 5) as program, 'F' || (l_partkey % 8) as field, case when l_partkey % 8 < 4 then 'integer' else 'string' end as type, 1 + l_partkey % 8 % 3 as width from lineitem),
j as (select a.*, l.type as lt, l.width as lw, r.type as rt, r.width as rw from a left join f l on a.program = l.program and a.lhs = l.field left join f r on a.program = r.program and a.peer = r.field),
v as (
  select 'unknown field' as violation from j where lt is null or (peer is not null and rt is null)
  union all select 'types differ' from j where lt <> rt
  union all select 'widths differ' from j where lt = 'string' and rt = 'string' and lw <> rw
  union all select 'strings have no order' from j where lt = 'string' and op not in ('=', '<>')
  union all select 'literal too wide' from j where length(literal) > lw)
select violation, count(*) as n from v group by 1
""")
def rule_type_checks(spark, sf_dir):
    k = F.col("l_partkey") % 8
    layout = table(spark, sf_dir, "lineitem").select(named("P", F.col("l_suppkey") % 5).alias("program"), named("F", k).alias("field"), F.when(k < 4, "integer").otherwise("string").alias("type"), (k % 3 + 1).cast("int").alias("width")).distinct()
    return rules.check_rules(atoms(spark, sf_dir), layout).groupBy("violation").agg(F.count("*").alias("n"))


@query(f"""with {ATOMS_SQL} select lhs as "left", peer as "right", count(distinct (program, rule_id)) as n from a where op = '=' and peer is not null group by 1, 2""")
def rule_relationships(spark, sf_dir):
    return rules.relationships(atoms(spark, sf_dir)).groupBy("left", "right").agg(F.count("*").alias("n"))


@query(f"""
with {ATOMS_SQL}, t as (select program, rule_id, ord, lhs || case op when '=' then ' equals ' when '>' then ' is above ' else ' differs from ' end || coalesce(peer, literal) as t from a)
select program, rule_id, string_agg(t, '; ' order by ord, t) as text from t group by 1, 2
""")
def rules_in_words(spark, sf_dir):
    return rules.plain_text(atoms(spark, sf_dir))


@query("""
select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 10 = 0 then 'out_of_scope' when l_suppkey % 10 = 1 then 'blocked' when l_returnflag = 'N' and l_linestatus = 'O' then 'non_executable'
  when l_partkey % 3 = 0 and l_linenumber = 1 then 'non_executable'
  when l_partkey % 3 = 0 and l_discount > 0.05 then case when l_tax < 0.04 and l_quantity > 5 then 'mapped_verified' else 'mapped_unverified' end
  when l_partkey % 3 = 0 and l_discount < 0.02 then case when l_tax < 0.04 and l_quantity > 5 then 'platform_replaced_verified' else 'platform_replaced_unverified' end
  when l_partkey % 3 = 1 and l_linenumber > 2 then case when l_tax < 0.02 and l_quantity > 5 then 'mapped_verified' else 'mapped_unverified' end
  when l_partkey % 3 = 1 and l_linenumber = 2 then 'non_executable'
  when l_partkey % 3 = 2 and l_linenumber = 3 then case when l_tax < 0.04 and l_quantity > 5 then 'mapped_verified' else 'mapped_unverified' end
  when l_partkey % 3 = 2 and l_linenumber = 4 then case when l_tax < 0.04 and l_quantity > 5 then 'platform_replaced_verified' else 'platform_replaced_unverified' end
  else 'blocked' end as disposition from lineitem
""")
def line_dispositions(spark, sf_dir):
    """Every line item as a source line, through the disposition table."""
    classes = F.when(F.expr("l_returnflag = 'N' and l_linestatus = 'O'"), "comment").otherwise(F.get(F.array(*[F.lit(c) for c in ("code", "structure", "group", "exec", "card", "code", "code", "code")]), F.col("l_linenumber")))
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "selected": F.expr("l_suppkey % 10 <> 0"), "hash_ok": F.expr("l_suppkey % 10 <> 1"), "kind": F.get(F.array(F.lit("program"), F.lit("copybook"), F.lit("job")), (F.col("l_partkey") % 3).cast("int")), "line_class": classes,
        "modeled": F.expr("l_discount > 0.05"), "terminal": F.expr("l_discount < 0.02"), "users_verified": F.expr("case when l_linenumber > 2 then l_tax < 0.02 end"), "verified": F.expr("l_tax < 0.04"), "integrity_ok": F.expr("l_quantity > 5"),
    })
    return reconcile.dispose(rows).select("l_orderkey", "l_linenumber", "l_partkey", "disposition")


@query("""
with m as (select l_orderkey, l_linenumber, l_quantity, count(*) over () as matching from lineitem where l_returnflag = 'R' and l_linestatus = 'F')
select * from m order by l_orderkey, l_linenumber, l_quantity limit 250
""")
def coverage_page(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return reconcile.coverage_page(rows, ["l_orderkey", "l_linenumber", "l_quantity"], l_returnflag="R", l_linestatus="F").drop("l_returnflag", "l_linestatus")


@query("""
with p as (select l_orderkey, list(l_partkey order by l_partkey) as parts from lineitem group by 1)
select l_orderkey, array_to_string(parts[1:3], ',') as parts, len(parts)::int as parts_total, len(parts) > 3 as parts_cut from p
""")
def slim_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return reconcile.slim(rows, ["parts"], 3).withColumn("parts", F.array_join("parts", ","))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no, len(string_split(text, chr(10))) as n from documents)
select doc_id, min(line_no)::int as first_line, max(line_no)::int as last_line, substr(string_agg(line, chr(10) order by line_no), 1, 500) as text from l
where not (line_no = n and line = '') and line_no between 2 + doc_id % 3 and 5 + doc_id % 7 and line_no <= 2 + doc_id % 3 + 2 group by 1
""")
def line_excerpts(spark, sf_dir):
    """A few lines out of every document, from where its id says."""
    rows = lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return lines.excerpt(rows, "doc_id", F.col("doc_id") % 3 + 2, F.col("doc_id") % 7 + 5, 3, 500)


@query("""
with l as (select distinct l_orderkey, l_linenumber from lineitem), d as (select distinct l_orderkey, l_linenumber from lineitem where l_quantity <= 45)
select l_orderkey, l_linenumber from l except select l_orderkey, l_linenumber from d
""")
def unaccounted_lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.unaccounted(l.select("l_orderkey", "l_linenumber").distinct(), l.where("l_quantity <= 45"), ["l_orderkey", "l_linenumber"])


@query("""
with e as (select user_id, event_id, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as r from events),
w as (select *, max(r) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as h from e where r is not null)
select user_id, event_id as line_no, r as rank, h as highest from w where r <= h
""")
def sections_out_of_order(spark, sf_dir):
    """Events that come no later in the usual order than one that the user already had."""
    rank = F.expr("case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end")
    return lines.out_of_order(table(spark, sf_dir, "events").withColumn("line_no", F.col("event_id")), "user_id", "line_no", rank)


@query("""
with p as (select source, count(*) % 2 = 0 as verified, count(*) filter (n_chars < 30) as differences from documents group by 1)
select count(*) as rules, count(*) filter (quality = 1 and toxic = 0 and verified and differences = 0) as credited from documents d left join labels using (doc_id) left join p on d.source = p.source
""")
def rule_credit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    programs = d.groupBy(F.col("source").alias("program")).agg((F.count("*") % 2 == 0).alias("verified"), F.count_if(F.col("n_chars") < 30).alias("differences"))
    return review.rule_credit(d.select(F.col("doc_id").alias("id"), F.col("source").alias("program")), answers(spark, sf_dir), programs)


def answers(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("answer"), F.when(F.col("toxic") == 1, "see note").alias("correction"))


@query("""
with y as (select sha256(source || ':' || doc_id) as key, doc_id, lang from documents join labels using (doc_id) where quality = 1 and toxic = 0),
k as (select sha256(source || ':' || doc_id) as key, case when doc_id % 5 = 0 then 'x' else lang end as text from documents where doc_id % 3 = 0)
select 'new' as side, y.key, lang as text from y anti join k using (key) union all select 'conflict', y.key, lang from y join k using (key) where lang <> k.text
""")
def confirmed_knowledge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.where("doc_id % 3 = 0").select(F.sha2(F.concat_ws(":", "source", "doc_id"), 256).alias("key"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("lang")).alias("text"))
    fresh, conflicts = review.confirmed_knowledge(d.select(F.col("doc_id").alias("id"), F.col("source").alias("program"), F.col("lang").alias("text")), answers(spark, sf_dir), known)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "key", "text")
    return side(fresh, "new").unionByName(side(conflicts, "conflict"))


@query("""
with v as (select 'repeated id' as violation from orders group by o_custkey having count(*) > 1 union all select 'too many items' from (select count(*) as n from orders) where n > 2000)
select violation, count(*) as n from v group by 1
""")
def item_checks(spark, sf_dir):
    rows = review.items(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("Right?").alias("question"), F.col("o_orderstatus").alias("evidence"), F.lit("order").alias("kind")))
    return review.check_items(rows).groupBy("violation").agg(F.count("*").alias("n"))


@query("select doc_id, source from documents where source is distinct from 'src0'")
def accepted_history(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ledger.history(d, d.select("source", (F.col("source") == "src0").alias("demo")).distinct(), "source", "doc_id")


@query("""select user_id || event_type as fp, bool_or(value > 95) as mandatory, arg_min(props, event_id) as reason, min(event_id) as event_id from events group by 1""")
def case_deduplication(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(text("user_id"), "event_type").alias("fp"), (F.col("value") > 95).alias("mandatory"), F.col("props").alias("reason"), "event_id")
    return testdata.deduplicated(rows, "fp", "mandatory", "reason", "event_id")


@query("""
with s as (select user_id, count(distinct (event_type, floor(value / 10))) as available, count(distinct event_type) as domain from events group by 1), c as (select *, least(available, 15 + user_id % 5) as chosen from s)
select user_id, available, chosen, case when chosen >= 17 then null when domain + 13 < 17 then 'limited domain' when available >= 17 then 'budget exhausted' else 'generation exhausted' end as shortfall from c
""")
def state_shortfall(spark, sf_dir):
    """Distinct input states by user, and why fewer than 17 are chosen."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.struct("event_type", F.floor(F.col("value") / 10))).alias("available"), F.count_distinct("event_type").alias("domain"))
    s = s.withColumn("chosen", F.least(F.col("available"), F.col("user_id") % 5 + 15))
    return s.select("user_id", "available", "chosen", testdata.shortfall(F.col("available"), F.col("chosen"), F.col("domain") + 13, 17).alias("shortfall"))


@query("""
select o_orderpriority as "left", l_returnflag as "right", count(*) filter (o_orderstatus = l_linestatus) as matches, count(*) filter (o_orderstatus <> l_linestatus) as mismatches,
  count(*) filter (o_orderstatus = l_linestatus) = 0 or count(*) filter (o_orderstatus <> l_linestatus) = 0 as gap from orders join lineitem on o_orderkey = l_orderkey group by 1, 2
""")
def relationship_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = o.select(F.col("o_orderpriority").alias("left"), F.col("l_returnflag").alias("right"), F.when(F.col("o_orderstatus") == F.col("l_linestatus"), "MATCH").otherwise("INTENTIONAL_MISMATCH").alias("label"))
    return reconcile.label_gaps(rows, "left", "right")


@query("""
with n as (select c_nationkey, count(*) as n, avg(c_acctbal) < 4500 as low, count(distinct c_mktsegment) < 5 as narrow from customer group by 1)
select c_nationkey, array_to_string(list_filter([case when n < 60 then 'find more' end, case when low then 'raise balances' end, case when narrow then 'widen segments' end, 'report'], lambda x: x is not null)[1:2], ';') as actions from n
""")
def next_actions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), (F.avg("c_acctbal") < 4500).alias("low"), (F.count_distinct("c_mktsegment") < 5).alias("narrow"))
    conditions = [(F.col("n") < 60, "find more"), (F.col("low"), "raise balances"), (F.col("narrow"), "widen segments"), (F.lit(True), "report")]
    return reconcile.actions(rows, conditions, 2).select("c_nationkey", F.array_join("actions", ";").alias("actions"))


@query("""select case when bool_or(event_type = 'error') then 'BLOCKED' when count(*) > 0 then 'PARTIAL' else 'COMPLETE' end as status, count(*) as gaps from events where value > 90""")
def overall_status(spark, sf_dir):
    return reconcile.overall_status(table(spark, sf_dir, "events").where("value > 90").select(F.col("event_type").alias("status")), ["error"])


@query("""
with e as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 1), a as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 2),
j as (select e.o_orderkey as k, a.o_orderkey as m, e.o_orderstatus is not distinct from a.o_orderstatus as same from e full join a on e.o_orderkey = a.o_orderkey)
select count(*) filter (k is not null and m is not null and same) as matched, count(*) filter (k is not null and m is not null and not same) as mismatched, count(*) filter (m is null) as left_only, count(*) filter (k is null) as right_only, 'MISMATCH' as status from j
""")
def comparison_verdict(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    actual = o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return reconcile.verdict(reconcile.compare(o.where("o_orderkey % 10 <> 1"), actual, ["o_orderkey"]), 0)


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as n from events) select user_id, event_id from r where n <= 3""")
def first_k_by_key(spark, sf_dir):
    return windows.first_k(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 3).select("user_id", "event_id")


@query("""
with k as (select l_returnflag, l_orderkey as a, case when ('0x' || substr(md5(concat_ws(':', 0, l_orderkey, l_partkey)), 1, 15))::bigint % 9 = 0 then l_orderkey + 1 else l_orderkey end as b from lineitem)
select l_returnflag, case when a = b then 'MATCH' else 'INTENTIONAL_MISMATCH' end as label, count(*) as n from k group by 1, 2
""")
def correlated_keys(spark, sf_dir):
    """Line items whose order and part keys are made equal, but deliberately unequal in one of nine or so."""
    rows = testdata.correlated(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), "l_orderkey", "l_partkey", 9)
    return rows.groupBy("l_returnflag", "label").agg(F.count("*").alias("n"))


@query("""
with l as (select p_brand as field, 10 ** length(max(p_size)::varchar)::int - 1 as top from part group by 1),
v as (select field, top::bigint as top, unnest(range(8)) as i from l)
select distinct field, value from (select field, top, i as value from v union all select field, top, ('0x' || substr(md5(concat_ws(':', 0, field, i)), 1, 15))::bigint % (top + 1) from v union all select field, top, top from v) where value <= top
""")
def field_domains(spark, sf_dir):
    """Values to try for each part brand as a field as wide as its largest size."""
    layout = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("field")).agg(F.length(F.max("p_size").cast("string")).alias("width")).withColumn("type", F.lit("integer"))
    return testdata.domain_values(layout, 4)


@query(f"""
{rule_queries.CASES_SQL.replace("cases as", "every as")}, cases as (select p, min(i) as i from every group by 1), {rule_queries.SCENARIOS_SQL}
select p as program_index, i as case_index, label, raw from s
""")
def scenario_replay(spark, sf_dir):
    """Scenarios of the campaign made again from their numbers alone: the least case of every program."""
    least = rule_queries.scenario_cases(spark, sf_dir).groupBy("program_index").agg(F.min("case_index").alias("case_index"))
    return testdata.scenarios(least, rule_queries.SEED).select("program_index", "case_index", "label", "raw")
