"""Queries of contracts and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import contract, rules, testdata
from tallyfold.operators.contract import Field
from tallyfold.operators.rules import Atom, Rule, Step
from tallyfold.plans.registry import query, spread, table

ELIGIBILITY = [
    Rule("R001", ((Atom("c_acctbal", ">=", 1000),),), (("decision", "Y"),), (("decision", "N"),)),
    Rule("R002", ((Atom("o_orderstatus", "=", "P"),),), (("decision", "N"),)),
    Rule("R003", ((Atom("c_nationkey", ">", 20),),), (("decision", "N"),)),
    Rule("R004", ((Atom("o_totalprice", ">", 200000),),), (("decision", "R"),)),
]


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(orders_with_customers(spark, sf_dir).withColumn("decision", F.lit(" ")), ELIGIBILITY, {"decision": 1, "o_orderstatus": 1})


@query("""
select case when o_totalprice > 200000 then 'R' when c_nationkey > 20 then 'N' when o_orderstatus = 'P' then 'N' when c_acctbal >= 1000 then 'Y' else 'N' end as decision,
  count(*) as orders from orders join customer on o_custkey = c_custkey group by 1
""")
def order_eligibility(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("orders"))


@query("""
with j as (select c_acctbal >= 1000 as r1, o_orderstatus = 'P' as r2, c_nationkey > 20 as r3, o_totalprice > 200000 as r4 from orders join customer on o_custkey = c_custkey),
t as (select 'R001' as rule_id, r1 as branch from j union all select 'R002', r2 from j union all select 'R003', r3 from j union all select 'R004', r4 from j),
d as (select rule_id, branch from (values ('R001'), ('R002'), ('R003'), ('R004')) r(rule_id), (values (true), (false)) b(branch))
select d.rule_id, d.branch, count(t.rule_id) as n from d left join t on d.rule_id = t.rule_id and d.branch = t.branch group by all
""")
def rule_branch_counts(spark, sf_dir):
    return rules.branch_outcomes(decided(spark, sf_dir), ELIGIBILITY)


FEEDBACK = [
    Rule("F1", ((Atom("l_quantity", ">", 30),),), (("flag", "H"),), (("flag", "L"),)),
    Rule("F2", ((Atom("flag", "=", "H"), Atom("l_returnflag", "=", "R")),), (("tier", 3),), (("tier", 1),)),
    Rule("F3", ((Atom("tier", "=", 3),), (Atom("l_linestatus", "=", "O"), Atom("flag", "=", "L"))), (("flag", "X"),)),
]


@query("""
with a as (select *, case when l_quantity > 30 then 'H' else 'L' end as f from lineitem),
b as (select *, case when f = 'H' and l_returnflag = 'R' then 3 else 1 end as tier from a),
c as (select tier, case when tier = 3 or (l_linestatus = 'O' and f = 'L') then 'X' else f end as flag from b)
select flag, tier, count(*) as n from c group by all
""")
def rule_feedback_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus").withColumns({"flag": F.lit(" "), "tier": F.lit(0)})
    return rules.apply_rules(rows, FEEDBACK, {"flag": 1}).groupBy("flag", "tier").agg(F.count("*").alias("n"))


@query("""
with a as (select o_orderkey, o_totalprice < 300000 as ok, case when o_totalprice > 100000 then 'B' else 'S' end as size from orders)
select case when ok then 'ACCEPT_INPUT,ACCEPT_INPUT,SKIPPED,ACCEPT_INPUT' else 'REJECT_INPUT,NOT_RUN,NOT_RUN,NOT_RUN' end as statuses,
  case when not ok then '?' when size = 'B' then 'Z' else 'S' end as size, count(*) as n from a group by all
""")
def step_chain_rc(spark, sf_dir):
    sized = Rule("S1", ((Atom("o_totalprice", ">", 100000),),), (("size", "B"),), (("size", "S"),))
    last = Rule("S2", ((Atom("size", "=", "B"),),), (("size", "Z"),))
    never = Rule("S3", ((Atom("o_totalprice", ">", 0),),), (("size", "?"),))
    steps = [Step("FIRST", (sized,)), Step("SECOND", (), "RC = 0"), Step("THIRD", (never,), "RC>4"), Step("LAST", (last,), "rc <= 0")]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").withColumn("size", F.lit("?"))
    out = rules.run_steps(rows, steps, F.col("o_totalprice") < 300000, {"size": 1})
    return out.select(F.array_join(F.transform("steps", lambda s: s["status"]), ",").alias("statuses"), "size").groupBy("statuses", "size").agg(F.count("*").alias("n"))


CUSTOMER = [Field("c_custkey", "integer", 3), Field("c_mktsegment", "string", 9), Field("c_nationkey", "integer", 1), Field("c_name", "string", 18)]


@query("""
with e as (
  select unnest([case when not (c_custkey between 0 and 999) then 'c_custkey: invalid unsigned integer' end,
    case when length(c_mktsegment) <> 9 then 'c_mktsegment: invalid fixed-width string' end,
    case when length(c_name) <> 18 then 'c_name: invalid fixed-width string' end,
    case when not (c_nationkey between 0 and 9) then 'c_nationkey: invalid unsigned integer' end]) as violation from customer)
select violation, count(*) as n from e where violation is not null group by 1
""")
def contract_violations(spark, sf_dir):
    checked = contract.validate(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), CUSTOMER)
    return checked.select(F.explode("errors").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("""
with r as (
  select event_id, case event_id % 7 when 1 then replace(props, '}', ', "x": 1}') when 2 then replace(props, ':', ': 0.5 , "y":') when 3 then '[' || props || ']' else props end as raw from events),
t as (select event_id, raw, json_type(raw) as kind, json_type(raw, '$.k') as k, json_keys(raw) as keys, try_cast(json_extract_string(raw, '$.k') as double) as v from r)
select case when kind = 'OBJECT' and keys = ['k'] and k in ('UBIGINT', 'BIGINT') and v between 0 and 99 then 'ACCEPT_INPUT' else 'REJECT_INPUT' end as input_status,
  case when kind <> 'OBJECT' then 'record must be an object' else concat_ws('; ', case when keys <> ['k'] then 'field set differs from source layout' end,
    case when not (k in ('UBIGINT', 'BIGINT') and v between 0 and 99) then 'k: invalid unsigned integer' end) end as errors, count(*) as n
from t group by all
""")
def json_contract(spark, sf_dir):
    m = F.col("event_id") % 7
    raw = F.when(m == 1, F.replace("props", F.lit("}"), F.lit(', "x": 1}'))).when(m == 2, F.replace("props", F.lit(":"), F.lit(': 0.5 , "y":'))).when(m == 3, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    checked = contract.validate_json(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", [Field("k", "integer", 2)])
    return checked.groupBy("input_status", F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n"))


@query("select o_orderkey as order_key, o_orderstatus as order_status, c_custkey as customer_key, c_nationkey as customer_nation from orders join customer on o_custkey = c_custkey")
def group_projection(spark, sf_dir):
    layout = [Field("o_orderkey", "integer", 9, "ORDER"), Field("o_orderstatus", "string", 1, "ORDER"), Field("c_custkey", "integer", 9, "CUSTOMER"), Field("c_nationkey", "integer", 2, "CUSTOMER")]
    groups = contract.project_groups(layout)
    rows = orders_with_customers(spark, sf_dir).select(groups["ORDER"], groups["CUSTOMER"])
    return rows.select(F.col("ORDER.o_orderkey").alias("order_key"), F.col("ORDER.o_orderstatus").alias("order_status"), F.col("CUSTOMER.c_custkey").alias("customer_key"), F.col("CUSTOMER.c_nationkey").alias("customer_nation"))


@query("""
with c(f, bad) as (values ('o_orderkey', 'null'), ('o_orderkey', 'boolean'), ('o_orderkey', 'negative'), ('o_orderkey', 'overflow'), ('o_orderkey', 'text'), ('o_orderkey', 'fraction'), ('o_orderkey', 'missing'),
  ('o_orderstatus', 'null'), ('o_orderstatus', 'boolean'), ('o_orderstatus', 'short'), ('o_orderstatus', 'long'), ('o_orderstatus', 'number'), ('o_orderstatus', 'missing'), ('extra', 'field'), ('no', 'object'), ('no', 'JSON')),
e as (select f || ' ' || bad as "case", case when f = 'no' then 'record must be an object' when f = 'extra' then 'field set differs from source layout'
  else case when bad = 'missing' then 'field set differs from source layout; ' else '' end || f || case f when 'o_orderkey' then ': invalid unsigned integer' else ': invalid fixed-width string' end end as errors from c)
select "case", 'REJECT_INPUT' as input_status, errors, count(*) as n, count(distinct case when "case" like 'no %' then '' when starts_with("case", 'o_orderkey') then o_orderstatus else o_orderkey::varchar || case when starts_with("case", 'o_orderstatus') then '' else o_orderstatus end end) as inputs
from e, orders group by 1, 2, 3
""")
def invalid_witnesses(spark, sf_dir):
    """Every order's record broken in each way that the layout forbids: the contract's answers, and how many different inputs were made."""
    layout = [Field("o_orderkey", "integer", 9), Field("o_orderstatus", "string", 1)]
    made = testdata.invalid_witnesses(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")), layout, [])
    inputs = made.groupBy("case", "raw").agg(F.count("*").alias("n"))  # the contract's answer depends on the input alone
    checked = contract.validate_json(inputs, "raw", layout)
    return checked.groupBy("case", "input_status", F.array_join("errors", "; ").alias("errors")).agg(F.sum("n").alias("n"), F.count("*").alias("inputs"))


@query("""
with m as (select l_orderkey as p, 'J' || (l_suppkey % 3) as job, l_linenumber as jo, l_returnflag as step, l_linenumber as so from lineitem),
v as (
  select 'job has several orders' as violation from m group by p, job having count(distinct jo) > 1
  union all select 'order shared by jobs' from m group by p, jo having count(distinct job) > 1
  union all select 'duplicate step order' from m group by p, job, so having count(*) > 1
  union all select 'duplicate step name' from m group by p, job, step having count(*) > 1)
select violation, count(*) as n from v group by 1
""")
def manifest_violations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    manifest = l.select(F.col("l_orderkey").alias("process_id"), F.concat(F.lit("J"), (F.col("l_suppkey") % 3).cast("string")).alias("job"), F.col("l_linenumber").alias("job_order"), F.col("l_returnflag").alias("step"), F.col("l_linenumber").alias("step_order"))
    return contract.check_manifest(manifest).groupBy("violation").agg(F.count("*").alias("n"))


@query("""
with e as (select n_name as name, unnest(list_distinct([upper(n_name), upper(substr(n_name, 1, 2))])) as alias from nation
  union all select r_name, unnest(list_distinct([upper(r_name), upper(substr(r_name, 1, 2))])) from region)
select alias, string_agg(distinct name, ',' order by name) as names from e group by alias having count(distinct name) > 1
""")
def alias_collisions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name"))
    catalog = n.withColumn("aliases", F.array(F.substring("name", 1, 2)))
    return contract.check_aliases(catalog).select("alias", F.array_join("names", ",").alias("names"))


@query("""select digest, variants from (select sha256(text) as digest, count(distinct doc_id) as variants from documents group by 1) where variants > 1""")
def identity_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return contract.identity_conflicts(rows, "digest", ["doc_id"])


def drawn_sql(*parts: object) -> str:
    """The SQL of ``testdata.seeded``."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 15))::bigint"


def relation_sql(left: str, right: str) -> str:
    return "case op " + " ".join(f"when '{o}' then {left} {o} {right}" for o in testdata.OPERATORS) + " end"


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::bigint" for v in values) + "]"


SEED = 20261003
CASES_SQL = f"""
with h as (select {drawn_sql(0, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")} % 1099511627776 as h from lineitem),
cases as (select h % 200 as p, h // 200 as i from h)"""
#: Scenarios of ``cases`` written down from their definition: ``s`` has p, i, family, label, raw and the values.
SCENARIOS_SQL = f"""
s1 as (select *, p % 20 as v, {listed(testdata.FAMILIES)}[p // 20 + 1] as family, {listed(testdata.OPERATORS)}[p % 20 % 6 + 1] as op, {listed([10**w - 1 for w in (3, 4, 6, 9, 18)])}[p % 20 % 5 + 1] as m, 2 + p % 20 % 4 as w from cases),
s2 as (select *, ([0, 1, m // 2, m - 1, m]::bigint[])[v // 4 % 5 + 1] as t from s1),
s3 as (select *, case when t = m then 0 else t + 1 end as n, case when i % 8 < 4 then ([0, 1, m - 1, m, t, greatest(0, t - 1), least(m, t + 1)]::bigint[])[i // 8 % 7 + 1] else {drawn_sql(SEED, "p", "i", 1)} % (m + 1) end as a,
  translate(substr(md5(concat_ws(':', {SEED}, p, i, 3)), 1, w), '0123456789abcdef', ' Aaz09* Aaz09*> ') as ta,
  translate(substr(md5(concat_ws(':', {SEED}, p, i, 4)), 1, w), '0123456789abcdef', ' Aaz09* Aaz09*> ') as other from s2),
s4 as (select *, case i % 4 when 0 then a when 1 then greatest(0, a - 1) when 2 then least(m, a + 1) else {drawn_sql(SEED, "p", "i", 2)} % (m + 1) end as b, case when i % 3 = 0 then ta else other end as tb, [' ', 'T', 'F', 'Y', 'N'][i % 5 + 1] as flag,
  case when i % 10 >= 8 then {listed(testdata.INVALID)}[{drawn_sql(SEED, "p", "i", 5)} % 10 + 1] else ['valid_equal_peer', 'valid_lower_peer', 'valid_upper_peer', 'valid_independent_peer'][i % 4 + 1] end as label from s3),
s as (select *, '{{' || case when label = 'missing_numeric_field' then '' else '"A":' || case when label in ('negative_numeric', 'multiple_layout_errors') then '-1' when label = 'boolean_numeric' then 'true' else a::varchar end || ',' end
  || '"B":' || case when label = 'numeric_overflow' then (m + 1)::varchar when label = 'fractional_type_numeric' then b || '.5' else b::varchar end || ',"FLAG":"' || flag || '","TEXT-A":'
  || case when label = 'null_character' then 'null' when label = 'short_character' then '"' || substr(ta, 2) || '"' else '"' || ta || '"' end || ',"TEXT-B":'
  || case when label = 'multiple_layout_errors' then '[]' when label = 'long_character' then '"' || tb || 'X"' else '"' || tb || '"' end || case when label = 'extra_field' then ',"EXTRA":1' else '' end || '}}' as raw from s4)"""
#: What the programs must do with the scenarios, by family: ``x`` has the branches and the final flag.
OUTCOMES_SQL = f"""
x1 as (select *, starts_with(label, 'valid_') as good, case family when 'literal_threshold' then {relation_sql("a", "t")} when 'ordered_overwrite' then ({relation_sql("a", "t")}) and ta <> tb
  when 'and_correlation' then ({relation_sql("a", "t")}) and b >= a when 'or_and_precedence' then ({relation_sql("a", "t")}) or (b = a and ta = tb) when 'character_peer' then (ta = tb) = (v % 2 = 0)
  when 'two_group_join' then ({relation_sql("a", "b")}) and ta = tb when 'reversed_literal' then {relation_sql("t", "a")} else {relation_sql("a", "b")} end as one from s),
x2 as (select *, case when family = 'write_then_compare' then case when one then n else t end else a end as a2, family = 'three_rule_feedback' and one and ta = tb as fed from x1),
x3 as (select *, case when family = 'write_then_compare' then a2 = n when family = 'three_rule_feedback' then fed end as two, case when family = 'three_rule_feedback' then case when fed then n else t end else b end as b2 from x2),
x4 as (select *, case when family = 'three_rule_feedback' then b2 = n or a = b2 end as three from x3),
x as (select *, case when three is not null then case when three then 'Y' else 'N' end when coalesce(two, one) then 'T' else 'F' end as final from x4)"""


def scenario_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario for each line item: its numbers choose the program and the case."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    h = testdata.seeded(0, *[F.col(c) for c in l.columns]).bitwiseAND(F.lit((1 << 40) - 1))
    return spread(l.select(h.alias("h"))).select(F.pmod("h", F.lit(testdata.PROGRAMS)).alias("program_index"), F.floor(F.col("h") / testdata.PROGRAMS).alias("case_index"))


@query(f"""
{CASES_SQL}, {SCENARIOS_SQL}, {OUTCOMES_SQL}
select family, count(*) as scenarios, count(*) filter (good) as valid, 0::bigint as divergences, count(*) filter (good and final in ('T', 'Y')) as flagged,
  coalesce(sum(one::int + coalesce(two, false)::int + coalesce(three, false)::int) filter (good), 0)::bigint as taken, sum({drawn_sql(0, "p", "raw")})::varchar as digest from x group by 1
""")
def scenario_campaign(spark, sf_dir):
    """Scenarios through the JSON contract and the rule table, against what their label and family say; no divergence is right.

    Besides, of the accepted ones by the rule table: how many end with a flag of T or Y, and how many branches are taken.
    """
    rows = testdata.expected(testdata.scenarios(scenario_cases(spark, sf_dir), SEED))
    done = rules.run_rule_table(rules.checked_by_columns(rows), rules.rule_table(spark, {i: testdata.program_rules(i)[1] for i in range(testdata.PROGRAMS)}))
    e, accepted, flag = F.col("expected"), F.col("input_status") == "ACCEPT_INPUT", F.get("texts", F.lit(0))
    same = e["status"].eqNullSafe(F.col("input_status")) & F.when(e["status"] == "ACCEPT_INPUT", (F.array(e["a"], e["b"]) == F.col("numbers")) & (e["flag"] == flag) & (e["branches"] == F.col("branches"))).otherwise(F.lit(True))
    taken = F.sum(F.when(accepted, F.size(F.filter("branches", lambda x: x))))
    return done.groupBy("family").agg(F.count("*").alias("scenarios"), F.count_if(F.startswith("label", F.lit("valid_"))).alias("valid"), F.count_if(~F.coalesce(same, F.lit(False))).alias("divergences"),
        F.count_if(accepted & flag.isin("T", "Y")).alias("flagged"), F.coalesce(taken, F.lit(0).cast("long")).alias("taken"), F.sum(testdata.seeded(0, F.col("program_index"), F.col("raw")).cast("decimal(20,0)")).cast("string").alias("digest"))


@query("""
select family, 0::bigint as table_and_expected, 0::bigint as compiled_and_expected, 0::bigint as table_and_compiled from (values ('and_correlation'), ('character_peer'), ('literal_threshold'), ('numeric_peer'), ('or_and_precedence'), ('ordered_overwrite'), ('reversed_literal'), ('three_rule_feedback'), ('two_group_join'), ('write_then_compare')) f(family), (select count(*) as n from lineitem) where n > 0
""")
def campaign_three_ways(spark, sf_dir):
    """Divergences between the rule table, the compiled programs and the independent expectation; none is right."""
    rows = rules.checked_by_columns(testdata.expected(testdata.scenarios(scenario_cases(spark, sf_dir), SEED)))
    programs = {i: testdata.program_rules(i)[1] for i in range(testdata.PROGRAMS)}
    given = rows.withColumn("_given", F.struct("numbers", "texts"))
    done = rules.run_rule_table(given, rules.rule_table(spark, programs)).withColumn("_table", F.struct("numbers", "texts", "branches"))
    done = rules.run_compiled(done.withColumns({c: F.col(f"_given.{c}") for c in ("numbers", "texts")}), programs).withColumn("_compiled", F.struct("numbers", "texts", "branches"))
    e, accepted = F.col("expected"), F.col("input_status") == "ACCEPT_INPUT"
    as_expected = lambda x: e["status"].eqNullSafe(F.col("input_status")) & F.when(accepted, (F.array(e["a"], e["b"]) == x["numbers"]) & (e["flag"] == F.get(x["texts"], F.lit(0))) & (e["branches"] == x["branches"])).otherwise(F.lit(True))
    differ = lambda same, name: F.count_if(~F.coalesce(same, F.lit(False))).alias(name)
    alike = ~accepted | (F.col("_table") == F.col("_compiled"))
    return done.groupBy("family").agg(differ(as_expected(F.col("_table")), "table_and_expected"), differ(as_expected(F.col("_compiled")), "compiled_and_expected"), differ(alike, "table_and_compiled"))


@query(f"""
{CASES_SQL}, {SCENARIOS_SQL}
select label, count(*) as scenarios, count(distinct (p, raw)) as distinct_inputs from s group by 1
""")
def scenario_duplicates(spark, sf_dir):
    """Scenarios, distinct inputs and labels of the campaign."""
    rows = testdata.scenarios(scenario_cases(spark, sf_dir), SEED)
    once = rows.groupBy("program_index", "label", F.sha2("raw", 256).alias("fp")).agg(F.count("*").alias("n"))
    return once.groupBy("label").agg(F.sum("n").alias("scenarios"), F.count("*").alias("distinct_inputs"))


@query("""
with j as (select c_acctbal >= 1000 as r1, c_acctbal > 1000 as r1b, o_orderstatus = 'P' as r2, c_nationkey > 20 as r3, c_nationkey >= 20 as r3b, o_totalprice > 200000 as r4, o_totalprice >= 200000 as r4b from orders join customer on o_custkey = c_custkey),
d as (select *, case when r4 then 'R' when r3 then 'N' when r2 then 'N' when r1 then 'Y' else 'N' end as d0 from j),
m as (select rule || ' ' || kind as m from (values ('R001'), ('R002'), ('R003'), ('R004')) a(rule), (values ('swapped arms'), ('moved boundary'), ('disabled'), ('changed effect')) b(kind)),
v as (
  select m as mutation, d0 <> case
    when case m when 'R004 swapped arms' then not r4 when 'R004 moved boundary' then r4b when 'R004 disabled' then false else r4 end then case m when 'R004 changed effect' then '#' else 'R' end
    when case m when 'R003 swapped arms' then not r3 when 'R003 moved boundary' then r3b when 'R003 disabled' then false else r3 end then case m when 'R003 changed effect' then '#' else 'N' end
    when case m when 'R002 swapped arms' then not r2 when 'R002 moved boundary' then not r2 when 'R002 disabled' then false else r2 end then case m when 'R002 changed effect' then '#' else 'N' end
    when m = 'R001 disabled' then ' '
    when case m when 'R001 swapped arms' then not r1 when 'R001 moved boundary' then r1b else r1 end then case m when 'R001 changed effect' then '#' else 'Y' end
    else 'N' end as x from d, m)
select mutation, count(*) as "rows", count(*) filter (x) as noticed from v group by 1
""")
def rule_sensitivity(spark, sf_dir):
    rows = orders_with_customers(spark, sf_dir).drop("o_custkey", "c_custkey").withColumn("decision", F.lit(" "))
    return testdata.sensitivity(rows, ELIGIBILITY, ["decision"], {"decision": 1, "o_orderstatus": 1})


@query("""
with a as (select distinct 'SIZES' as program, 'p_size' as field, p_size::bigint as n from part),
v as (select program, field, unnest([n - 1, n, n + 1, 0, 99]) as value from a)
select distinct program, field, value::varchar as value from v where value between 0 and 99
""")
def boundary_values(spark, sf_dir):
    """Boundaries of a rule set that compares a two-digit size with each size that occurs; without the seeded values."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    atoms = sizes.select(F.lit("SIZES").alias("program"), F.lit("p_size").alias("left"), F.col("p_size").cast("string").alias("literal"))
    layout = sizes.select(F.lit("SIZES").alias("program"), F.lit("p_size").alias("field"), F.lit("integer").alias("type"), F.lit(2).alias("width")).distinct()
    drawn = F.pmod(testdata.seeded(0, F.lit("SIZES"), F.lit("p_size")), F.lit(100)).cast("string")
    near = F.transform(F.array(F.col("p_size") - 1, F.col("p_size"), F.col("p_size") + 1, F.lit(0), F.lit(99)), lambda x: x.cast("string"))
    known = sizes.select(F.explode(near).alias("value")).distinct()
    return testdata.boundaries(atoms, layout).where(F.col("value") != drawn).unionByName(known.where(F.col("value") == drawn).select(F.lit("SIZES").alias("program"), F.lit("p_size").alias("field"), "value"))
