"""Queries of scans, catalogs, bindings, sinks, graph merges, scalar text functions and appended streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import lineage, lines
from tallyfold.plans.ledger_queries import event_stream
from tallyfold.plans.registry import query, table
from tallyfold.sources import scan, sinks
from tallyfold.sources.shared import fresh_path
from tallyfold.streaming import ledger

text = lambda c: F.col(c).cast("string")


@query("""
with f as (select case when l_linenumber % 2 = 0 then 'a/' else 'A/' end || l_partkey || case when l_linenumber = 7 then '/x' else '' end as path from lineitem), k as (select lower(path) as k from f)
select k as "key", 'same name' as problem from k group by 1 having count(*) > 1
union all select distinct k, 'file and folder' from k where k in (select replace(k, '/x', '') from k where ends_with(k, '/x'))
""")
def portable_paths(spark, sf_dir):
    n = F.col("l_linenumber")
    path = F.concat(F.when(n % 2 == 0, "a/").otherwise("A/"), text("l_partkey"), F.when(n == 7, "/x").otherwise(""))
    return scan.path_collisions(table(spark, sf_dir, "lineitem").select(path.alias("path")))


@query("""
select p_partkey, replace(p_name, ' ', '|') as inputs, p_brand || '|' || p_type as outputs, case when p_size % 3 = 0 then 'Unknown' else 'RC = 0' end as condition from part
""")
def manifest_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(",,")).alias("inputs"), F.concat_ws(",", "p_brand", "p_type").alias("outputs"), F.when(F.col("p_size") % 3 == 0, "  ").otherwise(" RC = 0 ").alias("condition"))
    return scan.manifest_rows(rows).select("p_partkey", F.array_join("inputs", "|").alias("inputs"), F.array_join("outputs", "|").alias("outputs"), "condition")


@query("""
select event_type, count(*) filter (event_id % 5 not in (1, 2, 3)) as documents, count(*) filter (event_id % 5 in (1, 2, 3)) as rejects from events group by 1
""")
def strict_documents(spark, sf_dir):
    """Every fifth text is cut, every fifth has a key twice, every fifth has a number that is none."""
    m = F.col("event_id") % 5
    raw = F.when(m == 1, F.replace("props", F.lit("}"), F.lit(""))).when(m == 2, F.replace("props", F.lit("}"), F.lit(', "k": 1}'))).when(m == 3, F.replace("props", F.lit(":"), F.lit(": NaN, \"y\":"))).otherwise(F.col("props"))
    good, bad = scan.strict_json(table(spark, sf_dir, "events").select("event_type", raw.alias("raw")), "raw")
    count = lambda df, name: df.groupBy("event_type").agg(F.count("*").alias(name))
    return count(good, "documents").join(count(bad, "rejects"), "event_type", "full").select("event_type", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("rejects", F.lit(0)).alias("rejects"))


@query("""
with c as (select unnest(list_distinct([upper(n_name), upper(substr(n_name, 1, 3))])) as k, n_name as name, 'standard' as origin from nation union all select unnest(list_distinct([upper(r_name), upper(substr(r_name, 1, 3))])), r_name, 'application' from region),
a as (select s_suppkey, case s_suppkey % 3 when 0 then upper(n_name) when 1 then upper(substr(n_name, 1, 3)) else upper(s_name) end as k from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, name, origin from a left join c using (k)
""")
def catalog_lookup(spark, sf_dir):
    """Suppliers' program names looked up by name or alias in a standard and an application catalog."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entries = lambda df, c, origin: scan.catalog_entries(df.select(F.col(c).alias("name"), F.array(F.substring(c, 1, 3)).alias("aliases")), origin)
    catalog = entries(n, "n_name", "standard").unionByName(entries(r, "r_name", "application"))
    m = F.col("s_suppkey") % 3
    key = F.upper(F.when(m == 0, F.col("n_name")).when(m == 1, F.substring("n_name", 1, 3)).otherwise(F.col("s_name")))
    asked = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", key.alias("key"))
    return asked.join(catalog, "key", "left").select("s_suppkey", "name", "origin")


@query("select distinct p_brand as creator, p_type as name from part where p_brand = 'Brand#2' and p_type like '%O%'")
def catalog_listing(spark, sf_dir):
    return scan.catalog_listing(table(spark, sf_dir, "part").select(F.col("p_brand").alias("creator"), F.col("p_type").alias("name")), "Brand#2", "%O%")


@query("select n_nationkey as key, n_name as label, count(c_custkey) as count from nation left join customer on n_nationkey = c_nationkey group by 1, 2")
def baseline_categories(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    one = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"), F.coalesce("n", F.lit(0)).alias("count"))
    return scan.baseline_categories(n.groupBy("n_regionkey").agg(F.collect_list(one).alias("categories")))


def bindings(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.concat(F.lit("o"), text("l_orderkey")).alias("path")).agg((F.count("*") * 100).alias("bytes"))
    return scan.bound_files(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("logical_id"), F.concat(F.lit("o"), text("o_orderkey")).alias("path")), files)


BOUND_SQL = """
f as (select 'o' || l_orderkey as path, count(*) * 100 as bytes from lineitem where l_quantity > 49 group by 1),
b as (select o_custkey as logical_id, 'o' || o_orderkey as path, bytes, bytes is not null as available from orders left join f on 'o' || o_orderkey = f.path)
"""


@query(f"with {BOUND_SQL} select * from b")
def bound_files(spark, sf_dir):
    return bindings(spark, sf_dir)


@query(f"with {BOUND_SQL} select logical_id, case count(*) filter (available) when 0 then 'input_unavailable' when 1 then 'resolved' else 'ambiguous' end as status from b group by 1")
def binding_status(spark, sf_dir):
    return lineage.binding_status(bindings(spark, sf_dir))


@query("select event_id, (props->>'$.k')::int as k from events")
def document_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return e.select("event_id", scan.document_field(e, "props", "$.k", "int").alias("k"))


@query("select least(count(*), 100) as n, 'sample_only' as coverage from orders")
def bounded_sample(spark, sf_dir):
    return scan.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 100).groupBy("coverage").agg(F.count("*").alias("n"))


@query("""
with r as (select c_nationkey, c_custkey, row_number() over (order by c_nationkey, c_custkey) as rank, length(c_name) + length(c_mktsegment) as bytes from customer)
select c_nationkey, c_custkey, (rank - 1) // 100 as page, sum(bytes) over (order by rank)::bigint as running from r
""")
def page_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    return scan.pages(c, ["c_nationkey", "c_custkey"], 100, F.length("c_name") + F.length("c_mktsegment")).select("c_nationkey", "c_custkey", "page", "running")


@query("""
with l as (select row_number() over (order by c_custkey) as rn, '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}' as line, length(line) + 1 as b from customer),
p as (select (rn - 1) // 100 as page, count(*) as n, sum(b) as b, max(rn) as upto_row from l group by 1), r as (select *, sum(b) over (order by page) as upto from p),
k as (select (rn - 1) // 64 as block, sha256(string_agg(sha256(line), '' order by rn)) as h from l where (rn - 1) // 100 in (select page from r where upto <= 20000) group by 1)
select case when max(upto) > 20000 or max(upto_row) >= 1000000 then 'PARTIAL' else 'COMPLETE' end as status, case when max(upto) > 20000 then 'byte limit' when max(upto_row) >= 1000000 then 'row limit' end as reason,
  coalesce(sum(n) filter (upto <= 20000), 0)::bigint as rows, count(*) filter (upto <= 20000) as pages, coalesce(sum(b) filter (upto <= 20000), 0)::bigint as bytes,
  (select case when count(*) = 1 then max(h) else sha256(string_agg(h, '' order by block)) end from k) as digest from r
""")
def ndjson_export(spark, sf_dir):
    """An export in pages under a byte budget, and its receipt with an ordered digest (blocks of 64 lines) from what was read back."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sinks.export_ndjson(c, ["c_custkey"], fresh_path(spark), 1_000_000, 100, 20_000, 64)


@query("""select p_type, count(*) as n, count(*) filter (p_partkey % 2 = 0) as guarded from part group by 1""")
def csv_export(spark, sf_dir):
    """Half of the names look like formulas; the file, read back, has them guarded."""
    path = fresh_path(spark)
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" =1+"), "p_name")).otherwise(F.col("p_name"))
    sinks.write_csv(table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_type", F.array("p_size").alias("sizes")), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.startswith("name", F.lit("' ="))).alias("guarded"))


@query("""select s_nationkey::bigint as s_nationkey, count(*) as n, 's_name,s_nationkey,s_suppkey' as columns from supplier group by 1""")
def json_export(spark, sf_dir):
    path = fresh_path(spark)
    sinks.write_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    back = spark.read.json(path)
    return back.groupBy("s_nationkey").agg(F.count("*").alias("n")).withColumn("columns", F.lit(",".join(back.columns)))


@query("select 1 as version, count(*) as n, sum(o_orderkey)::bigint as keys from orders union all select 2, count(*), sum(o_orderkey)::bigint from orders where o_orderstatus = 'F'")
def versioned_writes(spark, sf_dir):
    """Two results under one name: each gets the next version, none is overwritten."""
    path = fresh_path(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_version(o, path)
    sinks.write_version(o.where("o_orderstatus = 'F'"), path)
    return spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""
with p as (select ((row_number() over (order by o_orderkey) - 1) // 4000 + 1)::int as part from orders) select part, count(*) as rows, count(*) as written, true as equal from p group by 1
""")
def written_parts(spark, sf_dir):
    """Numbered parts of at most 4,000 rows and a header, counted again after reading them back."""
    path = fresh_path(spark)
    parts = sinks.split_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 4001)
    parts.repartition("part").write.partitionBy("part").parquet(path)
    return sinks.written_rows(parts, spark.read.parquet(path), "part")


@query("""
with l as (select page_id, unnest(string_split(html, chr(10))) as line from pages),
h as (select page_id, 'links' as relation, 'page' as kind, unnest(regexp_extract_all(line, '(?i)href="([^"]*)"', 1)) as name from l union all select page_id, 'titles', 'text', unnest(regexp_extract_all(line, '(?i)<title>([^<]*)</title>', 1)) from l)
select page_id, relation, kind, contains(name, '&') as dynamic, count(*) as n from h group by all
""")
def pattern_references(spark, sf_dir):
    """What pages refer to, by a pattern table over their lines."""
    rows = lines.explode_lines(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    found = lineage.extract(rows, [("links", "page", 'href="([^"]*)"'), ("titles", "text", "<title>([^<]*)</title>")], "page_id")
    return found.groupBy("page_id", "relation", "kind", "dynamic").agg(F.count("*").alias("n"))


@query("""
with l as (select page_id, unnest(string_split(html, chr(10))) as line from pages),
e as (select page_id, 'lang' as kind, unnest(regexp_extract_all(line, '(?im)<html lang="([a-z]+)"', 1)) as name from l union all select page_id, 'attribute', unnest(regexp_extract_all(line, '(?im)\\s([a-z]+)="', 1)) from l)
select distinct page_id, kind, upper(name) as name from e
""")
def named_entities(spark, sf_dir):
    rows = lines.explode_lines(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    return lines.entities(rows, {"lang": '<html lang="([a-z]+)"', "attribute": r'\s([a-z]+)="'}, "page_id")


@query("""
with r as (select p_partkey, case when p_size % 5 <> 0 then 'lib.' || p_type end as library, case when p_partkey % 3 = 0 then 'lib/' || p_brand else 'Lib/' || lower(p_type) || '/' || p_brand end as path from part)
select p_partkey, path from r where library is null or list_has_all(string_split_regex(upper(path), '[/.]'), string_split_regex(upper(library), '[/.]'))
""")
def library_candidates(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("lib/"), "p_brand")).otherwise(F.concat(F.lit("Lib/"), F.lower("p_type"), F.lit("/"), "p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("lib."), "p_type")).alias("library"), path.alias("path"))
    return lineage.with_library(rows, "library", "path").select("p_partkey", "path")


@query("""
with n as (select 'N' || c_nationkey as id, 'customer' as kind, c_mktsegment as name, c_mktsegment as e from customer union all select 'N' || s_nationkey, 'supplier', 'S', null from supplier)
select id, min(kind) as kind, min(name) as name, coalesce(string_agg(distinct e, ',' order by e), '') as evidence from n group by 1
""")
def merged_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), text("c_nationkey")).alias("id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"), F.array("c_mktsegment").alias("evidence"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), text("s_nationkey")).alias("id"), F.lit("supplier").alias("kind"), F.lit("S").alias("name"))
    return lineage.merged_nodes(c, s).withColumn("evidence", F.array_join("evidence", ","))


@query("""
with e as (select o_custkey, o_orderpriority, o_orderstatus as e from orders union all select o_custkey, o_orderpriority, 'big' from orders where o_totalprice > 200000)
select o_custkey as source, o_orderpriority as target, 'orders' as kind, string_agg(distinct e, ',' order by e) as evidence from e group by 1, 2
""")
def merged_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    edge = lambda df, evidence: df.select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.lit("orders").alias("kind"), F.array(evidence).alias("evidence"))
    return lineage.merged_edges(edge(o, F.col("o_orderstatus")), edge(o.where("o_totalprice > 200000"), F.lit("big"))).withColumn("evidence", F.array_join("evidence", ","))


@query("""
with k as (select doc_id::varchar as path, sha256(text) as sha from documents), f as (select case when doc_id % 3 = 0 then 'new' || doc_id else doc_id::varchar end as path, case when doc_id % 4 = 0 then sha256('x' || text) else sha256(text) end as sha from documents)
select 'found' as side, path, sha as sha256 from f where path not in (select path from k) union all select 'conflict', path, f.sha from f join k using (path) where f.sha <> k.sha
""")
def provenance_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = d.select(text("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new"), text("doc_id"))).otherwise(text("doc_id"))
    found = d.select(path.alias("path"), F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    fresh, conflicts = lineage.merge_sources(known, found)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "path", "sha256")
    return side(fresh, "found").unionByName(side(conflicts, "conflict"))


@query("""
select o_orderkey as path, o_orderkey in (select l_orderkey from lineitem where l_quantity > 49) as selected,
  case when o_orderkey in (select l_orderkey from lineitem where l_quantity > 49) then 'reached from a selected job' else 'not reached from a selected job' end as reason from orders
""")
def scoped_files(spark, sf_dir):
    closed = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return lineage.scoped(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path")), closed)


@query(r"""
select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') as stem, lower(regexp_extract(url, '[^/](\.[^./]*)$', 1)) as suffix from pages
""")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.stem(F.col("url")).alias("stem"), T.suffix(F.col("url")).alias("suffix"))


@query("""select p_partkey, case when p_size % 2 = 0 then upper(p_brand) end as library, upper(case when p_size % 2 = 0 then p_type else p_name end) as member from part""")
def operand_members(spark, sf_dir):
    operand = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand", F.lit("("), "p_type", F.lit(")"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.member_of(operand).alias("m")).select("p_partkey", "m.library", "m.member")


@query("""
with n as (select c_nationkey, list_sort(list(distinct c_mktsegment)) as ns from customer group by 1),
f as (select c_nationkey, ns, greatest(1, len(list_filter(range(1, len(ns) + 1), lambda i: list_sum(list_transform(ns[1:i], lambda x: length(x) + 2)) - 2 <= 25)))::int as k from n)
select c_nationkey, array_to_string(ns[1:k], ', ') || case when len(ns) > k then ' (+' || (len(ns) - k) || ' more; ' || len(ns) || ' total)' else '' end as segments from f
""")
def list_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("ns"))
    return rows.select("c_nationkey", T.list_summary(F.col("ns"), 25).alias("segments"))


@query("""
select event_id, 'x = ''' || repeat(' ', length(event_type) + 2) || ''' and ' || array_to_string(list_transform(list_zip(string_split_regex(props, '"[^"]*"'), regexp_extract_all(props, '"[^"]*"')),
  lambda z: z[1] || coalesce('"' || repeat(' ', length(z[2]) - 2) || '"', '')), '') as masked, 'say ''*> ' || event_type || ''' ' || props || ' ' as uncommented from events
""")
def literals_and_comments(spark, sf_dir):
    quoted = F.concat(F.lit("x = 'a "), "event_type", F.lit("' and "), "props")
    commented = F.concat(F.lit("say '*> "), "event_type", F.lit("' "), "props", F.lit(" *> note "), text("user_id"))
    return table(spark, sf_dir, "events").select("event_id", T.masked_literals(quoted).alias("masked"), T.without_comment(commented).alias("uncommented"))


@query("""
select c_custkey, case when length(c_mktsegment) <= 9 then rpad(c_mktsegment, 9, ' ') end as padded, case when c_nationkey = 3 then 'customers' else 'custdata' || c_nationkey end as location,
  case c_custkey % 4 when 0 then c_nationkey < 8 when 1 then c_nationkey >= 4 when 2 then true end as met, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') as fingerprint from customer
""")
def scalar_functions(spark, sf_dir):
    condition = F.get(F.array(*[F.lit(x) for x in ("RC < 8", "rc>=4", " Always", "RC ~ 3")]), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.fixed_width(F.col("c_mktsegment"), 9).alias("padded"), T.location_key(F.concat(F.lit("Cust Data "), text("c_nationkey")), {"custdata3": "customers"}).alias("location"),
        T.condition_met(condition, F.col("c_nationkey")).alias("met"), T.record_fingerprint("c_mktsegment", "c_custkey").alias("fingerprint"),
    )


@query("select conv_id, turn, length(text) as chars, length(text) - length(replace(text, chr(10), '')) as line_ends from conversations")
def cleaned_sources(spark, sf_dir):
    """Comments, literals and in-stream data blanked across lines: no character moves."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.cleaned(F.col("text")).alias("t"))
    return c.select("conv_id", "turn", F.length("t").alias("chars"), F.regexp_count("t", F.lit("\n")).alias("line_ends"))


@query("select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def stream_append(spark, sf_dir):
    """The log appended by a stream, once each, and read back."""
    path = fresh_path(spark)
    ledger.append_events(event_stream(spark, sf_dir), path, fresh_path(spark)).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def stream_merge(spark, sf_dir):
    """The same stream merged twice by key: the second time adds nothing."""
    path = fresh_path(spark)
    for _ in range(2):
        ledger.merge_stream(event_stream(spark, sf_dir), path, "event_id", ["event_type", "user_id"], fresh_path(spark)).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
