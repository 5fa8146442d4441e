"""Queries of scans, text lines and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import lines
from tallyfold.plans.registry import query, table
from tallyfold.sources import scan, sinks
from tallyfold.sources.shared import fresh_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


DESCRIBE_SQL = " union all ".join(
    f"select 'sf' as schema, '{t}' as \"table\", column_name as name, column_type as type, row_number() over () as ordinal, (select count(*) from {t}) as n_rows from (describe {t})" for t in TABLES
)


@query(f"""
with c as ({DESCRIBE_SQL})
select schema, "table", name, replace(case when ends_with(type, '[]') then 'array<' || t || '>' else t end, 'timestamp', 'timestamp_ntz') as type, true as nullable, ordinal::int as ordinal, n_rows
from (select *, case replace(type, '[]', '') when 'INTEGER' then 'int' when 'VARCHAR' then 'string' else lower(replace(type, '[]', '')) end as t from c)
""")
def describe_columns(spark, sf_dir):
    """Columns of every table, with the number of its rows."""
    counted = lambda t: scan.describe(table(spark, sf_dir, t), "sf", t).join(table(spark, sf_dir, t).agg(F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionByName, [counted(t) for t in TABLES])


CONVERSATION_SQL = """
t as (select conv_id % 20 as part, string_agg(coalesce(replace(replace(text, chr(10), ' '), chr(13), ' '), ''), chr(10) order by conv_id, turn) || chr(10) as text from conversations group by 1)
"""


def conversation_files(spark, sf_dir):
    """Twenty text files made of the conversations, a turn a line, as a folder that Spark wrote."""
    path = fresh_path(spark)
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("part"), "conv_id", "turn", F.coalesce(F.regexp_replace("text", "[\n\r]", " "), F.lit("")).alias("value"))
    rows.repartition(20, "part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    return scan.scan_text_files(spark, path, "*.txt").withColumn("part", F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long"))


@query(f"with {CONVERSATION_SQL} select part, sha256(text) as sha256, octet_length(encode(text))::bigint as bytes, (length(text) - length(replace(text, chr(10), '')))::int as lines, null::varchar as problem, text from t")
def file_scan(spark, sf_dir):
    """Hash, size, lines, problem and text of every file of a folder."""
    return conversation_files(spark, sf_dir).select("part", "sha256", "bytes", "lines", "problem", "text")


@query(f"""
with {CONVERSATION_SQL}, f as (select octet_length(encode(text))::bigint as bytes, length(text) - length(replace(text, chr(10), '')) as lines from t)
select 'files' as "check", count(*) as value, 15::bigint as most, count(*) <= 15 as ok from f union all select 'file_bytes', max(bytes), 8000, max(bytes) <= 8000 from f
union all select 'total_bytes', sum(bytes)::bigint, 100000000, sum(bytes) <= 100000000 from f union all select 'lines', sum(lines)::bigint, 400, sum(lines) <= 400 from f
""")
def file_limits(spark, sf_dir):
    """The bounds of a scan of the same files, some of them exceeded."""
    return scan.check_limits(conversation_files(spark, sf_dir), scan.Limits(files=15, file_bytes=8000, total_bytes=100_000_000, lines=400))


@query("""
with d as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no, len(string_split(text, chr(10))) as n from documents)
select doc_id, line_no::int as line_no, line from d where not (line_no = n and line = '')
""")
def physical_lines(spark, sf_dir):
    return lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""
with d as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no, len(string_split(text, chr(10))) as n from documents),
c as (select doc_id, case when trim(line) = '' then 'blank' when regexp_matches(line, '^[0-9]{6}') then 'card' when starts_with(ltrim(line), '*>') then 'comment' else 'code' end as k from d where not (line_no = n and line = ''))
select doc_id, count(*) as physical, count(*) filter (k = 'blank') as blank, count(*) filter (k = 'comment') as comment, count(*) filter (k in ('code', 'card')) as code from c group by 1
""")
def line_counts(spark, sf_dir):
    return lines.line_counts(lines.normalize_fixed(lines.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")), "doc_id")


@query("""
select doc_id, case when doc_id % 5 = 0 then '''=' || text when regexp_matches(ltrim(text, ' '), '^[=+\\-@]') then '''' || text else text end as text from documents
""")
def formula_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text")).alias("text"))
    return sinks.guard_formulas(d)


@query("""
with n as (select doc_id, text, sha256(text) as sha256, unnest(range(0, greatest(1, (length(text) - 1) // 3000 + 1))) as c from documents)
select doc_id, c::int as chunk_no, substr(text, c * 3000 + 1, 3000) as chunk, sha256 from n
""")
def chunk_text(spark, sf_dir):
    return sinks.chunk_text(table(spark, sf_dir, "documents"), "doc_id", "text", 3000)


HTML = (("anchor", "<a\\s"), ("script", "<script\\b"), ("table", "<table\\b"), ("list", "<li\\b"), ("license", "licen[sc]e"))


@query("""
with l as (select page_id, unnest(string_split(html, chr(10))) as line from pages), k(kind, p) as (values ('anchor', '<a\\s'), ('script', '<script\\b'), ('table', '<table\\b'), ('list', '<li\\b'), ('license', 'licen[sc]e'))
select page_id, kind, count(*) as n from l, k where regexp_matches(line, '(?i)' || p) group by 1, 2
""")
def signature_classification(spark, sf_dir):
    found = lines.signature_hits(lines.explode_lines(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id"), HTML)
    return found.select("page_id", F.explode("kinds").alias("kind")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query()
def content_kinds(spark, sf_dir):
    """Files of the documents table by content kind; texts are prose, so nearly all stay unresolved."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return lines.classify(lines.explode_lines(files)).groupBy("kind", "confidence", "hint").agg(F.count("*").alias("n"))


VERBS = {"THE": "article", "A": "article", "AN": "article", "OF": "preposition", "IN": "preposition", "ON": "preposition", "AND": "conjunction", "OR": "conjunction", "DER": "article", "DIE": "article", "LA": "article", "LE": "article"}


@query("""
with l as (select unnest(string_split(text, chr(10))) as line from documents union all select unnest(string_split(text, chr(10))) from conversations),
t as (select distinct row_number() over () as id, line from l), w as (select distinct id, upper(unnest(regexp_extract_all(line, '[A-Za-z][A-Za-z0-9-]*'))) as w from t),
v(w, family) as (values ('THE', 'article'), ('A', 'article'), ('AN', 'article'), ('OF', 'preposition'), ('IN', 'preposition'), ('ON', 'preposition'), ('AND', 'conjunction'), ('OR', 'conjunction'), ('DER', 'article'), ('DIE', 'article'), ('LA', 'article'), ('LE', 'article'))
select family, count(distinct id) as n from w join v using (w) group by 1
""")
def token_family_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("path"), "text")
    found = lines.families(lines.explode_lines(d.unionByName(c)), VERBS)
    return found.select(F.explode("families").alias("family")).groupBy("family").agg(F.count("*").alias("n"))


@query("""
with f(n, family) as (values (1, 'assignment'), (2, 'conditional'), (2, 'iteration'), (3, 'embedded_sql'), (4, 'jcl_data'), (5, 'file_io'), (6, 'data_layout'))
select l_returnflag, family, count(*) as n from lineitem join f on l_linenumber = f.n group by 1, 2
""")
def construct_families(spark, sf_dir):
    """Source lines made of line items: one kind of statement for each line number, the seventh a comment."""
    q = F.col("l_quantity").cast("string")
    made = [
        F.concat(F.lit("   MOVE "), q, F.lit(" TO QTY.")), F.concat(F.lit("IF QTY > "), q, F.lit(" PERFORM ORDER-MORE END-IF.")), F.concat(F.lit("EXEC SQL SELECT * FROM ITEMS WHERE Q = "), q, F.lit(" END-EXEC.")),
        F.concat(F.lit("//ITEM DD DSN=ITEMS.Q"), q), F.concat(F.lit("display 'IF MOVE "), q, F.lit("'.")), F.concat(F.lit("05 QTY PIC 9(3) VALUE "), q, F.lit(".")), F.concat(F.lit("* MOVE "), q),
    ]
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.element_at(F.array(*made), F.col("l_linenumber").cast("int")).alias("line"))
    return lines.constructs(rows).select("l_returnflag", F.explode("constructs").alias("family")).groupBy("l_returnflag", "family").agg(F.count("*").alias("n"))


@query("""select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as href from pages""")
def reference_extraction(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href"))


@query("""
with q as (select event_id, 'select * from ' || event_type || ' join t' || (user_id % 3) || ' on 1 = 1 where x = ''from nowhere''' as q from events)
select q.event_id, upper(event_type) || ',T' || (user_id % 3) as tables from q join events using (event_id)
""")
def sql_table_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("select * from "), "event_type", F.lit(" join t"), (F.col("user_id") % 3).cast("string"), F.lit(" on 1 = 1 where x = 'from nowhere'"))
    return e.select("event_id", F.array_join(T.table_references(text), ",").alias("tables"))


@query("""
with w as (select doc_id, list_distinct(string_split(lower(text), ' ')) as ws from documents), r as (select item_id, list_distinct(list_slice(string_split(lower(text), ' '), 1, 2)) as parts from benchmark)
select doc_id, item_id from w, r where list_has_all(ws, parts)
""")
def subset_join(spark, sf_dir):
    """Documents that hold both opening words of a benchmark item: an equality join on one word, then the subset test."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("ws"))
    r = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.slice(F.split(F.lower("text"), " "), 1, 2)).alias("parts"))
    longest = F.array_max(F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    both = d.withColumn("w", F.explode("ws")).join(r.withColumn("w", longest), "w")
    return both.where(F.size(F.array_except("parts", "ws")) == 0).select("doc_id", "item_id")


@query("""select doc_id, sha256(text) as digest, length(text)::int as n, upper(source) as source_key from documents where regexp_full_match(source, '[A-Za-z][A-Za-z0-9_-]*')""")
def hashed_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(T.valid_identifier(F.col("source")))
    return d.select("doc_id", T.sha256(F.col("text")).alias("digest"), F.length("text").alias("n"), F.upper("source").alias("source_key"))
