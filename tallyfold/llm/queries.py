"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontaminate, embeddings, hilbert, licences, merkle, phrases, pu_quality, quality_rules, secrets, simhash, toxicity, url_filters
from tallyfold.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return judged.select("page_id", "host", "path", "rule", "verdict", "method_rule")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", "matches").where(F.size("matches") > 0)
    return found.select("doc_id", F.array_join(F.transform("matches", lambda m: m["item_id"].cast("string")), ",").alias("items"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_distance"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), samples=secrets.random_strings(spark))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pu_quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, tampered=merkle.without_newlines(docs["doc_id"], docs["text"]))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_license_scans, op3_decontamination, op4_secret_scans, op5_quality_rules, op6_simhash, op7_byte_bpe, op8_toxicity, op9_quality_classifier, op10_sharding, op11_merkle_manifest, op12_phrase_collocations, op13_embedding_near_dedup)}

ORACLES = {
    "op1_url_filters": r"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from split
), rules(rule, rule_host, rule_path, action) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), method(name, pattern) as (
  select '*' || w || '*', '^([^/?]*[^/?A-Za-z0-9])?' || w || '([^A-Za-z0-9]|$)' from (values ('casino'), ('free-bets'), ('cheap-pills'), ('poker'), ('lottery'), ('spam-farm'), ('link-farm')) v(w)
  union all select '/' || w || '/', '^[^/?]*/([^?]*/)?' || w || '([/?.]|$)' from (values ('login'), ('signup'), ('cart'), ('checkout'), ('cgi-bin'), ('wp-admin')) v(w)
  union all select '?' || w || '=', '^[^?]*\?([^&]*&)*' || w || '=(' || value || ')(&|$)' from (values ('page', '[2-9]|[1-9][0-9]+'), ('sessionid', '[^&]*'), ('phpsessid', '[^&]*'), ('replytocom', '[^&]*'), ('print', '[^&]*')) v(w, value)
), fits as (
  select distinct host, path, query, (select arg_max(struct_pack(rule, action), length(rule)) from rules
    where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as best,
    (select arg_max(name, length(name)) from method where regexp_matches(host || path || case when query <> '' then '?' || query else '' end, pattern)) as method_rule
  from parts
)
select page_id, p.host, p.path, best.rule as rule, coalesce(best.action, case when method_rule is not null then 'block' else 'allow' end) as verdict, method_rule
from parts p join fits f on p.host = f.host and p.path = f.path and p.query = f.query
""",
    "op2_license_scans": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), t(label, words, key, key_at, base) as (
  values ('cc-by', ['cc', 'by'], ['cc', 'by'], 0, true), ('gpl', ['general', 'public', 'license'], ['general', 'public', 'license'], 0, true),
    ('reserved', ['all', 'rights', 'reserved'], ['all', 'rights', 'reserved'], 0, true),
    ('gpl-3.0', string_split('this work is licensed under the gnu general public license version 3', ' '), string_split('general public license version 3', ' '), 7, false),
    ('cc-by-nc-4.0', string_split('licensed under cc by nc 4 0', ' '), string_split('cc by nc 4 0', ' '), 2, false),
    ('mit', string_split('released under the mit license', ' '), ['mit', 'license'], 3, false),
    ('apache-2.0', string_split('licensed under the apache license version 2 0', ' '), string_split('apache license version 2 0', ' '), 3, false),
    ('mpl-2.0', string_split('subject to the terms of the mozilla public license v 2 0', ' '), string_split('mozilla public license v 2 0', ' '), 6, false),
    ('bsd', string_split('redistribution and use in source and binary forms with or without modification are permitted', ' '), string_split('redistribution and use in source and binary forms', ' '), 0, false)
), places as (
  select doc_id, ws, label, words, key_at, base, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1] = key[1] and ws[i + 1 : i + len(key)] = key)) as s from d, t
), shares as (
  select *, list_sum(list_transform(range(0, len(words)), lambda j: case when s + j - key_at >= 0 and ws[s + j - key_at + 1] = words[j + 1] then 1 else 0 end)) / len(words)::double as share from places
), found as (
  select doc_id, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from shares group by doc_id
)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join found f on d.doc_id = f.doc_id
""",
    "op5_quality_rules": r"""
with d as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents
), grams as (
  select doc_id, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) as g from d where len(ws) >= 5
), twice as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
covered as (select distinct doc_id, unnest(range(i, i + 5)) as p from grams join twice using (doc_id, g)),
repeats as (select doc_id, count(*) as r from covered group by doc_id),
m as (
  select d.doc_id, source, len(ws)::bigint as n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words
  from d left join repeats on d.doc_id = repeats.doc_id
), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
hosts as (select source, count(*) as n, count(*) filter (base_failed) as f from b group by source),
prior as (select avg(f / n) as mean, var_pop(f / n) as v from hosts),
shrunken as (
  select source, (f + mean * w) / (n + w) <= 0.8 as host_kept
  from hosts, (select mean, case when v > 0 then greatest(2.0, mean * (1 - mean) / v - 1) else 2.0 end as w from prior)
)
select doc_id, n_words, word_chars::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_kept as kept
from b join shrunken s on b.source is not distinct from s.source
""",
    "op11_merkle_manifest": r"""
with recursive bits as (
  select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc
), d as (
  select doc_id, source, text, concat(coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-')) as head,
    list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])) & 1 = 1 as tampered
  from documents, bits
), hashed as (
  select *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(case when tampered then replace(text, chr(10), '') else text end)) || ':' || case when tampered then replace(text, chr(10), '') else text end, '-')) as found
  from d
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from hashed
), own(source, lvl, i, h, n) as (
  select source, 0, i, leaf, n from leaves
  union all
  select source, lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from own where n > 1 group by source, lvl, i // 3, n
), subroots as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from own where n = 1
), top(lvl, i, h, n) as (
  select 0, i, subroot, n from subroots
  union all
  select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from top where n > 1 group by lvl, i // 3, n
), spots as (select row_number() over () as spot, doc_id, l.source, leaf, found, subroot, l.i, s.i as s from leaves l join subroots s on l.source is not distinct from s.source
), steps as (
  select spot, lvl, coalesce(string_agg(h, '' order by own.i) filter (own.i < p.i // (3**lvl)::int), '') as before, coalesce(string_agg(h, '' order by own.i) filter (own.i > p.i // (3**lvl)::int), '') as after
  from spots p join own on own.source is not distinct from p.source and own.n > 1 and own.i // 3 = p.i // (3**(lvl + 1))::int group by spot, lvl
  union all
  select spot, 1000 + lvl, coalesce(string_agg(h, '' order by top.i) filter (top.i < s // (3**lvl)::int), ''), coalesce(string_agg(h, '' order by top.i) filter (top.i > s // (3**lvl)::int), '')
  from spots join top on top.n > 1 and top.i // 3 = s // (3**(lvl + 1))::int group by spot, lvl
), paths as (select spot, string_agg(before || after, '' order by lvl) as siblings, list(before || ':' || after order by lvl) as path from steps group by spot
), folded as (
  select doc_id, leaf, subroot, (select h from top where n = 1) as root, sha256(coalesce(siblings, '')) as proof_sha256,
    list_reduce([found] || coalesce(path, []), lambda h, x: sha256(split_part(x, ':', 1) || h || split_part(x, ':', 2))) as folded_root
  from spots left join paths using (spot)
)
select *, folded_root = root as verified from folded
""",
    "op12_phrase_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), grams as (
  select lang, unnest(flatten([list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1]) for k in [1, 2, 3]])) as w from words
), f as (select lang, w, count(*) as a from grams group by lang, w
), sizes as (select lang, sum(len(ws))::bigint as n from words group by lang
), candidates as (select * from f where len(w) > 1 and a >= 10
), dropped as (
  select distinct c.lang, c.w from (select lang, a, unnest([w[1:2], w[2:3]]) as w from candidates where len(w) = 3) x join candidates c on c.lang = x.lang and c.w = x.w and 100 * x.a >= 50 * c.a
), cuts as (select lang, w, a, unnest(range(1, len(w))) as k from candidates
), scores as (
  select c.lang, c.w, c.a, k, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score
  from cuts c join f x on x.lang = c.lang and x.w = c.w[1:k] join f y on y.lang = c.lang and y.w = c.w[k + 1:]
), best as (select lang, w, a, min(struct_pack(score, k, l, r)) as b from scores group by lang, w, a
), ranked as (
  select lang, array_to_string(w, ' ') as phrase, a, b.l as l, b.r as r, b.score::bigint as score,
    row_number() over (partition by lang order by b.score desc, a desc, array_to_string(w, ' ')) as rank
  from best anti join dropped using (lang, w)
)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
""",
    "op13_embedding_near_dedup": r"""
with recursive e as (
  select row_number() over () as i, vec_id, case when len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 then label end as label, embedding::double[] as v from embeddings
), links as (
  select a.i as a, b.i as b from e a join e b on a.label = b.label and a.i <> b.i and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93
), reach(i, other) as (select i, i from e union select r.i, b from reach r join links on other = a
), named as (select r.i, min(o.vec_id) as component_id from reach r join e o on r.other = o.i group by r.i
), counts as (select a as i, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from e join named using (i) left join counts using (i)
""",
}
