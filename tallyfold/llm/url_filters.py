"""URL filters: pattern rules indexed by their rarest literal token.

Rules come in families: hosts with paths, words of a host, segments of a path and parameters of a query. Each rule is a regular expression plus the whole tokens that any URL it fits must hold. One aggregation counts how often
those tokens occur in the URLs; every rule is filed under its rarest one. A URL looks its own tokens up in the index and
only the rules found that way run their regular expression. The index is a literal of the plan (the rules are
configuration, at most ``MAX_RULES``), so judging is one narrow pass without a shuffle.

Nulls and URLs without ``://`` have an empty host and path, which no rule fits. Ties go to the longer rule text, then to
the rule listed later. Repeated rows are judged alike, one by one. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import LOWER, UPPER, free_name

MAX_RULES = 100_000
NOT_TOKEN = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried on host, path and, if there is one, ``?`` and the query; ``literals`` are tokens that every fitting URL holds whole."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text) if text.isascii() else f"\\Q{text}\\E"


def host_rule(action: str, host: str, path: str = "/") -> Rule:
    """A rule that fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    host = host.translate(str.maketrans(UPPER, LOWER))
    tokens = [t for t in re.split(NOT_TOKEN, host + path) if t]
    if path and path[-1].isascii() and path[-1].isalnum():
        tokens.pop()  # may be the start of a longer token
    end = "" if path else "(?![^/?])"
    return Rule(host + path, action, rf"^(?:[^/?]*\.)?{quoted(host + path)}{end}", tuple(dict.fromkeys(tokens)))


def host_word_rule(action: str, words: str) -> Rule:
    """A rule that fits hosts holding ``words`` (joined by hyphens) as whole tokens."""
    return Rule(f"*{words}*", action, rf"^(?:[^/?]*[^/?A-Za-z0-9])?{quoted(words)}(?![A-Za-z0-9])", tuple(dict.fromkeys(words.split("-"))))


def literals_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(NOT_TOKEN, text) if t))


def path_rule(action: str, segment: str) -> Rule:
    """A rule that fits paths with a segment of this name, a file ending aside."""
    return Rule(f"/{segment}/", action, rf"^[^/?]*/(?:[^?]*/)?{quoted(segment)}(?![^/?.])", literals_of(segment))


def query_rule(action: str, name: str, value: str = "[^&]*") -> Rule:
    """A rule that fits queries with a parameter of this name whose value fits the pattern ``value``.

    No group repeats in the pattern: Java's matcher recurses for each turn of a group, too deep for a very long query.
    """
    return Rule(f"?{name}=", action, rf"^[^?]*\?(?:[\s\S]*&)?{quoted(name)}=(?:{value})(?![^&])", literals_of(name))


BASE_RULES = (
    host_rule("allow", "com"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: The method's own. Hosts of gambling, pill shops and link farms; pages behind forms; further pages of a list, sessions, replies and print views.
METHOD_RULES = (
    *[host_word_rule("block", w) for w in ("casino", "free-bets", "cheap-pills", "poker", "lottery", "spam-farm", "link-farm")],
    *[path_rule("block", w) for w in ("login", "signup", "cart", "checkout", "cgi-bin", "wp-admin")],
    query_rule("block", "page", "[2-9]|[1-9][0-9]+"),
    *[query_rule("block", w) for w in ("sessionid", "phpsessid", "replytocom", "print")],
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """What the rules are tried on: host, path and, unless it is empty, ``?`` and the query up to a ``#``."""
    query = F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), r"^[^?#]*\?([^#]*)", 1)
    return F.concat(*split_url(url), F.when((F.instr(url, "://") > 0) & (query != ""), F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def tokens_of(key: Column) -> Column:
    return F.array_distinct(F.split(key, NOT_TOKEN))


def token_counts(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each literal of the rules occurs; at most one row for each literal comes back."""
    literals = F.from_json(F.lit(json.dumps(sorted({t for r in rules for t in r.literals}))), "array<string>")
    found = urls.select(F.explode(F.array_intersect(tokens_of(key_of(F.col(url))), literals)).alias("t"))
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge(urls: DataFrame, url: str, base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``method_rule`` to the URLs. Columns of these names are replaced.

    The longest fitting base rule decides; where none fits, the longest fitting method rule, else ``default``.
    """
    rules = base + method
    if len(rules) > MAX_RULES or not all(r.literals for r in rules):
        raise ValueError(f"rules need a literal token each and may be {MAX_RULES} at most")
    counts = token_counts(urls, url, rules)
    n = 1 << max(4, len(rules).bit_length() + 1)
    filed: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for i, r in enumerate(rules):
        rarest = min(r.literals, key=lambda t: (counts.get(t, 0), t))
        filed[zlib.crc32(rarest.encode()) % n].append((rarest, i))
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)  # folded once, however many rules there are
    index = constant([[{"token": t, "rule": i} for t, i in bucket] for bucket in filed], "array<array<struct<token:string,rule:int>>>")
    patterns, names, actions = (constant([getattr(r, k) for r in rules], "array<string>") for k in ("pattern", "name", "action"))
    weights = constant([len(r.name) for r in rules], "array<int>")

    host, path = split_url(F.col(url))
    at = free_name(urls, "key")
    out = urls.withColumn(at, key_of(F.col(url))).withColumns({"host": host, "path": path})
    key = F.col(at)
    bucket = lambda t: F.get(index, F.pmod(F.crc32(t), F.lit(n)).cast("int"))
    candidates = F.array_distinct(F.flatten(F.transform(tokens_of(key), lambda t: F.transform(F.filter(bucket(t), lambda e: e["token"] == t), lambda e: e["rule"]))))
    hits = free_name(out, "hits")
    out = out.withColumn(hits, F.filter(candidates, lambda r: F.rlike(key, F.get(patterns, r))))
    longest = lambda part: F.array_max(F.transform(part, lambda r: F.struct(F.get(weights, r).alias("w"), r.alias("r"))))["r"]
    of_base, of_method = free_name(out, "of_base"), free_name(out, "of_method")
    out = out.withColumns({of_base: longest(F.filter(hits, lambda r: r < len(base))), of_method: longest(F.filter(hits, lambda r: r >= len(base)))})
    pick = lambda values, at: F.when(F.col(at).isNotNull(), F.get(values, F.col(at)))
    return out.withColumns({
        "rule": pick(names, of_base),
        "verdict": F.coalesce(pick(actions, of_base), pick(actions, of_method), F.lit(default)),
        "method_rule": pick(names, of_method),
    }).drop(at, hits, of_base, of_method)
