"""Expected against actual, coverage, inventory, portfolio and drift. Unknown is never zero."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import percent
from tallyfold.operators.windows import spans

#: From worst to best.
DISPOSITIONS = ("blocked", "platform_replaced_unverified", "mapped_unverified", "platform_replaced_verified", "mapped_verified", "non_executable", "out_of_scope")


def compare(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, outcome, differing)``: matched, mismatch, left_only or right_only, and the columns that differ (nulls equal)."""
    values = [c for c in expected.columns if c not in keys]
    left = expected.select(*keys, F.struct(*values).alias("_e"))
    right = actual.select(*keys, F.struct(*values).alias("_a"))
    both = left.join(right, list(keys), "full")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in values]))
    outcome = F.when(F.col("_a").isNull(), "left_only").when(F.col("_e").isNull(), "right_only").when(F.size(differing) == 0, "matched").otherwise("mismatch")
    return both.select(*keys, outcome.alias("outcome"), F.when(F.col("_a").isNotNull() & F.col("_e").isNotNull(), differing).alias("differing"))


def verdict(compared: DataFrame, missing_branches: int) -> DataFrame:
    """One row: counts by outcome and MATCHED, MATCHED_WITH_GAPS or MISMATCH."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = compared.agg(n("matched").alias("matched"), n("mismatch").alias("mismatched"), n("left_only").alias("left_only"), n("right_only").alias("right_only"))
    bad = F.col("mismatched") + F.col("left_only") + F.col("right_only") > 0
    return out.withColumn("status", F.when(bad, "MISMATCH").when(F.lit(missing_branches > 0), "MATCHED_WITH_GAPS").otherwise("MATCHED"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``only_left, only_right, equal`` as bags of rows."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.join(right).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))  # one row each


def sequences_equal(a: DataFrame, b: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """``(key, equal)``: whether both sides list the same values in the same order."""
    lists = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order.alias("_o"), *values))).alias(name))
    return lists(a, "_a").join(lists(b, "_b"), key, "full").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("equal"))


def disposition_counts(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """``(disposition, n, share)`` over a fixed domain; zeros stay, the share of nothing is null."""
    names = rows.sparkSession.createDataFrame([(d,) for d in domain], "disposition string")
    seen = rows.groupBy(F.col(column).alias("disposition")).agg(F.count("*").alias("n"))
    counted = names.join(seen, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.join(F.broadcast(total)).select("disposition", "n", percent(F.col("n"), F.col("_total")).alias("share"))


def distinct_folded(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``(keys, names, spellings)``: distinct names without regard to case, and as they are spelled; null names do not count."""
    once = rows.select(*keys, F.col(name).alias("_name")).distinct()
    return once.groupBy(*keys).agg(F.count_distinct(F.lower("_name")).alias("names"), F.count("_name").alias("spellings"))


def units(rows: DataFrame, unit: str, disposition: str, priority: Sequence[str]) -> DataFrame:
    """``(unit, lines, verified, worst)``: verified only if every line is; the worst line by priority."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(disposition))
    good = F.col(disposition).endswith("_verified")
    return rows.groupBy(unit).agg(F.count("*").alias("lines"), F.bool_and(good).alias("verified"), F.min_by(disposition, rank).alias("worst"))


def coverage_summary(rows: DataFrame, disposition: str) -> DataFrame:
    """One row: lines, applicable, verified, percent and whether all is done."""
    applicable = ~F.col(disposition).isin("non_executable", "out_of_scope")
    done = F.col(disposition).endswith("_verified")
    out = rows.agg(F.count("*").alias("lines"), F.count_if(applicable).alias("applicable"), F.count_if(done).alias("verified"), F.count_if(F.col(disposition) == "blocked").alias("blocked"))
    return out.withColumn("percent", percent(F.col("verified"), F.col("applicable"))).withColumn("complete", (F.col("applicable") > 0) & (F.col("verified") == F.col("applicable")))


def dispose(lines: DataFrame) -> DataFrame:
    """Add ``disposition`` to lines with ``selected, hash_ok, kind, line_class, modeled, terminal, users_verified, verified,
    integrity_ok``; the first condition that holds decides."""
    good = F.col("integrity_ok")
    mapped = F.when(F.col("verified") & good, "mapped_verified").otherwise("mapped_unverified")
    replaced = F.when(F.col("verified") & good, "platform_replaced_verified").otherwise("platform_replaced_unverified")
    shared = F.when(F.col("users_verified") & good, "mapped_verified").otherwise("mapped_unverified")
    program, copybook, job = (F.col("kind") == k for k in ("program", "copybook", "job"))
    return lines.withColumn("disposition", (
        F.when(~F.col("selected"), "out_of_scope")
        .when(~F.col("hash_ok"), "blocked")
        .when(F.col("line_class").isin("blank", "comment"), "non_executable")
        .when(program & F.col("line_class").isin("structure", "paragraph"), "non_executable")
        .when(program & F.col("modeled"), mapped)
        .when(program & F.col("terminal"), replaced)
        .when(copybook & F.col("users_verified").isNotNull(), shared)
        .when(copybook & (F.col("line_class") == "group"), "non_executable")
        .when(job & (F.col("line_class") == "exec"), mapped)
        .when(job & (F.col("line_class") == "card"), replaced)
        .otherwise("blocked")
    ))


def blocked_by_kind(rows: DataFrame, kind: str, path: str) -> DataFrame:
    """``(kind, n, paths)``, most first, then by name. ``paths`` has a path once; it is as long as a kind has paths."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(path)).alias("paths")).orderBy(F.desc("n"), kind)


def range_join(lines: DataFrame, rules: DataFrame, key: str, line: str, start: str, end: str, width: int) -> DataFrame:
    """Lines with the rules whose inclusive span holds them.

    Spans are cut into buckets of ``width`` and lines meet only the spans of their bucket: an equality join, no product.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = rules.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return lines.withColumn("_bucket", bucket(line)).join(spread, [key, "_bucket"]).where(F.col(line).between(F.col(start), F.col(end))).drop("_bucket")


def pair_nth(a: DataFrame, b: DataFrame, key: str, order_a: Sequence, order_b: Sequence) -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other: ``(key, n, a, b)``; either side may be null."""
    number = lambda df, order, name: df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("n"), F.struct("*").alias(name))
    return number(a, order_a, "a").join(number(b, order_b, "b"), [key, "n"], "full")


def match_labels(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, label)`` for the distinct keys of two tables: MATCH, LEFT_ONLY or RIGHT_ONLY."""
    both = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("_a") & F.col("_b"), "MATCH").when(F.col("_a"), "LEFT_ONLY").otherwise("RIGHT_ONLY").alias("label"))


def label_gaps(labelled: DataFrame, left: str, right: str) -> DataFrame:
    """``(left, right, matches, mismatches, gap)``: a gap where one kind never occurs."""
    out = labelled.groupBy(left, right).agg(F.count_if(F.col("label") == "MATCH").alias("matches"), F.count_if(F.col("label") != "MATCH").alias("mismatches"))
    return out.withColumn("gap", (F.col("matches") == 0) | (F.col("mismatches") == 0))


def drift(frozen: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, change)`` of rows that are missing, extra or changed."""
    both = frozen.select(key, F.col(digest).alias("_f"), F.lit(True).alias("_was")).join(current.select(key, F.col(digest).alias("_c"), F.lit(True).alias("_is")), key, "full")
    change = F.when(F.col("_is").isNull(), "missing").when(F.col("_was").isNull(), "extra").when(~F.col("_f").eqNullSafe(F.col("_c")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def inventory(baseline: DataFrame, assets: DataFrame, key: str = "category") -> DataFrame:
    """``(category, declared, observed, versions, memberships, unreconciled)``; observed stays null where nothing was seen.

    ``assets`` has ``category, name, hash, process_id, demo``; demo processes do not count.
    """
    seen = assets.where(~F.col("demo")).groupBy(key).agg(F.count_distinct("name").alias("observed"), F.count_distinct("name", "hash").alias("versions"), F.count("*").alias("memberships"))
    return baseline.join(seen, key, "left").withColumn("unreconciled", F.col("declared") - F.col("observed"))


def cumulative_credit(accepted: DataFrame, local: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Distinct keys that were accepted and are still local, plus the current ones."""
    return accepted.select(key).join(local.select(key), key, "left_semi").union(current.select(key)).distinct()


def portfolio(memberships: DataFrame) -> DataFrame:
    """One row over ``(process_id, status, demo, version_id, selected)``: an asset is selected if any process selects it."""
    rows = memberships.where(~F.col("demo"))
    per = rows.groupBy("version_id").agg(F.bool_or("selected").alias("selected"), F.count("*").alias("n"))
    versions = per.agg(F.count("*").alias("discovered_versions"), F.count_if("selected").alias("selected_versions"), F.coalesce(F.sum("n"), F.lit(0)).alias("memberships"))
    done = rows.agg(F.count_distinct("process_id").alias("processes"), F.count_distinct(F.when(F.col("status") == "COMPLETED", F.col("process_id"))).alias("completed"))
    return versions.join(done)  # one row each


def projected_portfolio(memberships: DataFrame, process_id: str, status: str) -> DataFrame:
    """The portfolio as if one process had another status."""
    other = F.when(F.col("process_id") == process_id, F.lit(status)).otherwise(F.col("status"))
    return portfolio(memberships.withColumn("status", other))


#: Line counts of a unit, and the sums that must hold among them.
COUNTS = ("lines", "in_scope", "out_of_scope", "applicable", "non_executable", "verified", "blocked", "unverified")
SUMS = {"scope_adds_up": ("lines", "in_scope", "out_of_scope"), "applicable_adds_up": ("in_scope", "applicable", "non_executable"), "verified_adds_up": ("applicable", "verified", "blocked", "unverified")}


def line_profile(rows: DataFrame, keys: Sequence[str], disposition: str) -> DataFrame:
    """``(*keys, *COUNTS)`` of lines that have one disposition each; a line without one is in scope and applicable, and nothing else."""
    d = F.coalesce(F.col(disposition), F.lit(""))
    of = {"lines": F.lit(True), "in_scope": d != "out_of_scope", "out_of_scope": d == "out_of_scope", "applicable": ~d.isin("out_of_scope", "non_executable"), "non_executable": d == "non_executable",
        "verified": d == "mapped_verified", "blocked": d == "blocked", "unverified": d == "mapped_unverified"}
    return rows.groupBy(*keys).agg(*[F.count_if(of[c]).alias(c) for c in COUNTS])


def denominators(profile: DataFrame) -> DataFrame:
    """Add a boolean for each of ``SUMS``, and ``reconciled``: all hold and no count is negative. Unknown counts reconcile with nothing."""
    sums = {name: F.coalesce(F.col(whole) == sum((F.col(p) for p in parts[1:]), F.col(parts[0])), F.lit(False)) for name, (whole, *parts) in SUMS.items()}
    natural = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in COUNTS])
    return profile.withColumns(sums).withColumn("reconciled", reduce(lambda a, b: a & b, [F.col(name) for name in sums], natural))


def validation_rollup(programs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row a group over ``(known, meeting, gaps, complete, blocked)`` of its programs.

    ``validated`` counts programs with a validation (``meeting`` known), ``missing`` the known logic beyond what meets the minimum, never
    below zero. A group is complete if it has validated programs, all of them complete, and nothing is blocked.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    have = F.col("meeting").isNotNull()
    done = F.coalesce(F.bool_and(F.when(have, F.coalesce("complete", F.lit(False)))), F.lit(False)) & (total("blocked") == 0)
    out = programs.groupBy(*keys).agg(F.count_if(have).alias("validated"), total("known").alias("known"), total("meeting").alias("meeting"), total("gaps").alias("gaps"), done.alias("complete"))
    return out.withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("known") - F.col("meeting")))


def metrics_long(row: DataFrame) -> DataFrame:
    """``(metric, value)`` of a one-row table as text; null is ``Unknown``."""
    text = row.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in row.columns])
    return text.unpivot([], list(row.columns), "metric", "value")


def wide(*rows: DataFrame) -> DataFrame:
    """One wide row out of several one-row tables."""
    return reduce(lambda a, b: a.join(b), rows)


def gap_spans(gaps: DataFrame, family: str, path: str, line: str) -> DataFrame:
    """``(family, path, spans, n)``: line numbers of a gap family joined into inclusive spans ``a-b``."""
    found = spans(gaps, [family, path], line)
    text = F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    by_first = Window.partitionBy(family, path).orderBy("first")
    every = by_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order already, so that no aggregate keeps its groups
    of_key = {"_texts": F.collect_list(text).over(every), "n": F.sum(F.col("last") - F.col("first") + 1).over(every), "_no": F.row_number().over(by_first)}
    return found.withColumns(of_key).where("_no = 1").select(family, path, F.array_join("_texts", ",").alias("spans"), "n")


def compacted_gaps(gaps: DataFrame, keys: Sequence[str], line: str, sets: Sequence[str], path: str | None = None) -> DataFrame:
    """``(*keys, gaps, *sets, spans)`` of each gap group: how many rows, the distinct values of the ``sets`` columns (sorted) and
    the line numbers as inclusive spans ``path:a-b`` (``a-b`` without ``path``), in order.

    Values are made distinct before they are gathered, so repeated gaps of a hot group cost no memory; nulls name nothing.
    """
    out = gaps.groupBy(*keys).agg(F.count("*").alias("gaps"))
    for c in sets:
        own = gaps.where(F.col(c).isNotNull()).select(*keys, c).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias(c))
        out = out.join(own, list(keys), "left").withColumn(c, F.coalesce(c, F.array().cast(f"array<{dict(gaps.dtypes)[c]}>")))
    where = [path] if path and path not in keys else []
    found = spans(gaps.where(F.col(line).isNotNull()), [*keys, *where], line)
    text = F.concat(*[F.concat(F.col(c).cast("string"), F.lit(":")) for c in where], F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    rows = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*where, "first", text.alias("text")))).alias("_s"))
    out = out.join(rows.select(*keys, F.transform("_s", lambda x: x["text"]).alias("spans")), list(keys), "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<string>")))


def snapshot_hash(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: a hash over all ``key:digest`` lines as a bag, whatever their order.

    Four 60-bit lanes of each line's SHA-256 are summed, so tasks add up partial sums and no task holds the lines.
    """
    line = F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), F.col(digest)), 256)
    lanes = [F.sum(F.conv(F.substring(line, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    sums = rows.agg(F.count("*").cast("string").alias("n"), *lanes)
    return sums.select(F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(4)]), 256).alias("snapshot"))


def overall_status(gaps: DataFrame, blocking: Sequence[str]) -> DataFrame:
    """One row: BLOCKED, PARTIAL or COMPLETE."""
    out = gaps.agg(F.coalesce(F.bool_or(F.col("status").isin(*blocking)), F.lit(False)).alias("_b"), F.count("*").alias("gaps"))
    return out.select(F.when(F.col("_b"), "BLOCKED").when(F.col("gaps") > 0, "PARTIAL").otherwise("COMPLETE").alias("status"), "gaps")


def actions(summary: DataFrame, conditions: Sequence[tuple[Column, str]], limit: int = 3) -> DataFrame:
    """Add ``actions``: the first ``limit`` texts whose condition holds, in order."""
    return summary.withColumn("actions", F.slice(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conditions])), 1, limit))


def coverage_page(rows: DataFrame, order: Sequence[str], limit: int = 250, **wanted: str | None) -> DataFrame:
    """The first rows that have the wanted values (None: any), each with ``matching``, the count of all that have."""
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value) if value is not None else rows
    total = rows.agg(F.count("*").alias("matching"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total))  # the total is one row


def slim(df: DataFrame, lists: Sequence[str], limit: int = 50) -> DataFrame:
    """Long lists cut to ``limit`` items, with ``<name>_total`` and ``<name>_cut`` beside them; other columns stay."""
    extra = {f"{c}_total": F.size(c) for c in lists} | {f"{c}_cut": F.size(c) > limit for c in lists}
    return df.withColumns(extra).withColumns({c: F.slice(c, 1, limit) for c in lists})
