"""Windows: context carried along, spans, witnesses, budgets and exact global ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.sources.shared import materialize


def carry_forward(df: DataFrame, part: Sequence[str], order: Sequence, value: Column, name: str, reset: Column | None = None) -> DataFrame:
    """Add the last non-null ``value`` so far; where ``reset`` holds the context becomes empty (null)."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(reset, F.struct(F.lit(None).cast("string").alias("v"))) if reset is not None else None
    held = F.when(value.isNotNull(), F.struct(value.cast("string").alias("v"))) if reset is not None else value
    if marked is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    return df.withColumn(name, F.last(F.coalesce(marked, held), ignorenulls=True).over(w)["v"])


def spans(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Runs of consecutive numbers: ``(*keys, first, last)``. Repeated numbers count once; null numbers make one run of nulls.

    Rows are sorted once; a run is the rows at its two ends, so that nothing is gathered but the sort's own rows.
    """
    w = Window.partitionBy(*keys).orderBy(n)
    rows = df.select(*keys, n).distinct()
    starts = F.coalesce(F.col(n) - F.lag(n).over(w) > 1, F.lit(True))
    ends = F.coalesce(F.lead(n).over(w) - F.col(n) > 1, F.lit(True))
    rows = rows.withColumns({"_starts": starts, "_ends": ends}).where("_starts or _ends")
    last = F.when(F.col("_ends"), F.col(n)).otherwise(F.lead(n).over(w))
    return rows.withColumn("last", last).where("_starts").select(*keys, F.col(n).alias("first"), "last")


def covers(df: DataFrame, keys: Sequence[str], start: str, end: str, total: Column) -> DataFrame:
    """``(*keys, covered)``: whether the inclusive ranges cover 1..total without a hole."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_hole", F.col(start) > F.coalesce(reach, F.lit(0)) + 1)
    return rows.groupBy(*keys).agg((~F.bool_or("_hole") & (F.max(end) >= F.max(total))).alias("covered"))


def first_witness(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    return first_k(df, keys, order, 1)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows down before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def first_k_states(df: DataFrame, rule: str, state: str, order: str, k: int, seeds: DataFrame | None = None) -> DataFrame:
    """``(rule, state, order)`` of the first k distinct states of each rule. ``seeds`` (rule, state) count towards k."""
    states = df.groupBy(rule, state).agg(F.min(order).alias(order))
    if seeds is None:
        return first_k(states, [rule], [order, state], k)
    held = seeds.select(rule, state).distinct()
    fresh = states.join(held, [rule, state], "left_anti")
    left = fresh.join(held.groupBy(rule).agg(F.count("*").alias("_held")), rule, "left")
    w = Window.partitionBy(rule).orderBy(order, state)
    return left.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") + F.coalesce("_held", F.lit(0)) <= k).drop("_rn", "_held")


def global_rank(df: DataFrame, order: Sequence, name: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """Add an exact rank (from 1) and running sums over the whole order without a single-partition window.

    Rows are range-partitioned and written; what the earlier partitions hold (one row a partition) is added to their place in their
    own. Ranks alone take this one shuffle: rows are written in order, each with its place. For running sums a window runs inside
    each partition. ``sums`` maps new column names to the columns to add up. ``order`` must tell all rows apart, or rows it does
    not tell apart get their ranks in any order.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    if sums:
        placed = materialize(placed)
        w = Window.partitionBy("_part").orderBy(*order)
        place = F.row_number().over(w)
    else:
        at = placed.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))  # the row in its partition
        placed = materialize(at.withColumns({"_run": F.shiftright("_at", 12), "_row": F.col("_at") % 4096}).drop("_at"))  # repeat, so take no room
        place = F.shiftleft("_run", 12) + F.col("_row") + 1
    own = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{s}") for s, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = own.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, place + F.col("_n0"))
    for s, c in sums.items():
        out = out.withColumn(s, F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col(f"_before_{s}"))
    return out.drop("_part", "_run", "_row", "_n0", *[f"_before_{s}" for s in sums])


def prefix_budget(df: DataFrame, order: Sequence, size: str, limit: int) -> DataFrame:
    """The leading rows whose sizes together stay within ``limit``; add ``running``."""
    return global_rank(df, order, "_rank", {"running": size}).where(F.col("running") <= limit).drop("_rank")


def select_under_budget(candidates: DataFrame, rule: str, branch: str, state: str, order: str, k: int, budget: int) -> DataFrame:
    """Witnesses of each (rule, branch), then up to k states of each rule, cut to ``budget``: ``(order, pass, position)``.

    A candidate chosen in both passes counts in the first.
    """
    witnesses = first_witness(candidates, [rule, branch], [order])
    more = first_k_states(candidates, rule, state, order, k, witnesses)
    chosen = witnesses.select(F.col(order).alias("cand"), F.lit(1).alias("pass")).unionByName(more.select(F.col(order).alias("cand"), F.lit(2).alias("pass")))
    unique = chosen.groupBy("cand").agg(F.min("pass").alias("pass"))
    return unique.orderBy("pass", "cand").limit(budget)


def numbered(df: DataFrame, name: str, part: Sequence[str], order: Sequence, pattern: str = "%s_R%03d") -> DataFrame:
    """Add ``id`` such as ``NAME_R001`` in each part."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("id", F.format_string(pattern, F.lit(name), F.row_number().over(w)))


def latest(df: DataFrame, keys: Sequence[str], version: Column, *columns: str) -> DataFrame:
    """The given columns of each key's latest row, without a sort; of equal versions one whole row, the greatest, counts."""
    row = F.struct(*columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(version, row)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def capped_list(df: DataFrame, keys: Sequence[str], item: Column, order: Sequence, limit: int) -> DataFrame:
    """``(*keys, items, truncated)``: at most ``limit`` items in order; groups are cut before they are gathered."""
    rows = first_k(df.withColumn("_item", item), keys, order, limit + 1)
    w = F.sort_array(F.collect_list(F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order], "_item")))
    out = rows.groupBy(*keys).agg(w.alias("_all"))
    return out.select(*keys, F.transform(F.slice("_all", 1, limit), lambda x: x["_item"]).alias("items"), (F.size("_all") > limit).alias("truncated"))
