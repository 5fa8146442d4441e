"""Lineage: declarations and references from lines, their resolution, closure from roots, cycles and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.components import strong_components
from tallyfold.sources.shared import materialize

MAX_ROUNDS = 1000


def extract(lines: DataFrame, patterns: Sequence[tuple[str, str, str]], key: str = "path", line: str = "line") -> DataFrame:
    """``(key, line_no, relation, kind, name, dynamic)`` for each hit of a pattern table ``(relation, kind, regex)``.

    The first group is the name. Names that hold ``&`` are only known at run time.
    """

    def hits(relation: str, kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(line), F.lit("(?i)" + pattern), F.lit(1)), lambda n: F.struct(F.lit(relation).alias("relation"), F.lit(kind).alias("kind"), F.upper(n).alias("name")))

    rows = lines.select(key, "line_no", F.explode(F.concat(*[hits(*p) for p in patterns])).alias("h")).select(key, "line_no", "h.*")
    return rows.withColumn("dynamic", F.contains("name", F.lit("&")))


#: What refers to what in job, program, map and scheduler sources (relation, kind of the target, pattern).
REFERENCES: tuple[tuple[str, str, str], ...] = (
    ("executes", "program", r"^//\S*\s+EXEC\s+PGM=([A-Z0-9#@$&]+)"),
    ("invokes_proc", "jcl_proc", r"^//\S*\s+EXEC\s+(?:PROC=)?(?!PGM=|PROC=)([A-Z0-9#@$&]+)"),
    ("includes", "jcl_include", r"^//\S*\s+INCLUDE\s+MEMBER=([A-Z0-9#@$&]+)"),
    ("dd_dataset", "dataset", r"^//\S+\s+DD\s+.*\bDSN(?:AME)?=([A-Z0-9#@$&.]+)"),
    ("calls", "program", r"\bCALL\s+['\"]([A-Z0-9#@$-]+)['\"]"),
    ("copies", "copybook", r"\bCOPY\s+([A-Z0-9#@$-]+)"),
    ("sql_includes", "copybook", r"\bEXEC\s+SQL\s+INCLUDE\s+([A-Z0-9#@$_-]+)"),
    ("cics_link", "program", r"\bEXEC\s+CICS\s+(?:LINK|XCTL)\s+PROGRAM\s*\(\s*['\"]([A-Z0-9#@$-]+)['\"]"),
    ("uses_map", "bms_map", r"\bEXEC\s+CICS\s+(?:SEND|RECEIVE)\s+MAP\s*\(\s*['\"]([A-Z0-9#@$-]+)['\"]"),
    ("uses_mapset", "bms_mapset", r"\bMAPSET\s*\(\s*['\"]?([A-Z0-9#@$-]+)"),
    ("schedules_job", "jcl_job", r"\bJOB,\s*JOB=([A-Z0-9#@$]+)"),
    ("uses_mq", "mq_queue", r"\bMQ(?:OPEN|PUT|GET)\s*\(\s*['\"]([A-Z0-9#@$.]+)['\"]"),
    ("sql_table", "db2_table", r"\b(?:FROM|JOIN|INTO|UPDATE)\s+([A-Z][A-Z0-9_]*(?:\.[A-Z][A-Z0-9_]*)?)"),
)
#: What declares what (relation, kind, pattern).
DECLARATIONS: tuple[tuple[str, str, str], ...] = (
    ("declares", "program", r"\bPROGRAM-ID\s*\.\s*([A-Z0-9#@$-]+)"),
    ("declares", "jcl_job", r"^//(\S+)\s+JOB\b"),
    ("declares", "jcl_proc", r"^//(\S+)\s+PROC\b"),
    ("declares", "bms_mapset", r"^(\S+)\s+DFHMSD\b"),
    ("declares", "bms_map", r"^(\S+)\s+DFHMDI\b"),
    ("declares", "db2_table", r"\bCREATE\s+TABLE\s+([A-Z][A-Z0-9_.]*)"),
    ("declares", "mq_queue", r"\bDEFINE\s+Q(?:LOCAL|REMOTE|ALIAS)\s*\(\s*['\"]?([A-Z0-9#@$.]+)"),
)


def candidates(declared: DataFrame, stem: Column | None = None) -> DataFrame:
    """``(kind, name, target)`` under the declared name and, where given, the member stem."""
    own = declared.select("kind", F.upper("name").alias("name"), "target")
    return own if stem is None else own.unionByName(declared.select("kind", F.upper(stem).alias("name"), "target")).distinct()


def resolve(references: DataFrame, declared: DataFrame, utilities: DataFrame | None = None, fallback: DataFrame | None = None, source_kinds: Sequence[str] = ("program", "copybook", "jcl_proc", "jcl_include", "jcl_job")) -> DataFrame:
    """References ``(source, kind, name, dynamic)`` with ``resolution, target, candidates, gap``.

    One candidate resolves; several are ambiguous and resolve to none. Without any, a catalog utility, then exactly one row of
    the ``fallback`` table may answer. ``gap`` is null where something resolved.
    """
    found = declared.groupBy("kind", "name").agg(F.sort_array(F.collect_set("target")).alias("candidates"))
    out = references.join(found, ["kind", "name"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    if utilities is not None:
        out = out.join(utilities.select(F.col("key").alias("name"), F.lit(True).alias("_utility")).distinct(), "name", "left")
    else:
        out = out.withColumn("_utility", F.lit(None).cast("boolean"))
    if fallback is not None:
        more = fallback.groupBy("kind", "name").agg(F.count_distinct("target").alias("_n"), F.min("target").alias("_found"))
        out = out.join(more, ["kind", "name"], "left")
    else:
        out = out.withColumns({"_n": F.lit(None).cast("long"), "_found": F.lit(None).cast("string")})
    n = F.size("candidates")
    out = out.withColumn("resolution", (
        F.when(F.col("dynamic"), "dynamic").when(n > 1, "ambiguous").when(n == 1, "resolved").when(F.col("_utility"), "utility")
        .when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "conflict").otherwise("missing")
    ))
    gap = F.when(F.col("resolution") == "dynamic", "dynamic_unknown").when(F.col("resolution") == "ambiguous", "ambiguous").when(F.col("resolution") == "conflict", "source_conflict")
    gap = gap.when((F.col("resolution") == "missing") & F.col("kind").isin(*source_kinds), "missing").when(F.col("resolution") == "missing", "unverified")
    target = F.when((F.col("resolution") == "resolved") & (n == 1), F.get("candidates", F.lit(0))).when(F.col("resolution") == "resolved", F.col("_found"))
    return out.withColumns({"target": target, "gap": gap}).drop("_utility", "_n", "_found")


#: Kinds that metadata alone may answer, and content kinds without a structural parser.
EXTERNAL_KINDS = ("dataset", "db2_table", "cics_transaction", "ca7_definition", "mq_interface")
UNPARSED_KINDS = ("unknown", "ambiguous", "rexx", "clist", "pli", "assembler")


def answered_outside(resolved: DataFrame, bindings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of ``resolve`` after declared input bindings and catalog metadata have had their say.

    ``bindings`` (``name, location, available``) decide datasets that they name, unless dynamic or ambiguous already: one
    available location resolves, none is ``input_unavailable``, several are ambiguous. ``metadata`` (``kind, name, complete``)
    answers what is missing: ``external``, with the gap ``partial_discovery`` unless every row of the name is complete.
    """
    bound = bindings.groupBy(F.lit("dataset").alias("kind"), "name").agg(F.count_if("available").alias("_n"), F.min(F.when(F.col("available"), F.col("location"))).alias("_at"))
    known = metadata.where(F.col("kind").isin(*EXTERNAL_KINDS)).groupBy("kind", "name").agg(F.every(F.coalesce("complete", F.lit(False))).alias("_whole"))
    out = resolved.join(bound, ["kind", "name"], "left").join(known, ["kind", "name"], "left")
    by_binding = F.col("_n").isNotNull() & ~F.col("resolution").isin("dynamic", "ambiguous")
    by_metadata = F.col("_n").isNull() & (F.col("resolution") == "missing") & F.col("_whole").isNotNull()
    n = F.col("_n")
    resolution = F.when(by_binding, F.when(n == 1, "resolved").when(n == 0, "missing").otherwise("ambiguous")).when(by_metadata, "external").otherwise(F.col("resolution"))
    gap = F.when(by_binding, F.when(n == 0, "input_unavailable").when(n > 1, "ambiguous")).when(by_metadata, F.when(~F.col("_whole"), "partial_discovery")).otherwise(F.col("gap"))
    target = F.when(by_binding, F.when(n == 1, F.col("_at"))).otherwise(F.col("target"))
    return out.withColumns({"resolution": resolution, "gap": gap, "target": target}).drop("_n", "_at", "_whole")


def unparsed(classified: DataFrame, key: str = "path") -> DataFrame:
    """Gap rows ``(kind, name, gap)`` of selected files (``key, kind``) whose content has no structural parser."""
    return classified.where(F.col("kind").isin(*UNPARSED_KINDS)).select(F.lit("source_file").alias("kind"), F.col(key).alias("name"), F.lit("unresolved_parser").alias("gap"))


def with_library(resolved: DataFrame, library: str, path: str) -> DataFrame:
    """Candidates whose path holds every part of the reference's library name."""
    parts = lambda c: F.split(F.upper(c), "[/.]")
    return resolved.where(F.col(library).isNull() | (F.size(F.array_except(parts(F.col(library)), parts(F.col(path)))) == 0))


def merged_nodes(*tables: DataFrame) -> DataFrame:
    """``(id, kind, name, evidence)`` once for each id; evidence is merged."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.groupBy("id").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def merged_edges(*tables: DataFrame) -> DataFrame:
    """``(source, target, kind, evidence)`` once for each key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.groupBy("source", "target", "kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def closure(edges: DataFrame, roots: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """``(id, level)`` of everything reachable from the roots (column ``id``), level 0 for the roots; cycles end by themselves.

    One join of the frontier with the edges for each level; visited nodes are dropped by an anti join. Each round is written
    to the shared folder.
    """
    edges = materialize((edges.where(F.col("kind").isin(*kinds)) if kinds else edges).select("source", "target").distinct())
    visited = materialize(roots.select("id").distinct().withColumn("level", F.lit(0)))
    frontier = visited
    for level in range(1, MAX_ROUNDS):
        reached = frontier.join(edges, frontier["id"] == edges["source"]).select(F.col("target").alias("id")).distinct()
        fresh = materialize(reached.join(visited, "id", "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            return visited
        visited, frontier = visited.unionByName(fresh), fresh
        if level % 16 == 0:  # one table instead of many small ones
            visited = materialize(visited)
    raise RuntimeError(f"the graph is deeper than {MAX_ROUNDS}")


def capped_level(closed: DataFrame, cap: int = 4, limit: int = 56) -> DataFrame:
    """The first nodes in breadth-first order, their level at most ``cap``."""
    return closed.withColumn("level", F.least("level", F.lit(cap))).orderBy("level", "id").limit(limit)


def on_cycle(edges: DataFrame) -> DataFrame:
    """``(id)`` of nodes that reach themselves: the members of the strongly connected components."""
    return strong_components(edges).select("id")


def asset_counts(nodes: DataFrame, gaps: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """``(kind, observed, gaps, inventory, known)``; kinds without an inventory row have a null count."""
    seen = nodes.groupBy("kind").agg(F.count("*").alias("observed"))
    open_gaps = gaps.groupBy("kind").agg(F.count("*").alias("gaps"))
    out = seen.join(open_gaps, "kind", "full").select("kind", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    known = inventory.select("kind", F.col("count").alias("inventory")) if inventory is not None else None
    out = out.join(known, "kind", "left") if known is not None else out.withColumn("inventory", F.lit(None).cast("long"))
    return out.withColumn("known", (F.col("gaps") == 0) & F.col("inventory").isNotNull())


def reverse_links(edges: DataFrame, kinds: Sequence[str], name: str) -> DataFrame:
    """The edges plus, for the given kinds, their reverse under another kind."""
    back = edges.where(F.col("kind").isin(*kinds)).select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(name).alias("kind"))
    return edges.select("source", "target", "kind").unionByName(back).distinct()


def binding_status(bindings: DataFrame) -> DataFrame:
    """``(logical_id, status)``: resolved if exactly one binding is available, else ambiguous or unavailable."""
    n = F.count_if("available")
    return bindings.groupBy("logical_id").agg(F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("input_unavailable").alias("status"))


def qualified(names: DataFrame, tables: DataFrame) -> DataFrame:
    """Names ``TABLE`` or ``SCHEMA.TABLE`` against ``(schema, table)``: ``(name, status, schema)``."""
    parts = F.split(F.upper("name"), "\\.")
    asked = names.select("name", F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("_s"), F.get(parts, F.size(parts) - 1).alias("_t"))
    both = asked.join(tables.select(F.upper("schema").alias("schema"), F.upper("table").alias("_t")).distinct(), "_t", "left")
    both = both.withColumn("_hit", F.when(F.col("_s").isNull() | (F.col("_s") == F.col("schema")), F.col("schema")))
    out = both.groupBy("name").agg(F.count_distinct("_hit").alias("n"), F.min("_hit").alias("schema"))
    return out.select("name", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("schema")).alias("schema"))


def searched_members(names: DataFrame, members: DataFrame, receipts: DataFrame) -> DataFrame:
    """Members ``name`` looked for in libraries: ``(name, status, library, candidates)``.

    ``members`` are listed ``(library, name)``; ``receipts`` ``(library, status)`` say which listings are COMPLETE. Several libraries
    make a name ``ambiguous``. One or none only counts where every listing is whole: else the answer is ``incomplete``, as a capped
    listing may hide another member. An empty table of receipts vouches for nothing.
    """
    whole = receipts.agg(F.coalesce(F.every(F.coalesce(F.col("status") == "COMPLETE", F.lit(False))), F.lit(False)).alias("_whole"))  # one row
    listed = members.select(F.upper("name").alias("_name"), "library").distinct().groupBy("_name").agg(F.count("*").alias("_n"), F.min("library").alias("_first"))
    out = names.select("name").distinct().join(listed, F.upper("name") == F.col("_name"), "left").join(F.broadcast(whole))
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n > 1, "ambiguous").when(~F.col("_whole"), "incomplete").when(n == 1, "resolved").otherwise("missing")
    return out.select("name", status.alias("status"), F.when(status == "resolved", F.col("_first")).alias("library"), n.alias("candidates"))


def manifest_graph(manifest: DataFrame, source_steps: DataFrame, declared: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Edges ``(source, target, kind, target_kind, resolution)`` of manifest rows and what the sources say about their steps.

    ``manifest`` has ``job, step, program, inputs, outputs``; ``source_steps`` ``(job, step, name, kind)`` are the programs and
    procedures that job sources run; ``declared`` ``(kind, name, target)`` what is defined where. A manifest's program is a
    procedure where the job's own source says so, or where only a procedure is declared under its name. Inputs and outputs that
    ``locations`` (``key, location``, compared without case, blanks and punctuation) knows are its locations, others are data of
    unknown readiness.
    """
    job = F.concat(F.lit("manifest_job:"), F.upper("job"))
    edge = lambda target, kind, target_kind, resolution: (job.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), target_kind.alias("target_kind"), resolution.alias("resolution"))
    found = candidates(declared).groupBy("kind", "name").agg(F.count_distinct("target").alias("_n"), F.min("target").alias("_target"))
    answer = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    jobs = manifest.select("job").distinct().withColumns({"kind": F.lit("jcl_job"), "name": F.upper("job")}).join(found, ["kind", "name"], "left")
    selects = jobs.select(*edge(F.coalesce(F.when(F.col("_n") == 1, F.col("_target")), F.col("name")), "selects_job", F.lit("jcl_job"), answer))
    own = source_steps.groupBy(F.upper("job").alias("_job"), F.upper("step").alias("_step"), F.upper("name").alias("name")).agg(F.max("kind").alias("_said"))
    steps = manifest.select("job", F.upper("job").alias("_job"), F.upper("step").alias("_step"), F.upper("program").alias("name")).distinct().join(own, ["_job", "_step", "name"], "left")
    only = found.groupBy("name").agg(F.bool_or(F.col("kind") == "program").alias("_program"), F.bool_or(F.col("kind") == "proc").alias("_proc"))
    steps = steps.join(only, "name", "left")
    kind = F.when(F.coalesce("_proc", F.lit(False)) & ~F.coalesce("_program", F.lit(False)), "proc").otherwise(F.coalesce("_said", F.lit("program")))
    steps = steps.withColumn("kind", kind).join(found, ["kind", "name"], "left")
    runs = steps.select(*edge(F.coalesce(F.when(F.col("_n") == 1, F.col("_target")), F.col("name")), "manifest_step", F.col("kind"), answer))
    data = lambda c, side: manifest.select("job", F.explode(c).alias("value"), F.lit(side).alias("side"))
    used = data("inputs", "input").unionByName(data("outputs", "output"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    if locations is None:
        used = used.withColumn("location", F.lit(None).cast("string"))
    else:
        used = used.withColumn("_key", plain(F.col("value"))).join(locations.select(plain(F.col("key")).alias("_key"), "location").distinct(), "_key", "left")
    where = F.col("location").isNotNull()
    target = F.when(where, F.concat(F.lit("input_location:"), F.upper("location"))).otherwise(F.concat("side", F.lit("_data:"), "value"))
    of = used.select(job.alias("source"), target.alias("target"), F.concat("side", F.lit("_context")).alias("kind"), F.when(where, "input_location").otherwise(F.concat("side", F.lit("_data"))).alias("target_kind"), F.when(where, "declared_location").otherwise("manifest_context").alias("resolution"))
    return selects.unionByName(runs).unionByName(of).distinct()


def merge_sources(known: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newly found files that are not known, and conflicts: the same path with other content.

    Several contents of one new path are all conflicts, with a null ``_known``.
    """
    both = found.join(known.select("path", F.col("sha256").alias("_known")), "path", "left")
    new = both.where("_known is null").dropDuplicates(["path", "sha256"])
    several = new.groupBy("path").agg(F.count("*").alias("_n")).where("_n > 1").select("path")
    conflicts = both.where(F.col("_known") != F.col("sha256")).unionByName(new.join(several, "path", "left_semi"))
    return new.drop("_known").join(several, "path", "left_anti"), conflicts.select("path", "_known", "sha256")


def scoped(files: DataFrame, closed: DataFrame) -> DataFrame:
    """Files with ``selected`` and a reason."""
    used = closed.select(F.col("id").alias("path"), F.lit(True).alias("_used")).distinct()
    out = files.join(used, "path", "left").withColumn("selected", F.coalesce("_used", F.lit(False))).drop("_used")
    return out.withColumn("reason", F.when(F.col("selected"), "reached from a selected job").otherwise("not reached from a selected job"))
