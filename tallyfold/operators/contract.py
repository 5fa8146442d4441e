"""Record contracts: fixed layouts, strict types, and checks that return violation rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One field of a layout. ``default`` is zero or blanks unless given."""

    name: str
    kind: str  # integer or string
    width: int
    group: str = ""
    default: int | str | None = None

    @property
    def maximum(self) -> int:
        return 10**self.width - 1

    def filled(self) -> int | str:
        if self.default is not None:
            return self.default if self.kind == "integer" else str(self.default).ljust(self.width)
        return 0 if self.kind == "integer" else " " * self.width


BAD_FIELD_SET = "field set differs from source layout"
BAD_NUMBER = ": invalid unsigned integer"
BAD_TEXT = ": invalid fixed-width string"
NOT_AN_OBJECT = "record must be an object"


def field_error(f: Field, value: Column, right_type: Column | None = None) -> Column:
    """The message of one field, or null. A null value is an error."""
    if f.kind == "integer":
        good, message = value.between(0, f.maximum), f.name + BAD_NUMBER
    else:
        good, message = F.length(value) == f.width, f.name + BAD_TEXT
    if right_type is not None:
        good = right_type & good
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(message))


def status_of(errors: Column) -> Column:
    return F.when(F.size(errors) == 0, "ACCEPT_INPUT").otherwise("REJECT_INPUT")


def validate(df: DataFrame, layout: list[Field]) -> DataFrame:
    """Add ``errors`` (by field name) and ``input_status`` to typed records, in one narrow pass."""
    errors = F.array_compact(F.array(*[field_error(f, F.col(f"`{f.name}`")) for f in sorted(layout, key=lambda f: f.name)]))
    return df.withColumn("errors", errors).withColumn("input_status", status_of(F.col("errors")))


def validate_json(df: DataFrame, raw: str, layout: list[Field]) -> DataFrame:
    """Add ``errors``, ``input_status`` and ``record`` (null when rejected) to records in JSON text.

    Integers must be JSON integers: fractions, booleans, numbers in quotes and numbers beyond 64 bits are errors. A text that
    is no JSON object has the one error ``record must be an object``.
    """
    names = sorted(f.name for f in layout)
    keys = F.json_object_keys(F.col(raw))
    variant = F.try_parse_json(F.col(raw))
    field_set = F.when(F.array_sort(keys) != F.array(*[F.lit(n) for n in names]), F.lit(BAD_FIELD_SET))

    def one(f: Field) -> Column:
        path = f'$["{f.name}"]'
        kind = F.schema_of_variant(F.variant_get(F.col("_v"), path, "variant"))
        wanted = "BIGINT" if f.kind == "integer" else "STRING"
        return field_error(f, F.try_variant_get(F.col("_v"), path, "bigint" if f.kind == "integer" else "string"), kind == wanted)

    checks = [field_set] + [one(f) for f in sorted(layout, key=lambda f: f.name)]
    whole = F.when(keys.isNull() | F.col("_v").isNull(), F.array(F.lit(NOT_AN_OBJECT))).otherwise(F.array_compact(F.array(*checks)))
    out = df.withColumn("_v", variant).withColumn("errors", whole).withColumn("input_status", status_of(F.col("errors")))
    value = lambda f: F.try_variant_get(F.col("_v"), f'$["{f.name}"]', "bigint" if f.kind == "integer" else "string").alias(f.name)
    return out.withColumn("record", F.when(F.size("errors") == 0, F.struct(*[value(f) for f in layout]))).drop("_v")


def split_accepted(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    return validated.where("input_status = 'ACCEPT_INPUT'"), validated.where("input_status = 'REJECT_INPUT'")


def violations(df: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row ``(*keys, violation)`` for each check that holds, in one pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return df.select(*keys, F.explode(found).alias("violation"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_layout(layout: DataFrame) -> DataFrame:
    """``(program, field, violation)`` of a layout table ``(program, grp, field, type, width, default)``."""
    width = F.col("width")
    rows = violations(layout, {
        "width": ~F.when(F.col("type") == "integer", width.between(1, 18)).otherwise(width.between(1, 256)),
        "group": F.col("grp").isNull() | (F.trim("grp") == ""),
        "default": F.when(F.col("type") == "integer", F.length(F.trim("default")) > width).otherwise(F.length("default") > width),
    }, ["program", "field"])
    return rows.unionByName(check_unique(layout, ["program", "field"]).select("program", "field", F.lit("duplicate name").alias("violation")))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """``(process_id, job, step, violation)`` of a manifest ``(process_id, job_order, job, step_order, step, ...)``."""
    rows = violations(manifest, {"job order": ~F.col("job_order").between(1, 1000), "step order": ~F.col("step_order").between(1, 1000)}, ["process_id", "job", "step"])
    none = F.lit(None).cast("string")
    by = lambda keys, what, n: manifest.groupBy("process_id", *keys).agg(n.alias("n")).where("n > 1").select("process_id", what[0].alias("job"), what[1].alias("step"), F.lit(what[2]).alias("violation"))
    folded = F.upper("job").alias("job_key"), F.upper("step").alias("step_key")
    return reduce(DataFrame.unionByName, [
        rows,
        by([folded[0]], (F.col("job_key"), none, "job has several orders"), F.count_distinct("job_order")),
        by(["job_order"], (none, none, "order shared by jobs"), F.count_distinct(folded[0])),
        by([folded[0], "step_order"], (F.col("job_key"), none, "duplicate step order"), F.count("*")),
        by([folded[0], folded[1]], (F.col("job_key"), F.col("step_key"), "duplicate step name"), F.count("*")),
        by([folded[0]], (F.col("job_key"), none, "job names collide"), F.count_distinct("job")),
    ])


def check_domain(rows: DataFrame, key: str, domain: list[str], count: str) -> DataFrame:
    """``(key, violation)``: each name of the domain exactly once, no other, no negative or missing count."""
    known = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    missing = known.join(rows, key, "left_anti").select(key, F.lit("missing").alias("violation"))
    extra = rows.join(F.broadcast(known), key, "left_anti").select(key, F.lit("unknown").alias("violation"))
    negative = rows.where(F.col(count).isNull() | (F.col(count) < 0)).select(key, F.lit("count").alias("violation"))
    return reduce(DataFrame.unionByName, [missing, extra, negative, check_unique(rows, [key]).select(key, F.lit("repeated").alias("violation"))])


def check_aliases(catalog: DataFrame) -> DataFrame:
    """Names or aliases (case folded) that more than one entry of ``(name, aliases)`` claims: ``(alias, names)``."""
    every = catalog.select("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.upper))).alias("alias"))
    return every.groupBy("alias").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def identity_conflicts(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Ids that stand for different content: ``(key, variants)``."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("variants")).where("variants > 1")


def incompatible_fields(layout: DataFrame) -> DataFrame:
    """Fields of chained programs whose type or width differ, or that some program lacks: ``(field, shapes, programs)``."""
    total = layout.agg(F.count_distinct("program").alias("total"))
    by = layout.groupBy("field").agg(F.count_distinct(F.struct("type", "width")).alias("shapes"), F.count_distinct("program").alias("programs"))
    return by.join(F.broadcast(total)).where("shapes > 1 or programs < total").select("field", "shapes", "programs")  # the total is one row


def fill_defaults(df: DataFrame, layout: list[Field]) -> DataFrame:
    """Nulls and absent fields get the layout's default."""
    kind = lambda f: "bigint" if f.kind == "integer" else "string"
    return df.withColumns({f.name: F.coalesce(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(kind(f)), F.lit(f.filled())) for f in layout})


def project_groups(layout: list[Field]) -> dict[str, Column]:
    """A struct Column for each record group."""
    groups: dict[str, list[Field]] = {}
    for f in layout:
        groups.setdefault(f.group, []).append(f)
    return {g: F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields]).alias(g) for g, fields in groups.items()}
