"""Review tables: items from several origins, answers checked against them, and credit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = ("Yes", "No", "Not sure")
MAX_ITEMS = 2000


def items(*origins: DataFrame) -> DataFrame:
    """``(id, question, evidence, kind)`` out of tables that may lack some of these columns."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), origins)
    return rows.select("id", "question", "evidence", "kind")


def check_items(rows: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """``(id, violation)``: repeated ids, and one row with a null id if there are too many items."""
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("violation"))
    return twice.unionByName(rows.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit("too many items").alias("violation")))


def read_answers(asked: DataFrame, returned: DataFrame, reviewer: str, longest: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Accepted answers ``(id, answer, correction, actor)`` and violations ``(id, violation)``.

    Every asked item must come back once, with its question untouched. A blank answer is ``Unanswered``.
    """
    twice = returned.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit(True).alias("_twice"))
    a = asked.select("id", F.struct("question", "evidence", "kind").alias("_asked"))
    r = returned.select("id", F.struct("question", "evidence", "kind").alias("_back"), "answer", "correction", "reviewer")
    both = a.join(r, "id", "full").join(twice, "id", "left")
    answer = F.coalesce(F.trim("answer"), F.lit(""))
    checks = {
        "not returned": F.col("_back").isNull(),
        "not asked": F.col("_asked").isNull(),
        "returned twice": F.col("_twice"),
        "question changed": F.col("_asked").isNotNull() & F.col("_back").isNotNull() & ~F.col("_asked").eqNullSafe(F.col("_back")),
        "unknown answer": F.col("_back").isNotNull() & ~answer.isin("", *ANSWERS),
        "correction too long": F.length("correction") > longest,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    both = both.withColumn("_found", found)
    good = both.where(F.size("_found") == 0).select("id", F.when(answer == "", "Unanswered").otherwise(answer).alias("answer"), "correction", F.coalesce("reviewer", F.lit(reviewer)).alias("actor"))
    return good, both.select("id", F.explode("_found").alias("violation")).distinct()


def unresolved(answers: DataFrame) -> DataFrame:
    """Answers other than a plain Yes."""
    return answers.where((F.col("answer") != "Yes") | (F.coalesce(F.trim("correction"), F.lit("")) != ""))


def rule_credit(rules: DataFrame, answers: DataFrame, programs: DataFrame) -> DataFrame:
    """One row ``rules, credited``: answered Yes without correction, in a program that is verified without differences."""
    plain = answers.join(unresolved(answers).select("id"), "id", "left_anti").select("id", F.lit(True).alias("_yes"))
    both = rules.join(plain, "id", "left").join(programs, "program", "left")
    return both.agg(F.count("*").alias("rules"), F.count_if(F.coalesce("_yes", F.lit(False)) & F.coalesce("verified", F.lit(False)) & (F.coalesce("differences", F.lit(1)) == 0)).alias("credited"))


def confirmed_knowledge(rules: DataFrame, answers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New knowledge ``(key, text)`` from plain Yes answers, and conflicts with what is known under the same key."""
    plain = answers.where("answer = 'Yes'").join(unresolved(answers).select("id"), "id", "left_anti")
    fresh = rules.join(plain.select("id"), "id", "left_semi").select(F.sha2(F.concat_ws(":", "program", "id"), 256).alias("key"), "text")
    both = fresh.join(known.select("key", F.col("text").alias("_known")), "key", "left")
    new = both.where("_known is null").select("key", "_known", "text").distinct()
    several = new.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")  # two texts at once are a conflict, too
    conflicts = both.where(F.col("_known") != F.col("text")).select("key", "_known", "text").unionByName(new.join(several, "key", "left_semi"))
    return new.join(several, "key", "left_anti").select("key", "text"), conflicts
