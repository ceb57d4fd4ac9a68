"""The question set: constraints, validation, provenance, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ("easy", "medium", "hard", "unanswerable")


def constraint_problems(questions: DataFrame, references: str = "references") -> DataFrame:
    """Rows (question_id, problem) that break what every question must hold."""
    refs = F.coalesce(F.size(references), F.lit(0)) < 1
    rows = questions.select("question_id", F.when(F.col("answerable") & refs, "answerable without reference").alias("a"), F.when((F.col("difficulty") == "unanswerable") & F.col("answerable"), "unanswerable tier marked answerable").alias("b"))
    return rows.select("question_id", F.explode(F.array_compact(F.array("a", "b"))).alias("problem"))


def validate(questions: DataFrame) -> DataFrame:
    """Rows (question_id, problem): repeated ids, answerable ones without gold or validator, mixed versions."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    twice = questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("question_id", F.lit("duplicate id").alias("problem"))
    found = F.array_compact(F.array(F.when(none("gold_chunk_ids") & none("gold_pages"), "answerable without gold"), F.when(none("validated_by"), "answerable without validator")))
    own = questions.where("answerable").select("question_id", F.explode(found).alias("problem"))
    mixed = questions.agg(F.countDistinct("reference_version").alias("n")).where("n > 1").select(F.lit(None).cast("string").alias("question_id"), F.lit("mixed reference versions").alias("problem"))
    return twice.unionByName(own).unionByName(mixed)


def provenance(questions: DataFrame) -> DataFrame:
    """One row: size, tiers, shares of independent and validated questions, versions."""
    tier = [F.count_if(F.col("difficulty") == t).alias(f"n_{t}") for t in TIERS]
    return questions.agg(
        F.count(F.lit(1)).alias("n"), *tier, F.count_if(F.col("answerable")).alias("n_answerable"),
        F.avg(F.coalesce(F.col("author_independent"), F.lit(False)).cast("int")).alias("independent_fraction"),
        F.avg((F.coalesce(F.size("validated_by"), F.lit(0)) > 0).cast("int")).alias("validated_fraction"),
        F.array_sort(F.collect_set("reference_version")).alias("versions"),
    )


def by_difficulty(questions: DataFrame, difficulty: str) -> DataFrame:
    return questions.where(F.col("difficulty") == difficulty)


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where("answerable")
