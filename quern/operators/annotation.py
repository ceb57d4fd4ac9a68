"""Sheets for human annotation of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx

# The columns of a sheet, and what stands for the context after an answer's first claim.
COLUMNS = ["question_id", "condition", "model", "claim_index", "question", "claim", "retrieved_context", "citations", "verdict", "annotator", "notes"]
POINTER = "(see first row for this answer)"


def first_answers(log: DataFrame, keys: list[str] | None = None, answer: str = "answer", order: str = "seq") -> DataFrame:
    """The first row with a non-blank answer of each key."""
    keys = keys or ["question_id", "condition"]
    w = Window.partitionBy(*keys).orderBy(order)
    return log.where(F.length(tx.strip(F.col(answer))) > 0).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def claims(answers: DataFrame, context: str = "retrieved_context", form: str | None = "NFC") -> DataFrame:
    """A row per sentence; the first one of an answer carries the context, the others point to it; verdict, annotator and notes are left to fill."""
    rows = answers.select("*", F.posexplode(tx.sentences(F.col("answer"), form)).alias("claim_index", "claim"))
    rows = rows.withColumn("retrieved_context", F.when(F.col("claim_index") == 0, F.col(context)).otherwise(F.lit(POINTER)))
    return rows.withColumns({c: F.lit("") for c in ("verdict", "annotator", "notes")})


def sheet(log: DataFrame, n: int | None = None, seed: int = 20240101) -> DataFrame:
    """The sheet of a log (COLUMNS): the first answer of each question and condition, or a sample of n, cut into claims with their passages."""
    from quern.operators import retrieval

    answers = first_answers(log)
    if n:
        answers = sample(answers, n, seed)
    got = F.coalesce(F.col("retrieved"), F.array().cast(log.schema["retrieved"].dataType))
    rows = answers.withColumns({"retrieved_context": retrieval.context(got), "citations": F.array_join(F.transform(got, lambda c: tx.citation(c["source_file"], c["page"])), "; ")})
    return claims(rows).select(*COLUMNS)


def sample(answers: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows by a seeded order of their keys, the same on any partitioning."""
    key = F.xxhash64(F.lit(seed), F.col("question_id"), F.col("condition"))
    return answers.orderBy(key, "question_id", "condition").limit(n)
