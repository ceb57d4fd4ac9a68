"""Abstention rates, rates of human verdicts and chance-corrected agreement of annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verdicts a judgement may have.
VERDICTS = ("supported", "contradicted", "not_in_context", "unverifiable")
NAN = float("nan")


def known_verdict(verdict: Column) -> Column:
    """One of VERDICTS, however it is written; null for anything else."""
    v = F.regexp_replace(F.regexp_replace(F.lower(verdict), "[^a-z]+", "_"), "^_+|_+$", "")
    return F.when(v.isin(*VERDICTS), v)


def abstention(records: DataFrame, status: str = "status", answerable: str = "answerable", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the four outcomes and others, abstention_recall and false_abstention_rate; a missing ``answerable`` means true.

    Rates over nothing are NaN.
    """
    can = F.coalesce(F.col(answerable), F.lit(True))
    gone = F.coalesce(F.col(status) == "abstained", F.lit(False))
    rows = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~can & gone).alias("correct_abstentions"),
        F.count_if(~can & ~gone).alias("missed_abstentions"),
        F.count_if(can & gone).alias("false_abstentions"),
        F.count_if(can & ~gone).alias("answered"),
    )
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(NAN)
    return rows.withColumn("abstention_recall", rate("correct_abstentions", "missed_abstentions")).withColumn("false_abstention_rate", rate("false_abstentions", "answered"))


def verdict_problems(judgements: DataFrame) -> DataFrame:
    """The rows whose verdict is none of VERDICTS."""
    return judgements.where(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)))


def verdict_rates(judgements: DataFrame, by: str = "condition") -> DataFrame:
    """Per condition n, the share of each verdict, and of contradicted or not_in_context ones (hallucination)."""
    n = F.count(F.lit(1))
    share = lambda *v: F.count_if(F.col("verdict").isin(*v)) / n
    return judgements.groupBy(by).agg(n.alias("n"), *(share(v).alias(f"{v}_rate") for v in VERDICTS), share("contradicted", "not_in_context").alias("hallucination_rate"))


def nominal_alpha(judgements: DataFrame, unit: list[str], verdict: str = "verdict") -> DataFrame:
    """One row (n_units, observed, expected, alpha) over the units with two or more verdicts; NaN where undefined."""
    cells = judgements.where(F.col(verdict).isNotNull()).groupBy(*unit, verdict).agg(F.count(F.lit(1)).alias("c"))
    units = cells.groupBy(*unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    total = units.agg(F.count(F.lit(1)).alias("n_units"), F.sum("m").cast("double").alias("n"), F.sum(F.col("same") / (F.col("m") - 1)).alias("agree"))
    values = cells.join(units.select(*unit), unit, "left_semi").groupBy(verdict).agg(F.sum("c").cast("double").alias("v")).agg(F.sum(F.col("v") * (F.col("v") - 1)).alias("pairs"))
    one = total.crossJoin(values)
    observed, expected = F.try_divide(F.col("agree"), F.col("n")), F.try_divide(F.col("pairs"), F.col("n") * (F.col("n") - 1))
    return one.select("n_units", F.coalesce(observed, F.lit(NAN)).alias("observed"), F.coalesce(expected, F.lit(NAN)).alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(NAN).alias("alpha"))
