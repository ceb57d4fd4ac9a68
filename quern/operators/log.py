"""Algebra of the record log: null-safe filters, values without gaps, and mean-of-means tables.

A log is a DataFrame with question_id, model, difficulty, answerable, use_retrieval, repeat and
metric columns, one row per question, condition and repeat. Null and NaN both mean missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tiers in their order, and the reported metrics with their labels.
TIERS = ("easy", "medium", "hard", "unanswerable")
QUALITY = {"rouge1_f1": "ROUGE-1", "rouge2_f1": "ROUGE-2", "rougeL_f1": "ROUGE-L", "meteor": "METEOR", "chrf": "chrF", "bert_precision": "BERTScore P", "bert_recall": "BERTScore R", "bert_f1": "BERTScore F1"}
RANKING = {"recall@1": "R@1", "recall@3": "R@3", "recall@5": "R@5", "precision@5": "P@5", "mrr@10": "MRR@10", "ndcg@10": "nDCG@10", "evidence_hit": "Evidence hit"}
LATENCY = {"retrieval_latency_s": "Retrieval (s)", "generation_latency_s": "Generation (s)", "total_latency_s": "End-to-end (s)", "hyp_tokens": "Answer length (tokens)"}


def col(name: str) -> Column:
    """A column by its whole name: reported metrics have an @ in it."""
    return F.col(f"`{name}`")


def present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def where(log: DataFrame, **criteria: Any) -> DataFrame:
    """Rows equal to every criterion; None equals null and a missing column."""
    for name, value in criteria.items():
        if name in log.columns:
            log = log.where(F.col(name).eqNullSafe(F.lit(value)))
        elif value is not None:
            log = log.where(F.lit(False))
    return log


def values(log: DataFrame, metric: str, **criteria: Any) -> DataFrame:
    """The metric's values that are there, with question_id."""
    if metric not in log.columns:
        return log.where(F.lit(False)).select("question_id", F.lit(None).cast("double").alias(metric))
    return where(log, **criteria).where(present(col(metric).cast("double"))).select("question_id", col(metric))


def question_means(log: DataFrame, metric: str, by: Sequence[str] = (), **criteria: Any) -> DataFrame:
    """Rows (by..., question_id, value): means over repeats and all that isn't told apart."""
    rows = where(log, **criteria).where(present(col(metric).cast("double")))
    return rows.groupBy(*by, "question_id").agg(F.avg(col(metric)).alias("value"))


def mean_of_means(log: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), **criteria: Any) -> DataFrame:
    """Per group the number of questions and each metric's mean of question means, in one pass over the log."""
    rows = where(log, **criteria)
    value = lambda m: F.when(present(col(m).cast("double")), col(m).cast("double"))
    means = rows.groupBy(*by, "question_id").agg(*(F.avg(value(m)).alias(m) for m in metrics))
    return means.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(col(m)).alias(m) for m in metrics))


def tier_table(log: DataFrame, difficulty: str, metrics: Sequence[str], use_retrieval: bool | None = True) -> DataFrame:
    """A row per model for one tier; models without a record in it have none."""
    more = {} if use_retrieval is None else {"use_retrieval": use_retrieval}
    return mean_of_means(log, metrics, ["model"], difficulty=difficulty, **more).orderBy("model")


def overall_table(log: DataFrame, metrics: Sequence[str], use_retrieval: bool | None = True) -> DataFrame:
    """A row per model over the answerable questions."""
    more = {} if use_retrieval is None else {"use_retrieval": use_retrieval}
    return mean_of_means(log, metrics, ["model"], answerable=True, **more).orderBy("model")


def retrieval_table(log: DataFrame, metrics: Sequence[str], tiers: Sequence[str] = TIERS) -> DataFrame:
    """A row per tier in the order given, and one over all answerable questions; models are pooled."""
    rows = where(log, use_retrieval=True)
    order = F.array_position(F.array(*map(F.lit, tiers)), F.col("difficulty")).cast("int")
    per = mean_of_means(rows, metrics, ["difficulty"]).where(F.col("difficulty").isin(*tiers)).withColumn("position", order)
    total = mean_of_means(rows, metrics, answerable=True).select(F.lit("all (answerable)").alias("difficulty"), "n", *map(col, metrics), F.lit(len(tiers) + 1).alias("position"))
    return per.select("difficulty", "n", *map(col, metrics), "position").unionByName(total.where("n > 0")).orderBy("position")


def latency_table(log: DataFrame, seq: str = "seq") -> DataFrame:
    """A row per model over its records with retrieval, not over questions: deployment by the first of them, mean latencies and answer length, local ones first."""
    rows = where(log, use_retrieval=True)
    mean = lambda c: F.avg(F.when(present(col(c).cast("double")), col(c))).alias(c)
    out = rows.groupBy("model").agg(
        F.when(F.coalesce(F.min_by(F.coalesce(F.col("is_local"), F.lit(False)), seq), F.lit(False)), "local").otherwise("hosted API").alias("deployment"),
        F.count(F.lit(1)).alias("n"), *(mean(c) for c in LATENCY if c in log.columns),
    )
    return out.orderBy(F.col("deployment") != "local", "model")


def long_form(log: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., metric, value): a row per record and metric it has a value of."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value")) for m in metrics))
    return log.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.metric", "x.value").where(present(F.col("value")))


def intervals(log: DataFrame, metrics: Sequence[str], by: Sequence[str], per_question: bool = True, order: str = "seq", n_resamples: int | None = None, statistic=None) -> DataFrame:
    """Rows (by..., metric, mean, ci_low, ci_high, std, n): bootstrap intervals of the question means, or of all records.

    Question means are resampled in the order in which the log first has their questions.
    """
    from quern.operators import stats

    rows = long_form(log, metrics, [*by, "question_id", order])
    if per_question:
        rows = rows.groupBy(*by, "metric", "question_id").agg(F.avg("value").alias("value"), F.min(order).alias(order))
    more = {k: v for k, v in (("n_resamples", n_resamples), ("statistic", statistic)) if v is not None}
    return stats.bootstrap(rows, [*by, "metric"], "value", order, **more)


def reconciled(log: DataFrame, metrics: Sequence[str], tiers: Sequence[str] = TIERS) -> DataFrame:
    """Rows (model, metric, weighted, overall): the tiers' question means taken together, and those of all answerable questions.

    Records with retrieval count; a tier's records count whether answerable or not, if the question has an answerable one.
    """
    rows = long_form(where(log, use_retrieval=True), metrics, ["model", "question_id", "difficulty", "answerable"])
    tier = lambda t: F.avg(F.when(F.col("difficulty") == t, F.col("value")))
    per = rows.groupBy("model", "metric", "question_id").agg(F.avg(F.when(F.col("answerable"), F.col("value"))).alias("overall"), F.array_compact(F.array(*map(tier, tiers))).alias("tiers"))
    per = per.where("overall IS NOT NULL").select("model", "metric", "overall", F.size("tiers").alias("n"), F.aggregate("tiers", F.lit(0.0), lambda s, x: s + x).alias("s"))
    return per.groupBy("model", "metric").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("weighted"), F.avg("overall").alias("overall")).where("weighted IS NOT NULL")


def consistency(log: DataFrame, metrics: Sequence[str], tiers: Sequence[str] = TIERS, tolerance: float = 1e-9) -> DataFrame:
    """The rows of :func:`reconciled` whose tiers' mean isn't the overall mean."""
    return reconciled(log, metrics, tiers).where(F.abs(F.col("weighted") - F.col("overall")) > tolerance)


def version_problems(log: DataFrame) -> DataFrame:
    """One row (versions, missing) if answerable records mix reference versions or lack one."""
    rows = where(log, answerable=True)
    one = rows.agg(F.array_sort(F.collect_set("reference_version")).alias("versions"), F.count_if(F.col("reference_version").isNull()).alias("missing"))
    return one.where((F.size("versions") > 1) | (F.col("missing") > 0))


def distinct_sorted(log: DataFrame, column: str) -> DataFrame:
    return log.select(column).distinct().orderBy(column)
