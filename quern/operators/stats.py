"""Statistics of evaluation scores: bootstrap intervals, paired tests, effect sizes, step-down correction.

Wilcoxon p-values are exact (by counting sums of ranks) for up to 25 differences without ties
or zeros, and by the tie-corrected normal approximation otherwise; Student's tail comes from the
incomplete beta function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RESAMPLES, LEVEL, SEED = 10_000, 0.95, 20240101
BLOCK = 1 << 20  # values drawn at a time
EXACT_UP_TO = 25


def interval(values: Sequence[float], n_resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED, statistic=np.mean) -> tuple[float, float, float, float, int]:
    """(statistic, low, high, sample deviation, n) with a percentile bootstrap in the order given; NaN values are left out."""
    v = np.asarray([x for x in values if x is not None and not math.isnan(x)], float)
    if not len(v):
        return (math.nan,) * 4 + (0,)
    if len(v) == 1:
        return float(v[0]), float(v[0]), float(v[0]), 0.0, 1
    rng, rows = np.random.default_rng(seed), max(1, BLOCK // len(v))
    blocks = (min(rows, n_resamples - k) for k in range(0, n_resamples, rows))
    stats = np.concatenate([statistic(v[rng.integers(0, len(v), (m, len(v)))], axis=1) for m in blocks])
    low, high = np.quantile(stats, [(1 - level) / 2, 1 - (1 - level) / 2])
    return float(statistic(v)), float(low), float(high), float(v.std(ddof=1)), len(v)


def bootstrap(df: DataFrame, by: list[str], value: str, order: str, n_resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED, statistic=np.mean) -> DataFrame:
    """Per group (mean, ci_low, ci_high, std, n); ``statistic`` (of values along an axis) stands in for the mean.

    A group's values are question means: bounded by the benchmark.
    """
    schema = df.select(*by).schema.simpleString()[7:-1].replace(":", " ") + ", mean double, ci_low double, ci_high double, std double, n bigint"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mean, low, high, std, n = interval(rows.sort_values(order)[value].tolist(), n_resamples, level, seed, statistic)
        return pd.DataFrame([(*key, mean, low, high, std, n)])

    return df.select(*by, value, order).groupBy(*by).applyInPandas(run, schema)


def describe(df: DataFrame, by: list[str], value: str, order: str, **options) -> DataFrame:
    """Per group mean, std, ci_low and ci_high with four decimals, as reports name them, and n."""
    out = bootstrap(df, by, value, order, **options)
    four = F.udf(lambda x: None if x is None else round(x, 4), T.DoubleType())  # a row per group; Spark's round is another one
    return out.select(*by, *(four(c).alias(c) for c in ("mean", "std", "ci_low", "ci_high")), "n")


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(d.isNull() | F.isnan(d), "undefined").when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def cliffs_delta(a: DataFrame, b: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per group (delta, effect): the share of pairs a > b less that of a < b.

    By ranks in the merged sample, so no pair is formed: counting b below and at each a.
    """
    rows = a.select(*by, F.col(value).alias("v"), F.lit(1).alias("is_a")).unionByName(b.select(*by, F.col(value).alias("v"), F.lit(0).alias("is_a")))
    w = Window.partitionBy(*by).orderBy("v") if by else Window.orderBy("v")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    n_b = F.sum(1 - F.col("is_a"))
    upto = n_b.over(w.rangeBetween(Window.unboundedPreceding, 0))
    at = n_b.over((Window.partitionBy(*by, "v")))
    rows = rows.select(*by, "is_a", (upto - at).alias("below"), (n_b.over(whole) - upto).alias("above"), n_b.over(whole).alias("m"))
    per = rows.where("is_a = 1").groupBy(*by).agg(F.sum(F.col("below") - F.col("above")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    delta = F.col("s") / (F.col("n") * F.col("m"))
    return per.select(*by, delta.alias("delta"), effect_label(delta).alias("effect"))


def wilcoxon(d: Sequence[float]) -> tuple[float, float]:
    """(W+, two-sided p) of the differences, zeros left out."""
    x = np.asarray([v for v in d if v != 0], float)
    n = len(x)
    if n == 0:
        return 0.0, 1.0
    order = np.argsort(np.abs(x), kind="stable")
    size = np.abs(x)[order]
    ranks = np.empty(n)
    ties, i = 0.0, 0
    while i < n:
        j = i
        while j + 1 < n and size[j + 1] == size[i]:
            j += 1
        ranks[order[i : j + 1]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus = float(ranks[x > 0].sum())
    if n <= EXACT_UP_TO and ties == 0 and n == len(list(d)):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        low = min(plus, n * (n + 1) / 2 - plus)
        return plus, min(1.0, float(2 * ways[: int(low) + 1].sum() / 2.0**n))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (plus - n * (n + 1) / 4) / sd if sd else 0.0
    return plus, 2 * NormalDist().cdf(-abs(z))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


COMPARISON = "n_pairs bigint, mean_a double, mean_b double, mean_difference double, ci_low double, ci_high double, wilcoxon_p double, ttest_p double, cliffs_delta double, effect_label string"


def compare(a: Sequence[float], b: Sequence[float], n_resamples: int = RESAMPLES, seed: int = SEED) -> tuple:
    """The fields of COMPARISON for paired values; pairs with a gap are left out."""
    pairs = [(x, y) for x, y in zip(a, b) if x is not None and y is not None and not math.isnan(x) and not math.isnan(y)]
    n = len(pairs)
    if n < 2:
        return (n, *([math.nan] * 8), "undefined")
    x, y = np.array(pairs).T
    d = x - y
    if np.allclose(d, 0):
        p_w = p_t = 1.0
    else:
        p_w = wilcoxon(d)[1]
        sd = d.std(ddof=1)
        p_t = student_p(float(d.mean() / (sd / math.sqrt(n))) if sd else math.inf, n - 1)
    _, low, high, *_ = interval(d.tolist(), n_resamples, LEVEL, seed)
    ys = np.sort(y)
    delta = float((np.searchsorted(ys, x, "left") - (n - np.searchsorted(ys, x, "right"))).sum() / n**2)
    size = abs(delta)
    label = "negligible" if size < 0.147 else "small" if size < 0.33 else "medium" if size < 0.474 else "large"
    return n, float(x.mean()), float(y.mean()), float(d.mean()), low, high, p_w, p_t, delta, label


def paired_comparisons(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", order: str = "question_id", n_resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Per group the fields of COMPARISON. A group holds the question means of one comparison: bounded by the benchmark."""
    schema = pairs.select(*by).schema.simpleString()[7:-1].replace(":", " ") + ", " + COMPARISON

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return pd.DataFrame([(*key, *compare(rows[a].tolist(), rows[b].tolist(), n_resamples, seed))])

    return pairs.select(*by, order, a, b).groupBy(*by).applyInPandas(run, schema)


def holm(df: DataFrame, p: str = "wilcoxon_p", alpha: float = 0.05, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with p_adjusted and significant, step-down over each group; rows without a p-value are left out."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy(*by).orderBy(p, *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    rows = rows.withColumn("_scaled", scaled)
    adjusted = F.max("_scaled").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") <= alpha).drop("_scaled")


def rag_pairs(log: DataFrame, metric: str) -> DataFrame:
    """Rows (model, question_id, a, b): question means of answerable questions with and without retrieval, where both are there."""
    from quern.operators.log import question_means

    q = question_means(log, metric, ["model", "use_retrieval"], answerable=True)
    per = q.groupBy("model", "question_id").agg(F.max(F.when(F.col("use_retrieval"), F.col("value"))).alias("a"), F.max(F.when(~F.col("use_retrieval"), F.col("value"))).alias("b"))
    return per.where("a IS NOT NULL AND b IS NOT NULL")


def model_pairs(log: DataFrame, metric: str, use_retrieval: bool = True) -> DataFrame:
    """Rows (name_a, name_b, question_id, a, b): all pairs of models over the answerable questions that all of them have.

    The pairs are of models, of which there are few; a question meets itself only.
    """
    from quern.operators.log import question_means

    q = question_means(log, metric, ["model"], use_retrieval=use_retrieval, answerable=True)
    n = q.select(F.countDistinct("model").alias("models"))
    shared = q.groupBy("question_id").agg(F.countDistinct("model").alias("m")).join(F.broadcast(n), F.col("m") == F.col("models")).select("question_id")
    q = q.join(shared, "question_id", "left_semi")
    left, right = q.select("question_id", F.col("model").alias("name_a"), F.col("value").alias("a")), q.select("question_id", F.col("model").alias("name_b"), F.col("value").alias("b"))
    return left.join(right, "question_id").where("name_a < name_b").select("name_a", "name_b", "question_id", "a", "b")


def rag_ablation(log: DataFrame, metric: str, n_resamples: int = RESAMPLES) -> DataFrame:
    return holm(paired_comparisons(rag_pairs(log, metric), ["model"], n_resamples=n_resamples).where("n_pairs >= 2"), ties=["model"])


def significance(log: DataFrame, metric: str, n_resamples: int = RESAMPLES) -> DataFrame:
    return holm(paired_comparisons(model_pairs(log, metric), ["name_a", "name_b"], n_resamples=n_resamples).where("n_pairs >= 2"), ties=["name_a", "name_b"])


def required_sample_size(expected: float = 0.12, half_width: float = 0.03, confidence: float = 0.95, population: int | None = None) -> int:
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n = z * z * expected * (1 - expected) / half_width**2
    if population:
        n = n / (1 + (n - 1) / population)
    return max(1, math.ceil(n))


def paired_sample_size(effect: float = 0.05, sd: float = 0.12, power: float = 0.8, alpha: float = 0.05, comparisons: int = 1) -> int:
    """Pairs needed to see an effect; alpha is shared out among the comparisons."""
    z = NormalDist()
    return math.ceil(((z.inv_cdf(1 - alpha / max(comparisons, 1) / 2) + z.inv_cdf(power)) * sd / effect) ** 2)


def paired_sd(log: DataFrame, metric: str) -> DataFrame:
    """One row (name_a, name_b, n, sd): the deviation of the paired differences of the first two models of a log, for a power analysis.

    No row with fewer than two models or three shared questions.
    """
    from quern.operators.log import distinct_sorted, question_means

    first = [r.model for r in distinct_sorted(log, "model").limit(2).collect()]
    if len(first) < 2:
        first = ["", ""]
    q = question_means(log, metric, ["model"], use_retrieval=True, answerable=True)
    per = q.groupBy("question_id").agg(*(F.max(F.when(F.col("model") == m, F.col("value"))).alias(c) for m, c in zip(first, "ab"))).where("a IS NOT NULL AND b IS NOT NULL")
    out = per.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd")).where("n >= 3")
    return out.select(F.lit(first[0]).alias("name_a"), F.lit(first[1]).alias("name_b"), "n", "sd")


def signed_ranks(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Per group n (differences that aren't 0), w_plus, p and t: the paired statistics without intervals.

    A group holds the question means of one comparison: bounded by the benchmark.
    """
    schema = pairs.select(*by).schema.simpleString()[7:-1].replace(":", " ") + ", n bigint, w_plus double, wilcoxon_p double, t double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = (rows[a] - rows[b]).dropna().to_numpy(float)
        plus, p = wilcoxon(d)
        sd = d.std(ddof=1) if len(d) > 1 else math.nan
        return pd.DataFrame([(*key, int((d != 0).sum()), plus, p, float(d.mean() / sd * math.sqrt(len(d))) if sd else math.nan)])

    return pairs.select(*by, a, b).groupBy(*by).applyInPandas(run, schema)
