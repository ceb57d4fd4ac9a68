"""Problem 4: one verdict per claim from annotators who disagree.

A confusion matrix per annotator and a posterior per claim are estimated by expectation
maximisation with additive smoothing. Chance-corrected agreement (nominal alpha) is
reported apart from it, from the votes alone.

Results for odd input: rows with a null or meaningless verdict, annotator or claim are no
votes; repeated rows count once; of an annotator's judgements of a claim the latest usable
one counts (equal times: the larger judgement_id); ties of posteriors go to the earlier of
VERDICTS; empty tables give no claim, no annotator and a null agreement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import durable

# The verdicts.
VERDICTS = ("supported", "contradicted", "not_in_context", "unverifiable")
K = len(VERDICTS)
CLAIM = ["question_id", "condition_id", "claim_index"]
SMOOTHING = 0.5
ITERATIONS = 12
TOLERANCE = 1e-3  # the matrices stand still
SALTS = 16  # parts of an annotator's votes where matrices are joined
#: Up to so many annotators their confusion matrices (128 bytes each) are broadcast; beyond, they are joined, with the same result.
MAX_BROADCAST_ANNOTATORS = 100_000


def clean_annotator(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-")


def clean_verdict(c: Column) -> Column:
    """One of VERDICTS, or null."""
    v = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z]+", "_"), r"^_+|_+$", "")
    return F.when(v.isin(*VERDICTS), v)


def votes(judgements: DataFrame) -> DataFrame:
    """Rows (question_id, condition_id, claim_index, annotator, verdict): the vote that counts."""
    rows = judgements.select(
        F.trim("question_id").alias("question_id"), F.trim("condition_id").alias("condition_id"), F.col("claim_index").cast("int").alias("claim_index"),
        clean_annotator(F.col("annotator")).alias("annotator"), clean_verdict(F.col("verdict")).alias("verdict"), "judged_at", "judgement_id",
    )
    return (
        rows.dropna(subset=[*CLAIM, "annotator", "verdict"])
        .groupBy(*CLAIM, "annotator")
        .agg(F.max_by("verdict", F.struct(F.coalesce(F.col("judged_at").cast("double"), F.lit(-1e18)), "judgement_id")).alias("verdict"))
    )


def _posterior(codes: list[np.ndarray], log_theta: np.ndarray, log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the claims; also the flat vote codes and the claim of each."""
    sizes = np.fromiter((len(c) for c in codes), int, len(codes))
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(codes)), sizes)
    score = np.tile(log_prior, (len(codes), 1))
    for k in range(K):
        score[:, k] += np.bincount(owner, log_theta[flat, k], len(codes))
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True), flat, owner


def consensus(judgements: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(posteriors, annotators).

    posteriors: question_id, condition_id, claim_index, n_annotators, verdict, p_<verdict>...
    annotators: annotator, n_votes, accuracy (the estimated chance of the true verdict) and kappa.
    """
    spark = judgements.sparkSession
    v = durable(votes(judgements))
    names = v.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    label = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("int") - 1
    if names.count() > MAX_BROADCAST_ANNOTATORS:
        return _consensus_joined(v.select(*CLAIM, "annotator", label.alias("l")), iterations)
    annotators = [r.annotator for r in names.select("annotator").orderBy("annotator").collect()]
    index = spark.createDataFrame([(a, i) for i, a in enumerate(annotators)], "annotator string, a int")
    claims = durable(v.join(F.broadcast(index), "annotator").groupBy(*CLAIM).agg(F.sort_array(F.collect_list(F.col("a") * K + label)).alias("codes")))
    n = len(annotators) * K
    start = np.full((len(annotators), K, K), 0.3 / (K - 1))
    start[:, range(K), range(K)] = 0.7
    theta, prior = start.transpose(0, 2, 1).reshape(n, K), np.full(K, 1 / K)  # theta[a * K + said, true]
    schema = "code int, " + ", ".join(f"s{k} double" for k in range(K))
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((np.log(theta), np.log(prior)))

        def expect(batches: Iterator[pd.DataFrame], shared=shared, n=n) -> Iterator[pd.DataFrame]:
            total = np.zeros((n + 1, K))
            for b in batches:
                p, flat, owner = _posterior([np.asarray(c) for c in b.codes], *shared.value)
                for k in range(K):
                    total[:n, k] += np.bincount(flat, p[owner, k], n)
                total[n] += p.sum(axis=0)
            yield pd.DataFrame({"code": np.arange(n + 1, dtype="int32"), **{f"s{k}": total[:, k] for k in range(K)}})

        sums = claims.select("codes").mapInPandas(expect, schema).groupBy("code").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(K))).toPandas()
        counts = np.zeros((n + 1, K))
        if len(sums):
            counts[sums.code] = sums[[f"s{k}" for k in range(K)]]
        new = (counts[:n].reshape(-1, K, K) + SMOOTHING) / (counts[:n].reshape(-1, K, K) + SMOOTHING).sum(axis=1, keepdims=True)
        prior = (counts[n] + SMOOTHING) / (counts[n] + SMOOTHING).sum()
        moved = float(np.abs(new.reshape(n, K) - theta).max()) if n else 0.0
        theta = new.reshape(n, K)
        if moved < TOLERANCE:
            break
    final = spark.sparkContext.broadcast((np.log(theta), np.log(prior)))

    def label_claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, *_ = _posterior([np.asarray(c) for c in b.codes], *final.value)
            out = b[CLAIM].assign(n_annotators=[len(c) for c in b.codes], verdict=[VERDICTS[i] for i in p.argmax(axis=1)])
            yield out.assign(**{f"p_{name}": p[:, k] for k, name in enumerate(VERDICTS)})

    posteriors = claims.mapInPandas(label_claims, "question_id string, condition_id string, claim_index int, n_annotators int, verdict string, " + ", ".join(f"p_{x} double" for x in VERDICTS))
    joint = counts[:n].reshape(-1, K, K) if iterations and n else np.zeros((0, K, K))
    rows = []
    for a, c in zip(annotators, joint):
        right, chance = np.trace(c) / c.sum(), float((c.sum(axis=0) * c.sum(axis=1)).sum() / c.sum() ** 2)
        t = theta.reshape(-1, K, K)[len(rows)]
        rows.append((a, round(c.sum()), float((np.diag(t) * prior).sum()), float((right - chance) / (1 - chance)) if chance < 1 else None))
    return posteriors, spark.createDataFrame(rows, "annotator string, n_votes bigint, accuracy double, kappa double")


def _consensus_joined(v: DataFrame, iterations: int) -> tuple[DataFrame, DataFrame]:
    """The same estimate, from the same start by the same stop, for any number of annotators.

    v: votes with their label l. Confusion matrices stay a table and are joined to the votes, salted by
    claim, since one annotator may hold a large part of them.
    """
    ks = range(K)
    salt = F.pmod(F.xxhash64(*CLAIM), F.lit(SALTS)).cast("int")
    v = durable(v.withColumn("salt", salt))
    names = durable(v.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_votes")))
    grid = names.select("annotator", F.explode(F.array(*map(F.lit, ks))).alias("l"))
    theta = grid.select("annotator", "l", *(F.when(F.col("l") == k, 0.7).otherwise(0.3 / (K - 1)).alias(f"t{k}") for k in ks))
    prior, counts = [1 / K] * K, None

    def expect(theta: DataFrame, prior: list[float]) -> DataFrame:
        salted = theta.select("annotator", "l", *(F.log(f"t{k}").alias(f"t{k}") for k in ks), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        per = v.join(salted, ["annotator", "l", "salt"]).groupBy(*CLAIM).agg(F.count(F.lit(1)).cast("int").alias("n_annotators"), *((F.sum(f"t{k}") + F.lit(math.log(prior[k]))).alias(f"s{k}") for k in ks))
        per = per.withColumn("m", F.greatest(*(f"s{k}" for k in ks)))
        total = sum((F.exp(F.col(f"s{k}") - F.col("m")) for k in ks), F.lit(0.0))
        return per.select(*CLAIM, "n_annotators", *((F.exp(F.col(f"s{k}") - F.col("m")) / total).alias(f"p{k}") for k in ks))

    for _ in range(iterations):
        post = durable(expect(theta, prior))
        said = v.join(post, CLAIM).groupBy("annotator", "l").agg(*(F.sum(f"p{k}").alias(f"c{k}") for k in ks))
        counts = durable(grid.join(said, ["annotator", "l"], "left").na.fill(0.0, [f"c{k}" for k in ks]))
        sums = counts.groupBy("annotator").agg(*(F.sum(f"c{k}").alias(f"d{k}") for k in ks))
        new = durable(counts.join(sums, "annotator").select("annotator", "l", *(((F.col(f"c{k}") + SMOOTHING) / (F.col(f"d{k}") + K * SMOOTHING)).alias(f"t{k}") for k in ks)))
        mass = [x or 0.0 for x in post.agg(*(F.sum(f"p{k}") for k in ks)).first()]
        prior = [(m + SMOOTHING) / (sum(mass) + K * SMOOTHING) for m in mass]
        old = theta.withColumnsRenamed({f"t{k}": f"o{k}" for k in ks})
        moved = new.join(old, ["annotator", "l"]).agg(F.max(F.greatest(*(F.abs(F.col(f"t{k}") - F.col(f"o{k}")) for k in ks)))).first()[0] or 0.0
        theta = new
        if moved < TOLERANCE:
            break
    post = expect(theta, prior)
    best = F.greatest(*(f"p{k}" for k in ks))
    verdict = F.coalesce(*(F.when(F.col(f"p{k}") == best, F.lit(VERDICTS[k])) for k in ks))
    posteriors = post.select(*CLAIM, "n_annotators", verdict.alias("verdict"), *(F.col(f"p{k}").alias(f"p_{VERDICTS[k]}") for k in ks))
    own = lambda c, f=lambda x, k: x: F.sum(sum((F.when(F.col("l") == k, f(F.col(f"{c}{k}"), k)).otherwise(0.0) for k in ks), F.lit(0.0)))
    accuracy = theta.groupBy("annotator").agg(own("t", lambda x, k: x * prior[k]).alias("accuracy"))
    total = F.sum(sum((F.col(f"c{k}") for k in ks), F.lit(0.0)))
    by_label = counts.withColumn("row", sum((F.col(f"c{k}") for k in ks), F.lit(0.0)))
    by_label = by_label.join(by_label.groupBy("annotator").agg(*(F.sum(f"c{k}").alias(f"d{k}") for k in ks)), "annotator")
    met = F.sum(F.col("row") * F.coalesce(*(F.when(F.col("l") == k, F.col(f"d{k}")) for k in ks)))
    kappa = by_label.groupBy("annotator").agg((own("c") / total).alias("right"), (met / total / total).alias("chance"))
    kappa = kappa.select("annotator", F.when(F.col("chance") < 1, (F.col("right") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))
    return posteriors, names.join(accuracy, "annotator").join(kappa, "annotator").select("annotator", "n_votes", "accuracy", "kappa")


def agreement(judgements: DataFrame) -> DataFrame:
    """One row: n_claims, n_votes, observed, expected, alpha; over claims with two or more votes."""
    v = votes(judgements)
    per = v.groupBy(*CLAIM).pivot("verdict", list(VERDICTS)).count().na.fill(0)
    m = sum((F.col(x) for x in VERDICTS), F.lit(0))
    per = per.withColumn("m", m).where("m > 1").withColumn("agree", sum((F.col(x) * (F.col(x) - 1) for x in VERDICTS), F.lit(0)) / (F.col("m") - 1))
    tot = per.agg(F.count(F.lit(1)).alias("n_claims"), F.sum("m").alias("n_votes"), F.sum("agree").alias("a"), *(F.sum(x).cast("double").alias(x) for x in VERDICTS))
    big = F.col("n_votes").cast("double")
    observed = F.try_divide(F.col("a"), big)
    expected = F.try_divide(sum((F.col(x) * (F.col(x) - 1) for x in VERDICTS), F.lit(0.0)), big * (big - 1))
    return tot.select("n_claims", "n_votes", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).alias("alpha"))
