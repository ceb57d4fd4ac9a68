"""Ranking metrics of an array of retrieved ids against an array of gold ids.

NaN where there is no gold; repeated ids stay in the window unless ``dedupe`` is asked for, so
gain can exceed its ideal, as the evaluated systems count it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
NAN = float("nan")


def window(retrieved: Column, k: int, dedupe: bool = False) -> Column:
    return F.slice(F.array_distinct(retrieved) if dedupe else retrieved, 1, k) if k > 0 else F.array().cast("array<string>")


def recall(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(window(retrieved, k), gold)) / F.size(F.array_distinct(gold))).otherwise(NAN)


def precision(retrieved: Column, gold: Column, k: int) -> Column:
    """Distinct hits over the length that the window really has."""
    w = window(retrieved, k)
    return F.when(F.size(w) > 0, F.size(F.array_intersect(w, gold)) / F.size(w)).otherwise(0.0)


def hit(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(window(retrieved, k), gold), 1.0).otherwise(0.0)


def mrr(retrieved: Column, gold: Column, k: int | None = None) -> Column:
    """1 over the rank of the first hit, 0 without one; k of 0 or None takes the whole list."""
    w = window(retrieved, k) if k else retrieved
    ranks = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(F.try_divide(F.lit(1.0), F.array_min(ranks).cast("double")), F.lit(0.0))


def ndcg(retrieved: Column, gold: Column, k: int, dedupe: bool = False) -> Column:
    w = window(retrieved, k, dedupe)
    gains = F.transform(w, lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + 2)).otherwise(0.0))
    total = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.size(F.array_distinct(gold)), F.lit(k))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(gold) > 0, F.when(n > 0, total / ideal).otherwise(0.0)).otherwise(NAN)


def evidence_hit(selected: Column, gold: Column) -> Column:
    return F.when(F.size(gold) > 0, F.when(F.arrays_overlap(selected, gold), 1.0).otherwise(0.0)).otherwise(NAN)


def score_retrieval(df: DataFrame, retrieved: str, gold: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """``df`` with name_at_k columns of all metrics; :func:`reported_names` renames them for reports."""
    r, g = F.col(retrieved), F.col(gold)
    metrics = {"recall": recall, "precision": precision, "hit": hit, "mrr": mrr, "ndcg": ndcg}
    return df.select("*", *(f(r, g, k).alias(f"{name}_at_{k}") for k in ks for name, f in metrics.items()))


def reported_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.replace("_at_", "@") for c in df.columns if "_at_" in c})


def gold_ids(file: Column, pages: Column, chunks: Column, use_pages: bool = True) -> Column:
    """Page ids where pages and the file are known, else chunk ids."""
    by_page = F.transform(pages, lambda p: F.concat(file, F.lit("#p"), p.cast("string")))
    known = F.lit(use_pages) & (F.size(pages) > 0) & file.isNotNull()
    return F.when(known, by_page).otherwise(F.coalesce(chunks, F.array().cast("array<string>")))


def retrieved_ids(candidates: Column, use_pages: bool = True) -> Column:
    """Ids of an array of structs (chunk_id, source_file, page); pages may repeat."""
    return F.transform(candidates, lambda c: F.concat(c["source_file"], F.lit("#p"), c["page"].cast("string")) if use_pages else c["chunk_id"])
