"""Exact cosine retrieval, adaptive selection and abstention.

Two plans give the same ranks: expressions inside the JVM (to compare with SQL) and a blocked matrix
product in Arrow batches, for large corpora. Queries are a stated set against all rows; they are
broadcast only below a checked size and otherwise taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.config import RetrievalConfig
from quern.functions import vectors as vx

#: Queries that are held at once: so many vectors are broadcast to a scan of the corpus.
QUERY_BLOCK = 20_000
#: Queries and rows of one matrix product, so that no more than so many scores are held.
TILE_QUERIES, TILE_ROWS = 1_000, 4_000


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", skip_same: bool = False) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank): the k nearest chunks of each query, rank from 0, ties by chunk id.

    An expression plan: the queries, broadcast after a check of their number, meet all rows of the corpus. More
    queries than QUERY_BLOCK are answered by :func:`top_k_blocked`, with the same ranks.
    """
    q = queries.select(F.col(query_id).alias("query_id"), vx.l2_normalise(F.col(vector)).alias("_q"))
    if q.count() > QUERY_BLOCK:
        return top_k_blocked(queries, corpus, k, query_id, chunk_id, vector, skip_same)
    c = corpus.select(F.col(chunk_id).alias("chunk_id"), vx.l2_normalise(F.col(vector)).alias("_c"))
    pairs = c.crossJoin(F.broadcast(q))
    if skip_same:
        pairs = pairs.where(F.col("query_id") != F.col("chunk_id"))
    scored = pairs.select("query_id", "chunk_id", vx.dot(F.col("_q"), F.col("_c")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query, ties by chunk."""
    found = found.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("q").cumcount() < k]


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)


def top_k_blocked(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", skip_same: bool = False) -> DataFrame:
    """The same by matrix products in tiles: each task keeps its k best per query, and these are merged. Ids are of any type.

    Queries beyond QUERY_BLOCK are taken block by block, one scan each. Rows without a vector are passed over.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(chunk_id).alias("chunk_id"), F.col(vector).alias("v"))
    kind = {"query_id": asked.schema["query_id"].dataType, "chunk_id": rows.schema["chunk_id"].dataType, "score": T.DoubleType()}
    schema = T.StructType([T.StructField(name, t) for name, t in kind.items()])
    blocks, merged = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toPandas()  # about QUERY_BLOCK rows
        shared = queries.sparkSession.sparkContext.broadcast((held["query_id"].to_numpy(), _unit(held["v"]) if len(held) else np.zeros((0, 1))))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best = pd.DataFrame({"q": np.zeros(0, np.int64), "chunk_id": np.zeros(0, object), "score": np.zeros(0)})
            for b in batches:
                for at in range(0, len(b) if len(ids) else 0, TILE_ROWS):
                    part = b.iloc[at : at + TILE_ROWS]
                    v, c, news = _unit(part["v"]), part["chunk_id"].to_numpy(), []
                    for lo in range(0, len(ids), TILE_QUERIES):
                        s = q[lo : lo + TILE_QUERIES] @ v.T
                        if skip_same:
                            s[ids[lo : lo + TILE_QUERIES, None] == c[None, :]] = -np.inf
                        floor = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]  # all ties with the k-th stay
                        i, j = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
                        news.append(pd.DataFrame({"q": i + lo, "chunk_id": c[j], "score": s[i, j]}))
                    best = _best(pd.concat([best, *news] if len(best) else news, ignore_index=True), k)
            yield pd.DataFrame({"query_id": ids[best["q"].to_numpy(np.int64)] if len(best) else ids[:0], "chunk_id": best["chunk_id"].to_numpy(), "score": best["score"].to_numpy()})

        one = rows.mapInPandas(scan, schema)
        merged = one if merged is None else merged.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def mark_selected(candidates: DataFrame, cfg: RetrievalConfig | None = None) -> DataFrame:
    """``candidates`` with top_score and selected: above the absolute floor and the share of the top, the first k_max."""
    cfg = cfg or RetrievalConfig()
    top = F.max("score").over(Window.partitionBy("query_id"))
    rows = candidates.withColumn("top_score", top)
    kept = (F.col("score") >= cfg.sim_threshold) & (F.col("score") >= cfg.relative_floor * F.col("top_score"))
    rows = rows.withColumn("_kept", kept)
    w = Window.partitionBy("query_id")
    nth = F.sum(F.col("_kept").cast("int")).over(w.orderBy("rank"))
    selected = F.col("_kept") & (nth <= cfg.k_max)
    if not cfg.abstain_when_empty:
        selected = selected | (~F.max("_kept").over(w) & (F.col("rank") < cfg.k_min))
    return rows.withColumn("selected", selected).drop("_kept")


def retrieval_results(queries: DataFrame, candidates: DataFrame, cfg: RetrievalConfig | None = None, query_id: str = "query_id") -> DataFrame:
    """One row per query: candidates, selected, top_score (NaN without one), k_effective, abstained, abstain_reason."""
    cfg = cfg or RetrievalConfig()
    marked = mark_selected(candidates, cfg)
    extra = [c for c in marked.columns if c not in ("query_id", "top_score", "selected")]
    item = F.struct("rank", *(c for c in extra if c != "rank"))
    per = marked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(item)).alias("candidates"),
        F.sort_array(F.collect_list(F.when(F.col("selected"), item))).alias("selected"),
        F.max("score").alias("top_score"),
    )
    rows = queries.select(F.col(query_id).alias("query_id")).distinct().join(per, "query_id", "left")
    n = F.coalesce(F.size("selected"), F.lit(0))
    reason = F.when(F.col("candidates").isNull(), "empty_index").when(n == 0, "below_similarity_threshold")
    return rows.select("query_id", "candidates", "selected", F.coalesce("top_score", F.lit(float("nan"))).alias("top_score"), F.greatest(n, F.lit(0)).alias("k_effective"), (F.greatest(n, F.lit(0)) == 0).alias("abstained"), reason.alias("abstain_reason"))


def context(selected: Column) -> Column:
    """``[i] (file p.N) text`` of the selected chunks, blank lines between."""
    lines = F.transform(selected, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), c["source_file"], F.lit(" p."), c["page"].cast("string"), F.lit(") "), c["text"]))
    return F.array_join(lines, "\n\n")
