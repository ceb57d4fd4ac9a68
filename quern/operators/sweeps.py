"""Sweeps over retrieval settings: one widest retrieval, then every setting on the same candidates."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.config import ChunkConfig
from quern.functions import ranking as rk
from quern.functions.text import let

# The encoders that are compared by default.
ENCODERS = ("sentence-transformers/paraphrase-multilingual-mpnet-base-v2", "sentence-transformers/LaBSE", "intfloat/multilingual-e5-base", "sentence-transformers/distiluse-base-multilingual-cased-v2")
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(20))


def grid(spark: SparkSession, **axes: Sequence[float]) -> DataFrame:
    """The cross product of a few literal lists, made as one small partition."""
    kinds = [T.DoubleType() if any(isinstance(v, float) for v in values) else T.IntegerType() for values in axes.values()]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(axes, kinds)])
    return spark.createDataFrame(list(itertools.product(*axes.values())), schema).coalesce(1)


def sweep_retrieval(candidates: DataFrame, questions: DataFrame, k_values: Sequence[int] = (1, 3, 5, 10), thresholds: Sequence[float] = (0.0, 0.35, 0.45, 0.55, 0.65, 0.75), floors: Sequence[float] = (0.0, 0.75, 0.85, 0.95)) -> DataFrame:
    """Per setting (k, threshold, relative_floor) the means over answerable questions and the abstention rate.

    candidates: query_id, chunk_id (string), score, rank; questions: query_id, gold array<string>, answerable.
    """
    spark = candidates.sparkSession
    per = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("c"), F.max("score").alias("top"))  # k per query
    rows = questions.join(per, "query_id", "left").crossJoin(F.broadcast(grid(spark, k=k_values, threshold=thresholds, relative_floor=floors)))
    kept = F.filter(F.coalesce("c", F.array().cast("array<struct<rank:int,chunk_id:string,score:double>>")), lambda x: (x["rank"] < F.col("k")) & (x["score"] >= F.col("threshold")) & (x["score"] >= F.col("relative_floor") * F.col("top")))
    def scores(ids: Column) -> Column:
        shared, wanted = F.size(F.array_intersect(ids, F.col("gold"))), F.size(F.array_distinct("gold"))
        gain = F.aggregate(F.transform(ids, lambda x, i: F.when(F.array_contains(F.col("gold"), x), 1.0 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(wanted, F.col("k")), F.lit(1))), lambda i: 1.0 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
        return F.struct((shared / F.greatest(wanted, F.lit(1))).alias("recall"), (shared / F.greatest(F.size(ids), F.lit(1))).alias("precision"), (gain / ideal).alias("ndcg"), F.size(ids).alias("n"))

    can = F.col("answerable") & (F.size("gold") > 0)
    rows = rows.select("k", "threshold", "relative_floor", can.alias("can"), let(F.transform(kept, lambda x: x["chunk_id"]), scores).alias("s"))
    mean = lambda c: F.avg(F.when(F.col("can"), F.col(f"s.{c}"))).alias(c)
    return rows.groupBy("k", "threshold", "relative_floor").agg(mean("recall"), mean("precision"), mean("ndcg"), F.avg("s.n").alias("mean_k"), F.avg((F.col("s.n") == 0).cast("int")).alias("abstention_rate"))


def calibrate_threshold(tops: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Per threshold tp, fp, fn, tn, precision, recall, f1 and best (the highest f1, ties to the lowest threshold).

    tops: query_id, top_score, answerable of a split kept for calibration. Answered means top_score >= threshold.
    ValueError if every question is answerable: nothing then tells a threshold from another.
    """
    if tops.where("NOT answerable").isEmpty():
        raise ValueError("calibration needs at least one unanswerable question")
    rows = tops.crossJoin(F.broadcast(grid(tops.sparkSession, threshold=[float(t) for t in thresholds])))
    answered = F.coalesce(F.col("top_score") >= F.col("threshold"), F.lit(False)) & ~F.isnan("top_score")
    can = F.col("answerable")
    c = rows.groupBy("threshold").agg(F.count_if(answered & can).alias("tp"), F.count_if(answered & ~can).alias("fp"), F.count_if(~answered & can).alias("fn"), F.count_if(~answered & ~can).alias("tn"))
    p, r = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    c = c.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4)})
    return c.withColumn("best", F.row_number().over(Window.orderBy(F.desc("f1"), "threshold")) == 1)  # a row per threshold


def _judged(asked: DataFrame, gold: DataFrame, index: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row of means over questions with gold: ten candidates of each question against its gold ids.

    gold: query_id, gold, by_page. wanted: name of the mean and the metric it is of.
    """
    from quern.operators import retrieval

    known = index.select(F.col("chunk_id"), "source_file", "page")
    top = retrieval.top_k_blocked(asked, index, 10, "query_id", "chunk_id").join(known, "chunk_id")
    per = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "source_file", "page"))).alias("c"))  # ten a question
    rows = gold.join(per, "query_id", "left")
    ids = F.when(F.col("by_page"), rk.retrieved_ids(F.col("c"), True)).otherwise(rk.retrieved_ids(F.col("c"), False))
    scored = rk.score_retrieval(rows.withColumn("retrieved", F.coalesce(ids, F.array().cast("array<string>"))), "retrieved", "gold", (5, 10))
    return scored.agg(*(F.avg(m).alias(name) for name, m in wanted.items()))


def gold_of(questions: DataFrame) -> DataFrame:
    """Rows (query_id, question, gold, by_page) of the answerable questions with annotated evidence; ValueError without any."""
    by_page = (F.coalesce(F.size("gold_pages"), F.lit(0)) > 0) & F.col("source_file").isNotNull()
    gold = rk.gold_ids(F.col("source_file"), F.col("gold_pages"), F.col("gold_chunk_ids"))
    out = questions.where("answerable").select(F.col("question_id").alias("query_id"), "question", gold.alias("gold"), by_page.alias("by_page")).where(F.size("gold") > 0)
    if out.isEmpty():
        raise ValueError("no question has annotated evidence")
    return out


def sweep_chunking(pages: DataFrame, questions: DataFrame, encode: Callable[[DataFrame, str], DataFrame], chunk: ChunkConfig | None = None, sizes: Sequence[int] = (250, 500, 750, 1000), overlaps: Sequence[int] = (0, 50, 100, 200)) -> DataFrame:
    """Rows (chunk_size, chunk_overlap, n_chunks, recall@5, precision@5, ndcg@5, hit@5): the index is built anew for each setting.

    Overlaps that aren't below the size are passed over. A row a setting, of which there are few.
    """
    from quern.operators import chunking
    from quern.session import durable

    gold, out = durable(gold_of(questions)), None
    asked = durable(encode(gold.select("query_id", "question"), "question"))
    for size, overlap in itertools.product(sizes, overlaps):
        if overlap < size:
            index = durable(encode(chunking.chunk_pages(pages, dataclasses.replace(chunk or ChunkConfig(), chunk_size=size, chunk_overlap=overlap)), "text").select("chunk_id", "source_file", "page", "embedding"))
            one = _judged(asked, gold, index, {f"{m}@5": f"{m}_at_5" for m in ("recall", "precision", "ndcg", "hit")})
            one = one.select(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lit(index.count()).alias("n_chunks"), *one.columns)
            out = one if out is None else out.unionByName(one)
    return out


def sweep_encoders(chunks: DataFrame, questions: DataFrame, encoders: dict[str, Callable[[DataFrame, str], DataFrame]]) -> DataFrame:
    """Rows (encoder, dim, recall@5, ndcg@10, mrr@10, note) over encoders by name; one that fails becomes a row with its error."""
    from quern.session import durable

    spark, gold, out = chunks.sparkSession, durable(gold_of(questions)), None
    for name, encode in encoders.items():
        try:
            index = durable(encode(chunks, "text").select("chunk_id", "source_file", "page", "embedding"))
            asked = durable(encode(gold.select("query_id", "question"), "question"))
            one = _judged(asked, gold, index, {"recall@5": "recall_at_5", "ndcg@10": "ndcg_at_10", "mrr@10": "mrr_at_10"})
            one = one.select(F.lit(name).alias("encoder"), F.lit(index.agg(F.max(F.size("embedding"))).first()[0]).cast("int").alias("dim"), *one.columns, F.lit("").alias("note"))
        except Exception as e:  # noqa: BLE001
            one = spark.createDataFrame([(name, f"failed: {e}")], "encoder string, note string")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def retrieval_scores(candidates: DataFrame, gold: DataFrame, ks: Sequence[int] = rk.KS) -> DataFrame:
    """One row per query: retrieved ids in rank order and all ranking metrics. gold: query_id, gold."""
    per = candidates.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")).alias("retrieved"))
    rows = gold.join(per, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    return rk.score_retrieval(rows, "retrieved", "gold", tuple(ks))
