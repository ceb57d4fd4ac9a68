"""The queries of the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import consensus, cutoff, leaks, lookalike, packing, pairs, reading, scannoise, sentences, split
from quern.session import durable, read


def _texts(spark: SparkSession, d: str) -> DataFrame:
    answers = read(spark, d, "answers").select(F.lit("answers").alias("unit_table"), F.col("seq").cast("string").alias("row_key"), F.col("answer").alias("text"))
    chunks = read(spark, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text")).select(F.lit("chunks").alias("unit_table"), F.col("chunk_id").alias("row_key"), "text")
    return answers.unionByName(chunks)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(_texts(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(read(spark, d, "chunks"), read(spark, d, "pipeline_configs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).select("chunk_id").distinct()


def _classes(spark: SparkSession, d: str) -> DataFrame:
    pages = lookalike.lookalike_classes(read(spark, d, "page_records"), "page", "page_key", "text")
    return durable(pages.unionByName(lookalike.lookalike_classes(read(spark, d, "retrieval_results"), "query", "query_id", "normalised_query")))  # digests only


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_classes(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_links(_classes(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    claims, _ = consensus.consensus(read(spark, d, "claim_judgements"))
    return claims.where("n_annotators >= 3").select(*consensus.CLAIM, "verdict")


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read(spark, d, "claim_judgements"))[1]


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(read(spark, d, "claim_judgements")).select("n_claims", "n_votes", F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"), F.round("alpha", 9).alias("alpha"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(read(spark, d, "answers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.noise(read(spark, d, "page_records")).select("page_key", "line_no", "kind").distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.repair(read(spark, d, "page_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_off(read(spark, d, "generation_outputs")).select("gen_id")


def p7_share(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_off_share(read(spark, d, "generation_outputs"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), read(spark, d, "pack_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "pack_targets")
    return packing.pack_report(packing.pack(read(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(read(spark, d, "documents"), read(spark, d, "graded_passages")).select("doc_id", "reading_level")


def p10_grades(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(read(spark, d, "documents"), read(spark, d, "graded_passages"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can say plainly; the others are tested against brute force on small fixtures."""
    over = "SELECT DISTINCT c.chunk_id FROM chunks c LEFT JOIN pipeline_configs k ON k.config_id = coalesce(c.config_id, 1) WHERE length(c.text) > coalesce(k.chunk_size, (SELECT chunk_size FROM pipeline_configs WHERE config_id = 1))"
    clean = r"regexp_replace(regexp_replace(lower(verdict), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"
    alpha = rf"""WITH v AS (SELECT trim(question_id) AS q, trim(condition_id) AS c, claim_index AS i, regexp_replace(lower(trim(annotator)), '[_\s]+', '-', 'g') AS a, {clean} AS v, judged_at, judgement_id FROM claim_judgements),
l AS (SELECT * FROM v WHERE v IN ('supported', 'contradicted', 'not_in_context', 'unverifiable') QUALIFY row_number() OVER (PARTITION BY q, c, i, a ORDER BY judged_at DESC, judgement_id DESC) = 1),
n AS (SELECT q, c, i, v, count(*) AS n FROM l GROUP BY ALL), u AS (SELECT q, c, i, sum(n) AS m, sum(n * (n - 1)) AS same FROM n GROUP BY ALL HAVING sum(n) > 1),
t AS (SELECT count(*) AS n_claims, sum(m)::BIGINT AS n_votes, sum(same / (m - 1)) AS agree FROM u), p AS (SELECT sum(x * (x - 1)) AS pairs FROM (SELECT v, sum(n)::DOUBLE AS x FROM n JOIN u USING (q, c, i) GROUP BY v)),
o AS (SELECT n_claims, n_votes, agree / n_votes AS o, pairs / (n_votes::DOUBLE * (n_votes - 1)) AS e FROM t, p) SELECT n_claims, n_votes, round(o, 9) AS observed, round(e, 9) AS expected, round((o - e) / (1 - e), 9) AS alpha FROM o"""
    return {"p2_found": over, "p4_agreement": alpha}
