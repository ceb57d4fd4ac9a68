"""Explicit schemas of the entities; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "source_file string, page int, text string, used_ocr boolean, native_chars int, ocr_chars int, ocr_attempted boolean, ocr_rejected boolean, kannada_ratio double, doc_id string"
CHUNK = "chunk_id string, text string, source_file string, page int, used_ocr boolean, char_start int, char_len int, embedding array<float>"
QUESTION = "question_id string, question string, difficulty string, references array<string>, reference_version string, answerable boolean, gold_chunk_ids array<string>, gold_pages array<int>, source_file string, author string, author_independent boolean, validated_by array<string>, notes string"
TRANSCRIPTION = "source_file string, page int, transcription string, transcriber string"
JUDGEMENT = "question_id string, condition string, claim_index int, annotator string, verdict string, cited_chunk_id string, notes string"
GENERATION = "text string, model string, provider string, latency_s double, is_local boolean, prompt_tokens int, completion_tokens int, honoured_settings map<string,boolean>, error string"
_OVERLAP = "rouge1_f1 double, rouge1_precision double, rouge1_recall double, rouge2_f1 double, rougeL_f1 double, rougeL_precision double, rougeL_recall double, meteor double, meteor_f_mean double, meteor_penalty double, meteor_chunks double, chrf double, hyp_tokens double, ref_tokens double, n_references double, bert_precision double, bert_recall double, bert_f1 double"
_RANKING = ", ".join(f"`{m}@{k}` double" for k in (1, 3, 5, 10) for m in ("recall", "precision", "hit", "mrr", "ndcg"))
RECORD = (
    "seq bigint, question_id string, question string, difficulty string, answerable boolean, reference_version string, references array<string>, condition string, model string, provider string, "
    "use_retrieval boolean, repeat int, status string, answer string, retrieval_latency_s double, generation_latency_s double, total_latency_s double, is_local boolean, "
    f"{_OVERLAP}, {_RANKING}, evidence_hit double, k_effective int, top_score double, "
    "retrieved array<struct<chunk_id:string,score:double,rank:int,source_file:string,page:int,used_ocr:boolean,text:string>>, "
    "support_mean double, support_min double, n_sentences double, n_unsupported_sentences double"
)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of a schema, cast; what it lacks is null."""
    fields = T.StructType.fromDDL(ddl).fields
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
