"""One query per operator over the test tables; :mod:`quern.oracle` has the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas

from quern.config import ChunkConfig, GenerationConfig, IngestConfig, MetricConfig, PipelineConfig, RetrievalConfig
from quern.functions import overlap as ov
from quern.functions import ranking as rk
from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators import annotation, benchmark, chunking, faithfulness, log, ocr, retrieval, stats, sweeps
from quern.plans import pipeline, prompts
from quern.session import checkpoint_dir, durable, read
from quern.sources import io
from quern.sources.tables import Table
from quern.streaming.questions import recent_questions

SELECT = RetrievalConfig(sim_threshold=0.35)
METRICS = ("rouge1_f1", "meteor", "chrf")
REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# retrieval: the queries are the vectors whose id is divisible by 50
def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(s, d, "embeddings")
    return e.where("vec_id % 50 = 0"), e


def _top(s: SparkSession, d: str, k: int) -> DataFrame:
    q, e = _vectors(s, d)
    return retrieval.top_k(q, e, k, "vec_id", "vec_id", skip_same=True)


@query
def cosine_topk(s, d):
    return _top(s, d, 5).select("query_id", "chunk_id", r6("score").alias("score"), "rank")


@query
def cosine_topk_blocked(s, d):
    q, e = _vectors(s, d)
    return retrieval.top_k_blocked(q, e, 5, "vec_id", "vec_id", skip_same=True).select("query_id", "chunk_id", r6("score").alias("score"), "rank")


@query
def l2_normalise(s, d):
    v = vx.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    weighed = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return read(s, d, "embeddings").select("vec_id", F.size(v).alias("n"), r6(weighed).alias("weighed"), r6(vx.norm(v)).alias("norm"))


@query
def adaptive_select(s, d):
    return retrieval.mark_selected(_top(s, d, 5), SELECT).select("query_id", "chunk_id", "rank", "selected")


@query
def abstain_status(s, d):
    q, _ = _vectors(s, d)
    out = retrieval.retrieval_results(q, _top(s, d, 5), SELECT, "vec_id")
    return out.select("query_id", r6("top_score").alias("top_score"), "k_effective", "abstained", "abstain_reason")


def _gold(s: SparkSession, d: str) -> DataFrame:
    q, e = _vectors(s, d)
    own = q.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("g"), "label"), "label").where("query_id <> g")
    return own.groupBy("query_id").agg(F.collect_set(F.col("g").cast("string")).alias("gold"), (F.max("label") < 8).alias("answerable"))


@query
def retrieval_metrics_multi_k(s, d):
    out = sweeps.retrieval_scores(_top(s, d, 10), _gold(s, d).select("query_id", "gold"))
    return rounded(out.drop("gold", "retrieved"))


@query
def grid_sweep(s, d):
    top = _top(s, d, 10).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return rounded(sweeps.sweep_retrieval(top, _gold(s, d), thresholds=(0.0, 0.25, 0.3, 0.35, 0.4, 0.45)))


@query
def evidence_hits(s, d):
    marked = retrieval.mark_selected(_top(s, d, 5), SELECT)
    kept = marked.where("selected").groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("kept"))
    rows = _gold(s, d).join(kept, "query_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    return rows.select("query_id", rk.evidence_hit(F.col("kept"), F.col("gold")).alias("evidence_hit"))


@query
def retrieved_page_ids(s, d):
    found = _top(s, d, 5).select("query_id", F.struct("rank", F.lit("f").alias("source_file"), F.pmod("chunk_id", F.lit(7)).alias("page")).alias("c"))
    per = found.groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return per.select("query_id", F.array_join(rk.retrieved_ids(F.col("c")), ",").alias("ids"))


@query
def calibrate_threshold(s, d):
    tops = _top(s, d, 1).select("query_id", F.col("score").alias("top_score")).join(_gold(s, d).select("query_id", "answerable"), "query_id")
    return sweeps.calibrate_threshold(tops).select(r6("threshold").alias("threshold"), "tp", "fp", "fn", "tn", "best")


# text
@query
def script_ratio_guard(s, d):
    t = F.col("text")
    return read(s, d, "page_records").select("page_key", r6(tx.script_ratio(t)).alias("ratio"), tx.is_mostly(t).alias("ok"))


@query
def normalise_text(s, d):
    return read(s, d, "page_records").select("page_key", F.md5(tx.normalise(F.col("text"))).alias("digest"))


@query
def metric_tokens(s, d):
    toks = tx.tokens(F.col("answer"))
    return read(s, d, "answers").where("answer IS NOT NULL").select("seq", F.size(toks).alias("n"), F.md5(F.array_join(toks, " ")).alias("digest"))


@query
def metric_tokens_without_numerals(s, d):
    return read(s, d, "answers").where("answer IS NOT NULL").select("seq", F.md5(F.array_join(tx.tokens(F.col("answer"), keep_numerals=False), " ")).alias("digest"))


@query
def char_ngrams(s, d):
    g = tx.character_ngrams(F.col("q"), 4, None)
    rows = read(s, d, "answers").where("answer IS NOT NULL").select("seq", tx.composed(F.col("answer")).alias("q"))
    return rows.select("seq", g.alias("g")).select("seq", F.size("g").alias("n"), F.md5(F.array_join("g", " ")).alias("digest"))


@query
def sentence_split(s, d):
    rows = read(s, d, "answers").where("answer IS NOT NULL").select("seq", tx.sentences(F.col("answer")).alias("p"))
    return rows.select("seq", F.size("p").alias("n"), F.md5(F.array_join("p", "\x1f")).alias("digest"))


@query
def grapheme_clusters(s, d):
    return read(s, d, "answers").where("answer IS NOT NULL").select("seq", F.size(tx.graphemes(F.col("answer"))).alias("n"))


@query
def excerpt_and_citation(s, d):
    return read(s, d, "chunks").select("chunk_id", F.md5(tx.excerpt(F.col("text"))).alias("digest"), tx.citation(F.col("source_file"), F.col("page")).alias("citation")).distinct()


# pages and chunks
@query
def ocr_choice(s, d):
    p = read(s, d, "page_records").where("text IS NOT NULL")
    p = p.select("page_key", F.substring("text", F.lit(1), F.col("native_chars")).alias("native_text"), F.when(F.col("ocr_chars") > 0, F.col("text")).alias("ocr_text"))
    out = ocr.choose_text(p, cfg=IngestConfig(normalise_unicode=False))
    return out.select("page_key", "used_ocr", "ocr_attempted", "ocr_rejected", "native_chars", "ocr_chars", F.md5("text").alias("digest"))


@query
def ingest_summary(s, d):
    return rounded(ocr.ingest_summary(read(s, d, "page_records")))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return ocr.last_of_page(read(s, d, "page_records").where("text IS NOT NULL"), "page_key")


@query
def last_page_wins(s, d):
    return _pages(s, d).select("source_file", "page", "page_key")


@query
def chunk_recursive(s, d):
    return chunking.chunk_pages(_pages(s, d))


@query
def chunk_fixed(s, d):
    out = chunking.chunk_pages(_pages(s, d), ChunkConfig(500, 50), chunking.fixed_pieces(F.col("text"), 500))
    return out.select("chunk_id", "char_start", "char_len", F.md5("text").alias("digest"))


@query
def chunk_length_stats(s, d):
    out = chunking.length_stats(read(s, d, "chunks").where("text IS NOT NULL"))
    return rounded(out)


# overlap of answers with every reference of their question
def _references(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "questions").where(F.size("reference_texts") > 0).groupBy("question_id")
    return q.agg(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("reference_texts"))))).alias("refs"))


def _answered(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "answers").where("answer IS NOT NULL").select("seq", "question_id", "answer").join(_references(s, d), "question_id")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = _answered(s, d).select("seq", "answer", F.posexplode("refs").alias("ref_no", "ref"))
    return rows.select("seq", "ref_no", "answer", "ref", tx.tokens(F.col("answer")).alias("h"), tx.tokens(F.col("ref")).alias("r"))


KEYS = ["seq", "ref_no"]


@query
def rouge_1(s, d):
    return rounded(_pairs(s, d).select(*KEYS, ov.rouge_n(F.col("h"), F.col("r"), 1).alias("x")).select(*KEYS, "x.*"))


@query
def rouge_2(s, d):
    return rounded(_pairs(s, d).select(*KEYS, ov.rouge_n(F.col("h"), F.col("r"), 2).alias("x")).select(*KEYS, "x.*"))


@query
def rouge_l(s, d):
    return rounded(_pairs(s, d).select(*KEYS, ov.rouge_l(F.col("h"), F.col("r")).alias("x")).select(*KEYS, "x.*"))


@query
def meteor_exact(s, d):
    return rounded(ov.meteor_exact(_pairs(s, d), KEYS, "h", "r"))


@query
def meteor_batched(s, d):
    out = _pairs(s, d).select(*KEYS, ov.meteor(F.col("h"), F.col("r")).alias("m"))
    return out.select(*KEYS, F.col("m.matches").cast("bigint").alias("matches"), F.col("m.chunks").cast("bigint").alias("chunks"), r6("m.meteor").alias("meteor"))


@query
def meteor_fuzzy(s, d):
    return _pairs(s, d).select(*KEYS, r6(ov.meteor(F.col("h"), F.col("r"), MetricConfig(meteor_fuzzy=0.6))["meteor"]).alias("meteor_fuzzy"))


@query
def chrf(s, d):
    return _pairs(s, d).select(*KEYS, r6(ov.chrf(F.col("h"), F.col("r"))).alias("chrf"))


@query
def ngram_containment(s, d):
    return _pairs(s, d).select(*KEYS, r6(ov.containment(F.array_join("h", ""), F.array_join("r", ""))).alias("containment"))


@query
def support_score(s, d):
    return rounded(ov.support(_pairs(s, d), KEYS, "answer", "ref"))


@query
def best_over_references(s, d):
    return rounded(ov.best_over_references(_answered(s, d), ["seq"], "answer", "refs"))


@query
def external_scores(s, d):
    """A scorer from outside the engine; here the shares of the shorter text in the two lengths."""

    def load():
        def score(hyps: list[str], refs: list[str]) -> list[tuple[float, float, float]]:
            shorter = [min(len(h), len(r)) for h, r in zip(hyps, refs)]
            return [(n / max(len(h), 1), n / max(len(r), 1), 2 * n / max(len(h) + len(r), 1)) for n, h, r in zip(shorter, hyps, refs)]

        return score

    return rounded(ov.external_scores(_answered(s, d), ["seq"], "answer", "refs", load))


# the record log
def _log(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "answers").withColumnRenamed("condition_id", "condition")


@query
def log_filter_values(s, d):
    return log.values(_log(s, d), "chrf", difficulty="hard", is_local=None).select("question_id", r6("chrf").alias("chrf"))


@query
def question_means(s, d):
    return rounded(log.question_means(_log(s, d), "chrf", ["model"], use_retrieval=True))


@query
def quality_overall(s, d):
    return rounded(log.overall_table(_log(s, d), METRICS))


@query
def quality_by_tier(s, d):
    return rounded(log.tier_table(_log(s, d), "medium", METRICS))


@query
def retrieval_table(s, d):
    return rounded(log.retrieval_table(_log(s, d), ("top_score", "k_effective")))


@query
def quality_intervals(s, d):
    """The intervals' bounds depend on the generator of resamples and are tested apart."""
    return rounded(log.intervals(log.where(_log(s, d), answerable=True, use_retrieval=True), METRICS, ["model"]).drop("ci_low", "ci_high"))


@query
def latency_table(s, d):
    rows = _log(s, d).withColumn("total_latency_s", F.col("retrieval_latency_s") + F.col("generation_latency_s"))
    return rounded(log.latency_table(rows.withColumn("hyp_tokens", F.size(tx.tokens(F.coalesce("answer", F.lit(""))))).drop("answer")))


@query
def consistency_reconciled(s, d):
    return rounded(log.reconciled(_log(s, d), METRICS))


@query
def consistency_gate(s, d):
    """A log with questions of a tier that isn't one of the four; models whose mean this changes are reported."""
    odd = _log(s, d).withColumn("difficulty", F.when(F.col("difficulty") == "hard", "bonus").otherwise(F.col("difficulty")))
    return rounded(log.consistency(odd, METRICS))


@query
def version_problems(s, d):
    return log.version_problems(_log(s, d)).select(F.array_join("versions", ",").alias("versions"), "missing")


@query
def distinct_conditions(s, d):
    return log.distinct_sorted(_log(s, d), "condition")


# statistics
@query
def rag_pairs(s, d):
    return rounded(stats.rag_pairs(_log(s, d), "chrf"))


@query
def model_pairs_shared(s, d):
    return rounded(stats.model_pairs(_log(s, d), "chrf"))


@query
def cliffs_delta(s, d):
    p = stats.rag_pairs(_log(s, d), "chrf")
    out = stats.cliffs_delta(p.select("model", F.col("a").alias("value")), p.select("model", F.col("b").alias("value")), ["model"])
    return rounded(out)


@query
def holm_adjustment(s, d):
    p = log.mean_of_means(_log(s, d), ["chrf"], ["condition"]).where("chrf IS NOT NULL").select("condition", F.round(F.col("chrf") / 17, 6).alias("p"))
    return rounded(stats.holm(p, "p", ties=["condition"]))


@query
def paired_comparison(s, d):
    return stats.rag_ablation(_log(s, d), "chrf")


@query
def pairwise_significance(s, d):
    return stats.significance(_log(s, d), "chrf")


@query
def paired_statistics(s, d):
    p = stats.rag_pairs(_log(s, d), "chrf").withColumns({"a": r6("a"), "b": r6("b")})
    diff = p.select("model", r6(F.col("a") - F.col("b")).alias("a"), F.lit(0.0).alias("b"))
    out = stats.signed_ranks(diff, ["model"])
    return out.select("model", "n", r6("w_plus").alias("w_plus"), F.round("t", 4).alias("t"))


@query
def paired_effects(s, d):
    """What of a paired comparison needs no resampling and no distribution."""
    out = stats.paired_comparisons(stats.rag_pairs(_log(s, d), "chrf"), ["model"])
    return rounded(out.select("model", "n_pairs", "mean_a", "mean_b", "mean_difference", "cliffs_delta", "effect_label"))


@query
def pairwise_effects(s, d):
    out = stats.paired_comparisons(stats.model_pairs(_log(s, d), "chrf"), ["name_a", "name_b"])
    return rounded(out.select("name_a", "name_b", "n_pairs", "mean_a", "mean_b", "mean_difference", "cliffs_delta", "effect_label"))


@query
def bootstrap_ci(s, d):
    q = log.question_means(_log(s, d), "chrf", ["model"])
    return stats.bootstrap(q, ["model"], "value", "question_id")


@query
def sample_sizes(s, d):
    """Pages to transcribe for populations as large as the configured chunk sizes, which are six numbers."""
    sizes = read(s, d, "pipeline_configs").select("config_id", "chunk_size").collect()
    rows = [(r.config_id, stats.required_sample_size(), stats.required_sample_size(population=r.chunk_size), stats.paired_sample_size(comparisons=r.config_id)) for r in sizes]
    return s.createDataFrame(rows, "config_id int, plain int, finite int, paired int")


@query
def power_analysis(s, d):
    r = stats.paired_sd(_log(s, d), "chrf").first()
    rows = [] if r is None else [(r.name_a, r.name_b, r.n, round(r.sd, 6), stats.paired_sample_size(sd=r.sd))]
    return s.createDataFrame(rows, "name_a string, name_b string, n bigint, sd double, pairs int")


@query
def bootstrap_means(s, d):
    q = log.question_means(_log(s, d), "chrf", ["model"])
    return rounded(stats.bootstrap(q, ["model"], "value", "question_id").drop("ci_low", "ci_high"))


# faithfulness
@query
def abstention_scores(s, d):
    return rounded(faithfulness.abstention(_log(s, d), by=("model",)))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "claim_judgements").withColumn("verdict", faithfulness.known_verdict(F.col("verdict"))).where("verdict IS NOT NULL")


@query
def human_judgement_rates(s, d):
    return rounded(faithfulness.verdict_rates(_judged(s, d), "condition_id"))


@query
def verdict_problems(s, d):
    return faithfulness.verdict_problems(read(s, d, "claim_judgements")).select("judgement_id", "verdict")


@query
def nominal_alpha(s, d):
    return rounded(faithfulness.nominal_alpha(_judged(s, d), ["question_id", "condition_id", "claim_index"]))


# transcriptions against pages
def _transcriptions(s: SparkSession, d: str) -> DataFrame:
    c = ocr.whole_transcriptions(read(s, d, "chunks").where("used_ocr"))
    return c.unionByName(c.select(F.concat("source_file", F.lit(".missing")).alias("source_file"), "page", "transcription"))


@query
def transcription_join(s, d):
    return ocr.match_transcriptions(_transcriptions(s, d), _pages(s, d))[0].select("source_file", "page", F.length("transcription").alias("ref_len"), F.length("text").alias("hyp_len"))


@query
def transcription_unmatched(s, d):
    return ocr.match_transcriptions(_transcriptions(s, d), _pages(s, d))[1].select("source_file", "page")


@query
def ocr_error_blocks(s, d):
    return rounded(ocr.error_blocks(durable(ocr.error_rates(ocr.match_transcriptions(_transcriptions(s, d), _pages(s, d))[0]).select("used_ocr", "cer", "wer"))))


@query
def word_error_rates(s, d):
    m = ocr.match_transcriptions(_transcriptions(s, d), _pages(s, d))[0]
    return rounded(m.select("source_file", "page", ov.word_error_rate(F.col("text"), F.col("transcription")).alias("wer")))


@query
def ocr_evaluation(s, d):
    return rounded(ocr.evaluate(_transcriptions(s, d), _pages(s, d))["blocks"])


# questions
def _questions(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "questions")


@query
def benchmark_provenance(s, d):
    return rounded(benchmark.provenance(_questions(s, d)).withColumn("versions", F.array_join("versions", ",")))


@query
def benchmark_validate(s, d):
    return benchmark.validate(_questions(s, d))


@query
def benchmark_constraints(s, d):
    """A question set whose rows without version have lost their references and whose rows without author count as answerable."""
    q = _questions(s, d).withColumns({"reference_texts": F.when(F.col("reference_version").isNull(), F.array().cast("array<string>")).otherwise(F.col("reference_texts")), "answerable": F.col("answerable") | F.col("author").isNull()})
    return benchmark.constraint_problems(q, "reference_texts")


@query
def benchmark_selections(s, d):
    q = _questions(s, d)
    return benchmark.by_difficulty(q, "hard").select("question_id", F.lit("hard").alias("selection")).unionByName(benchmark.answerable(q).select("question_id", F.lit("answerable").alias("selection")))


@query
def gold_ids(s, d):
    g = rk.gold_ids(F.col("source_file"), F.col("gold_pages"), F.col("gold_chunk_ids"))
    return _questions(s, d).select("question_id", F.array_join(g, ",").alias("gold")).distinct()


@query
def gold_evidence_join(s, d):
    gold = _questions(s, d).select("question_id", F.explode("gold_chunk_ids").alias("chunk_id")).distinct()
    return gold.join(read(s, d, "chunks").select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_found"))


# composition
@query
def status_routing(s, d):
    ok = tx.is_mostly(F.coalesce(F.col("raw_query"), F.lit("")))
    return read(s, d, "retrieval_results").select("query_id", F.when(~ok, "rejected_language").when(F.col("abstained"), "abstained").otherwise("ok").alias("status"))


def _prompted(s: SparkSession, d: str) -> DataFrame:
    """Each question with all its gold chunks that there are, in order, as context."""
    c = read(s, d, "chunks").groupBy("chunk_id").agg(F.min("source_file").alias("source_file"), F.min("page").alias("page"), F.min("text").alias("text"))
    q = _questions(s, d).groupBy("question_id").agg(F.min("question").alias("question"), F.min("gold_chunk_ids").alias("gold")).where("question IS NOT NULL")
    items = q.select("question_id", F.posexplode("gold").alias("i", "chunk_id")).join(c, "chunk_id")
    held = items.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("i", "source_file", "page", "text"))).alias("selected"))
    q = q.join(held, "question_id", "left")
    return q.withColumn("prompt", prompts.build_prompt(F.col("question"), F.when(F.col("selected").isNotNull(), retrieval.context(F.col("selected")))))


@query
def build_prompt(s, d):
    return _prompted(s, d).select("question_id", F.md5("prompt").alias("digest"))


@query
def echo_answer(s, d):
    return _prompted(s, d).select("question_id", F.md5(prompts.echo(F.col("prompt"))).alias("digest"))


@query
def keep_first_answer(s, d):
    return annotation.first_answers(_log(s, d)).select("question_id", "condition", "seq")


@query
def annotation_claims(s, d):
    a = annotation.first_answers(_log(s, d)).select("question_id", "condition", "answer", F.col("question").alias("context"))
    return annotation.claims(a, "context").select("question_id", "condition", "claim_index", F.md5("claim").alias("digest"), F.col("retrieved_context").alias("context"))


@query
def shared_questions(s, d):
    a = read(s, d, "answers")
    return a.where("use_retrieval").select("question_id").intersect(a.where("NOT use_retrieval").select("question_id"))


@query
def union_of_conditions(s, d):
    a, g = read(s, d, "answers"), read(s, d, "generation_outputs")
    both = a.select("question_id", F.col("condition_id").alias("condition"), "status").unionByName(g.select("question_id", F.col("condition_id").alias("condition")), allowMissingColumns=True)
    return both.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("n_status"))


@query
def recent_queries(s, d):
    q = read(s, d, "retrieval_results").select(F.trim("raw_query").alias("question"), F.col("logged_at").alias("asked_at")).where("question IS NOT NULL AND asked_at IS NOT NULL")
    return recent_questions(q).select("question")


# asking: letters as vectors, which SQL can count, too
LETTERS = "ಅಆಇಈಉಎಒಕಗಚಜಟಡಣತದನಪಬಮಯರಲವಶಸಹಳ"


def letter_counts(df: DataFrame, column: str) -> DataFrame:
    n = F.length(F.col(column))
    return df.withColumn("embedding", F.array(*((n - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))).cast("float") for c in LETTERS)))


@query
def ask_status(s, d):
    """The whole pipeline on every fiftieth query against all chunks, with the echo generator."""
    c = read(s, d, "chunks").where("text IS NOT NULL").groupBy("chunk_id").agg(*(F.min(x).alias(x) for x in ("source_file", "page", "used_ocr", "text")))
    index = durable(letter_counts(c, "text"))
    q = read(s, d, "retrieval_results").where("query_id % 50 = 0 AND raw_query IS NOT NULL").select(F.col("query_id").cast("string").alias("question_id"), F.col("raw_query").alias("question"))
    out = pipeline.ask(q, index, PipelineConfig(generation=GenerationConfig(provider="echo", model="echo"), retrieval=RetrievalConfig(sim_threshold=0.8)), letter_counts)
    return out.select("question_id", "status", r6("top_score").alias("top_score"), "k_effective")


# files: what is written comes back
def _place(s: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


def _records(s: SparkSession, d: str) -> DataFrame:
    return schemas.conform(_log(s, d).withColumnsRenamed({"repeat_no": "repeat"}), schemas.RECORD)


def _shown(records: DataFrame) -> DataFrame:
    return records.select("seq", "question_id", "condition", "repeat", "status", F.md5("answer").alias("digest"), r6(F.when(~F.isnan("chrf"), F.col("chrf"))).alias("chrf"))


@query
def foreign_log(s, d):
    """A log of JSON lines with two meta lines, a blank one and comments of neither."""
    path = _place(s, "log")
    lines = _records(s, d).withColumn("chrf", F.when(~F.isnan("chrf"), F.col("chrf"))).select(F.to_json(F.struct("*")).alias("value"))
    more = s.createDataFrame([('{"_meta": {"run": "first"}}',), ("  ",)], "value string")
    more.unionByName(lines).coalesce(1).write.text(path)
    return _shown(io.read_log(s, path)[0])


@query
def own_log(s, d):
    path, records = _place(s, "records"), _records(s, d)
    io.write_log(records.where("use_retrieval"), path, append=False, meta={"run": 1})
    io.write_log(records.where("NOT use_retrieval"), path, append=True)
    return _shown(io.read_records(s, path)[0])


@query
def saved_index(s, d):
    path, cfg = _place(s, "index"), PipelineConfig()
    io.save_index(read(s, d, "embeddings"), path, cfg)
    return io.load_index(s, path, cfg.fingerprint).select("vec_id", "label", r6(vx.norm(F.col("embedding"))).alias("norm"))


@query
def annotation_sheet(s, d):
    path, records = _place(s, "sheet"), _records(s, d)
    passage = F.struct(F.lit(None).cast("string").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"), F.lit("f").alias("source_file"), F.col("repeat").alias("page"), F.lit(False).alias("used_ocr"), F.col("question").alias("text"))
    sheet = annotation.sheet(records.withColumn("retrieved", F.array(passage)))
    io.write_sheet(sheet, annotation.COLUMNS, path)
    back = s.read.csv(path, header=True, multiLine=True, escape='"')
    return back.select("question_id", "condition", F.col("claim_index").cast("int").alias("claim_index"), F.md5("claim").alias("digest"), F.md5("retrieved_context").alias("context"), "citations")


@query
def ingest_report(s, d):
    path = _place(s, "report")
    io.write_report(read(s, d, "page_records"), path)
    return s.read.json(f"{path}/summary").select("n_pages", "n_ocr_pages", "n_empty_pages", "total_chars")


@query
def transcription_source(s, d):
    path = _place(s, "transcriptions")
    _transcriptions(s, d).withColumn("transcriber", F.lit("a")).write.json(path)
    return io.read_transcriptions(s, path).select("source_file", "page", F.md5("transcription").alias("digest"), "transcriber")


@query
def nonempty_pages(s, d):
    return io.nonempty(read(s, d, "page_records")).select("page_key")


@query
def rendered_tables(s, d):
    t = Table.of(log.overall_table(_log(s, d), METRICS), "Quality", "tab:q", "A note")
    rows = [(kind, i, line) for kind, text in (("markdown", t.to_markdown()), ("latex", t.to_latex())) for i, line in enumerate(text.split("\n"))]
    return s.createDataFrame(rows, "kind string, line_no int, line string")


def queries() -> dict:
    return dict(REGISTRY)


