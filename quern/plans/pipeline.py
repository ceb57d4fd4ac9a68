"""The pipeline as DataFrame plans: index building, asking, evaluation runs and result tables."""

from __future__ import annotations

import dataclasses
import datetime
import json
import platform
import subprocess
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.config import MetricConfig, PipelineConfig
from quern.functions import overlap as ov
from quern.functions import ranking as rk
from quern.functions import text as tx
from quern.operators import benchmark, chunking, log, ocr, retrieval, stats
from quern.plans import prompts
from quern.session import durable
from quern.sources import io
from quern.sources.encoders import Encoder
from quern.sources.generators import generate
from quern.sources.tables import Table, cell


def build_index(spark: SparkSession, cfg: PipelineConfig, encode: Encoder, pages: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The indexed chunks: loaded if the saved ones were built alike, else pages to chunks to vectors to disk."""
    if not force:
        try:
            return io.load_index(spark, cfg.index_dir, cfg.fingerprint)
        except (FileNotFoundError, ValueError):
            pass
    pages = pages if pages is not None else io.read_pages(spark, cfg.data_dir, cfg.ingest)
    chunks = chunking.chunk_pages(pages, cfg.chunk)
    if chunks.isEmpty():
        raise RuntimeError("no text to index")
    io.save_index(encode(chunks, "text"), cfg.index_dir, cfg, {"config": cfg.to_dict(), "ingest_summary": ocr.ingest_summary(pages).first().asDict()})
    return io.load_index(spark, cfg.index_dir, cfg.fingerprint)


def ask(questions: DataFrame, index: DataFrame, cfg: PipelineConfig, encode: Encoder, language_guard: bool = True, k: int | None = None, repeats: int | None = None) -> DataFrame:
    """Answers to questions (question_id, question): status, answer, selected and candidate chunks, prompt, generation, sources.

    Questions in another script are turned away before any other work; those without support
    abstain before generation. Each branch is filtered first, so that no model is called in vain.
    With repeats there are so many rows a question, numbered in ``repeat``: each has its own generation, retrieval is shared.
    All questions are retrieved for at once, so retrieval_latency_s is the time this took over their number.
    """
    rows = questions.withColumn("_ok", tx.is_mostly(F.coalesce(F.col("question"), F.lit(""))) if language_guard else F.lit(True))
    turned = rows.where(~F.col("_ok")).drop("_ok").withColumns({"status": F.lit("rejected_language"), "answer": F.lit(prompts.OTHER_LANGUAGE)})
    rows = rows.where("_ok").drop("_ok")
    turned = _repeated(turned, repeats)
    if not cfg.use_retrieval:
        plain = rows.withColumn("prompt", prompts.build_prompt(F.col("question"), F.lit(None).cast("string")))
        return _generated(_repeated(plain, repeats), cfg).unionByName(turned, allowMissingColumns=True)
    rcfg = cfg.retrieval if k is None else dataclasses.replace(cfg.retrieval, k_max=k)
    began = time.perf_counter()
    asked = durable(encode(rows.select("question_id", tx.normalise(F.col("question"), cfg.ingest.unicode_form).alias("normalised_query")), "normalised_query"))
    found = retrieval.top_k_blocked(asked, index, rcfg.k_max, "question_id", "chunk_id").join(index.select("chunk_id", "source_file", "page", "used_ocr", "text"), "chunk_id")
    results = durable(retrieval.retrieval_results(asked, found, rcfg, "question_id").withColumnRenamed("query_id", "question_id"))
    each = (time.perf_counter() - began) / max(asked.count(), 1)
    results = results.withColumn("retrieval_latency_s", F.lit(each))
    rows = _repeated(rows.join(results, "question_id"), repeats)
    silent = rows.where("abstained").withColumns({"status": F.lit("abstained"), "answer": F.lit(prompts.ABSTENTION)})
    spoken = rows.where("NOT abstained").withColumn("context", retrieval.context(F.col("selected")))
    spoken = _generated(spoken.withColumn("prompt", prompts.build_prompt(F.col("question"), F.col("context"))), cfg)
    source = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), tx.citation(c["source_file"], c["page"]).alias("citation"), c["page"].alias("page"), c["source_file"].alias("source_file"), c["score"].alias("score"), c["used_ocr"].alias("used_ocr"), c["text"].alias("text"))
    out = spoken.unionByName(silent, allowMissingColumns=True).unionByName(turned, allowMissingColumns=True)
    return out.withColumn("sources", F.transform("selected", source))


def _repeated(rows: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return rows
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(n).select(F.col("id").cast("int").alias("repeat"))))


def _generated(rows: DataFrame, cfg: PipelineConfig) -> DataFrame:
    done = generate(rows, cfg.generation)
    return done.withColumns({"status": F.when(F.col("generation.error").isNotNull(), "error").otherwise("ok"), "answer": F.col("generation.text")})


def run_condition(questions: DataFrame, index: DataFrame, cfg: PipelineConfig, encode: Encoder, metrics: MetricConfig | None = None, candidate_k: int | None = None, scorer=None, number: int = 0) -> DataFrame:
    """The records of one condition in the RECORD schema: repeats by questions, answered and scored. questions have the QUESTION schema.

    seq follows repeat and question; ``number`` (of the condition) puts those of later conditions behind. ``scorer`` is a
    loader for :func:`overlap.external_scores`; without one the bert columns are null.
    """
    answered = ask(questions.select("question_id", "question"), index, cfg, encode, k=candidate_k, repeats=max(1, cfg.generation.num_repeats))
    rows = durable(questions.join(answered.drop("question"), "question_id"))
    keys = ["question_id", "repeat"]
    scored = rows.where(F.col("answerable") & (F.length(F.trim("answer")) > 0) & (F.size("references") > 0))
    out = rows.join(ov.best_over_references(scored, keys, "answer", "references", metrics), keys, "left")
    if scorer is not None:
        out = out.join(ov.external_scores(scored, keys, "answer", "references", scorer), keys, "left")
    own = {"condition": F.lit(cfg.condition_id), "model": F.lit(cfg.generation.model), "provider": F.lit(cfg.generation.provider), "use_retrieval": F.lit(cfg.use_retrieval)}
    own |= {"is_local": F.col("generation.is_local"), "generation_latency_s": F.coalesce("generation.latency_s", F.lit(0.0))}
    if cfg.use_retrieval:
        pages_first = (F.size("gold_pages") > 0) & F.col("source_file").isNotNull()
        gold = rk.gold_ids(F.col("source_file"), F.col("gold_pages"), F.col("gold_chunk_ids"))
        ids = lambda c: F.when(pages_first, rk.retrieved_ids(F.col(c), True)).otherwise(rk.retrieved_ids(F.col(c), False))
        known = rows.withColumns({"_gold": gold, "_got": ids("candidates"), "_kept": ids("selected")}).where((F.size("_gold") > 0) & F.col("_got").isNotNull())
        ranked = rk.reported_names(rk.score_retrieval(known.select(*keys, "_gold", "_got", rk.evidence_hit(F.col("_kept"), F.col("_gold")).alias("evidence_hit")), "_got", "_gold").drop("_gold", "_got"))
        backed = rows.where((F.size("selected") > 0) & (F.length(F.trim("answer")) > 0)).withColumn("_context", retrieval.context(F.col("selected")))
        out = out.join(ranked, keys, "left").join(ov.support(backed, keys, "answer", "_context"), keys, "left")
        shown = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), F.round(c["score"], 6).alias("score"), c["rank"].alias("rank"), c["source_file"].alias("source_file"), c["page"].alias("page"), c["used_ocr"].alias("used_ocr"), c["text"].alias("text"))
        own |= {"retrieved": F.transform("selected", shown), "top_score": F.when(~F.isnan("top_score"), F.round("top_score", 6)), "retrieval_latency_s": F.coalesce("retrieval_latency_s", F.lit(0.0))}
    else:
        own["retrieval_latency_s"] = F.lit(0.0)
    out = out.withColumns(own).withColumn("total_latency_s", F.col("retrieval_latency_s") + F.col("generation_latency_s"))
    ordered = schemas.conform(out, schemas.RECORD).orderBy("repeat", "question_id")
    return durable(ordered.withColumn("seq", F.lit(number << 52) + F.monotonically_increasing_id()))


def _commit() -> str | None:
    """The commit of the working folder, if it is in a repository."""
    done = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None


def run_conditions(configs: Sequence[PipelineConfig], questions: DataFrame, index: DataFrame, encode: Encoder, path: str, metrics: MetricConfig | None = None, scorer=None) -> None:
    """Runs every condition into one log; the first overwrites, the others append. The run's facts lie beside it."""
    metrics = metrics or MetricConfig()
    facts = benchmark.provenance(questions).first()
    meta = {
        "started_at": datetime.datetime.now(datetime.UTC).isoformat(), "git_commit": _commit(), "python_version": platform.python_version(), "platform": platform.platform(), "config": configs[0].to_dict(), "conditions": [c.condition_id for c in configs],
        "metric_config": dataclasses.asdict(metrics), "bertscore_provenance": {"model": metrics.bertscore_model, "layer": metrics.bertscore_layer, "idf": metrics.bertscore_idf, "rescale_with_baseline": False, "used": scorer is not None}, "benchmark_provenance": facts.asDict(),
    }
    for i, cfg in enumerate(configs):
        io.write_log(run_condition(questions, index, cfg, encode, metrics, scorer=scorer, number=i), path, append=i > 0, meta=meta)


def cells(records: DataFrame, metrics: dict[str, str], by: str, label: str, per_question: bool = True) -> tuple[list[str], dict[str, list]]:
    """Column labels, and per value of ``by`` its cells ``mean [low, high]``; ``--`` where there is no value. Rows are few."""
    known = [m for m in metrics if m in records.columns]
    got = {(r[by], r["metric"]): cell(r["mean"], r["ci_low"], r["ci_high"]) for r in log.intervals(records, known, [by], per_question).collect()} if known else {}
    n = {r[by]: r["n"] for r in records.groupBy(by).agg((F.countDistinct("question_id") if per_question else F.count(F.lit(1))).alias("n")).collect()}
    return [label, "n", *metrics.values()], {k: [n[k], *(got.get((k, m), "--") for m in metrics)] for k in n}


def _quality(records: DataFrame, caption: str, label: str, metrics: dict[str, str]) -> Table:
    columns, rows = cells(records, metrics, "model", "Model")
    return Table(caption, label, columns, [[k, *rows[k]] for k in sorted(rows)])


def _retrieval(records: DataFrame) -> Table:
    rows = log.where(records, use_retrieval=True)
    columns, per = cells(rows.where(F.col("difficulty").isin(*log.TIERS)), log.RANKING, "difficulty", "Tier")
    _, whole = cells(log.where(rows, answerable=True).withColumn("difficulty", F.lit("all (answerable)")), log.RANKING, "difficulty", "Tier")
    return Table("Retrieval against annotated evidence, over the ranked candidates", "tab:retrieval", columns, [[k, *v[k]] for v in (per, whole) for k in (*log.TIERS, "all (answerable)") if k in v])


def _latency(records: DataFrame) -> Table:
    rows = log.where(records, use_retrieval=True)
    columns, per = cells(rows, log.LATENCY, "model", "Model", per_question=False)
    return Table("Latency and answer length per record; local and hosted models can't be compared", "tab:latency", [columns[0], "Deployment", *columns[1:]], [[r.model, r.deployment, *per[r.model]] for r in log.latency_table(records).collect()])


def _signed(x: float) -> str:
    return f"{x:+.3f}"


def _ablation(records: DataFrame, metric: str) -> Table:
    rows = [[r.model, f"{r.mean_a:.3f}", f"{r.mean_b:.3f}", f"{_signed(r.mean_difference)} [{_signed(r.ci_low)}, {_signed(r.ci_high)}]", f"{r.p_adjusted:.4f}", f"{r.cliffs_delta:+.2f} ({r.effect_label})"] for r in stats.rag_ablation(records, metric).orderBy("model").collect()]
    return Table(f"With and without retrieval: {metric}", "tab:rag-ablation", ["Model", "With retrieval", "Without retrieval", "Difference [95% CI]", "Wilcoxon p (Holm)", "Cliff's delta"], rows)


def _significance(records: DataFrame, metric: str) -> Table:
    if log.values(records, metric, use_retrieval=True, answerable=True).isEmpty() or stats.model_pairs(records, metric).isEmpty() and records.select("model").distinct().count() > 1:
        return Table("No comparable data", "tab:significance", ["Note"], [["insufficient data"]])
    rows = [[r.name_a, r.name_b, f"{_signed(r.mean_difference)} [{_signed(r.ci_low)}, {_signed(r.ci_high)}]", f"{r.p_adjusted:.4f}", f"{r.cliffs_delta:+.2f} ({r.effect_label})", "yes" if r.significant else "no"] for r in stats.significance(records, metric).orderBy("name_a", "name_b").collect()]
    return Table(f"Pairs of models: {metric}", "tab:significance", ["Model A", "Model B", "Difference [95% CI]", "p (Holm)", "Cliff's delta", "Significant"], rows)


def build_tables(records: DataFrame, out: str | Path, strict: bool = True, source: str = "", meta: dict | None = None, metric: str | None = None) -> dict[str, Table]:
    """All result tables that the log has records for, written as CSV, LaTeX and Markdown. An inconsistent log is refused if strict.

    Comparisons are of ``metric``: bert_f1 where the log has it, else rouge1_f1. The tables are small and are written by the driver.
    """
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    records = durable(records)
    known = [m for m in log.QUALITY if m in records.columns]
    metric = metric or ("bert_f1" if not log.values(records, "bert_f1").isEmpty() else "rouge1_f1")
    problems = [f"{r.model}: {r.metric} {r.weighted} against {r.overall}" for r in log.consistency(records, known).collect()]
    problems += [f"reference versions {r.versions}, {r.missing} missing" for r in log.version_problems(records).collect()]
    if problems and strict:
        raise ValueError("; ".join(problems))
    tables = {}
    for tier in log.TIERS[:3]:
        rows = log.where(records, difficulty=tier)
        if not rows.isEmpty():
            tables[f"quality_{tier}"] = _quality(log.where(rows, use_retrieval=True), f"Questions of tier {tier}", f"tab:quality-{tier}", log.QUALITY)
    tables["quality_overall"] = _quality(log.where(records, use_retrieval=True, answerable=True), "All answerable questions", "tab:quality-overall", log.QUALITY)
    if not log.values(records, "recall@5").isEmpty():
        tables["retrieval"] = _retrieval(records)
    tables["latency"] = _latency(records)
    if not log.where(records, use_retrieval=False).isEmpty():
        tables["rag_ablation"] = _ablation(records, metric)
    tables["significance"] = _significance(records, metric)
    for name, t in tables.items():
        t.to_csv(out / f"{name}.csv")
        (out / f"{name}.tex").write_text(t.to_latex(), encoding="utf-8")
    (out / "all_tables.tex").write_text("\n\n".join(t.to_latex() for t in tables.values()), encoding="utf-8")
    (out / "all_tables.md").write_text("\n\n".join(t.to_markdown() for t in tables.values()), encoding="utf-8")
    facts = {"source_log": source, "n_records": records.count(), "consistency_problems": problems, "run_metadata": meta or {}, "written_at": datetime.datetime.now(datetime.UTC).isoformat()}
    (out / "provenance.json").write_text(json.dumps(facts, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return tables
