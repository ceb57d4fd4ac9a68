"""Command line over the library: build, ask, evaluate, tables, ablate, ocr, chunk-stats, annotate, power, serve."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.config import PipelineConfig
from quern.operators import annotation, benchmark, chunking, ocr, retrieval, stats, sweeps
from quern.plans import pipeline
from quern.sources import io
from quern.sources.encoders import hashed_encoder, sentence_encoder
from quern.sources.generators import BACKENDS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--config", help="a saved configuration (JSON)")
    p.add_argument("--encoder", default="sentence", help="sentence, hashed, or module:function that adds the column embedding to (table, text column)")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("build").add_argument("--force", action="store_true")
    one = sub.add_parser("ask")
    one.add_argument("question")
    one.add_argument("--k", type=int)
    one.add_argument("--provider", choices=list(BACKENDS))
    one.add_argument("--model")
    one.add_argument("--no-retrieval", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("benchmark")
    e.add_argument("--out", required=True)
    e.add_argument("--models", nargs="*", default=[])
    e.add_argument("--provider", choices=list(BACKENDS))
    e.add_argument("--repeats", type=int)
    e.add_argument("--strict", action="store_true")
    e.add_argument("--no-control", action="store_true")
    a = sub.add_parser("ablate")
    a.add_argument("what", choices=["retrieval", "chunking", "encoder", "threshold"])
    a.add_argument("benchmark", help="for threshold, a split that isn't evaluated on")
    a.add_argument("--out", required=True)
    a.add_argument("--models", nargs="*", default=[])
    t = sub.add_parser("tables")
    t.add_argument("log")
    t.add_argument("--out", required=True)
    t.add_argument("--lenient", action="store_true")
    o = sub.add_parser("ocr")
    o.add_argument("transcriptions", nargs="?")
    o.add_argument("pages", nargs="?")
    o.add_argument("--out")
    o.add_argument("--sample-size", action="store_true")
    o.add_argument("--expected-cer", type=float, default=0.12)
    o.add_argument("--half-width", type=float, default=0.03)
    o.add_argument("--population", type=int, default=62)
    sub.add_parser("chunk-stats").add_argument("pages")
    n = sub.add_parser("annotate")
    n.add_argument("log")
    n.add_argument("--out", required=True)
    n.add_argument("--sample", type=int, default=0)
    n.add_argument("--seed", type=int, default=20240101)
    w = sub.add_parser("power")
    for name, default in (("effect", 0.05), ("sd", 0.12), ("power", 0.8), ("alpha", 0.05)):
        w.add_argument(f"--{name}", type=float, default=default)
    w.add_argument("--comparisons", type=int, default=1)
    w.add_argument("--from-log")
    w.add_argument("--metric", default="bert_f1")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    return p


def _encoder(name: str, cfg: PipelineConfig):
    if name in ("sentence", "hashed"):
        return sentence_encoder(cfg.embedding) if name == "sentence" else hashed_encoder()
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _generation(cfg: PipelineConfig, **given) -> PipelineConfig:
    return cfg.with_(generation=dataclasses.replace(cfg.generation, **{k: v for k, v in given.items() if v is not None}))


def _ablate(a: argparse.Namespace, spark: SparkSession, cfg: PipelineConfig, encode) -> None:
    questions, _ = io.read_benchmark(spark, a.benchmark)
    if a.what in ("chunking", "encoder"):
        pages = io.read_pages(spark, cfg.data_dir, cfg.ingest)
        if a.what == "chunking":
            out = sweeps.sweep_chunking(pages, questions, encode, cfg.chunk)
        else:
            models = {m: sentence_encoder(dataclasses.replace(cfg.embedding, model_name=m)) for m in a.models or sweeps.ENCODERS}
            out = sweeps.sweep_encoders(chunking.chunk_pages(pages, cfg.chunk), questions, models)
    else:
        index = pipeline.build_index(spark, cfg, encode)
        asked = encode(questions.select(F.col("question_id").alias("query_id"), "question"), "question")
        found = retrieval.top_k_blocked(asked, index, 10)
        if a.what == "retrieval":
            gold = sweeps.gold_of(questions).select("query_id", "gold", "by_page")
            of_page = found.join(index.select("chunk_id", "source_file", "page"), "chunk_id").join(gold.select("query_id", "by_page"), "query_id", "left")
            ids = F.when(F.col("by_page"), F.concat("source_file", F.lit("#p"), F.col("page").cast("string"))).otherwise(F.col("chunk_id"))
            known = questions.select(F.col("question_id").alias("query_id"), "answerable").join(gold.drop("by_page"), "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
            out = sweeps.sweep_retrieval(of_page.select("query_id", ids.alias("chunk_id"), "score", "rank"), known)
        else:
            tops = found.where("rank = 0").select("query_id", F.col("score").alias("top_score"))
            asked_of = questions.select(F.col("question_id").alias("query_id"), "answerable").join(tops, "query_id", "left")
            out = sweeps.calibrate_threshold(asked_of.withColumn("top_score", F.coalesce("top_score", F.lit(float("nan")))))
    out.coalesce(1).write.mode("overwrite").csv(a.out, header=True)  # a row per setting


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    cfg = PipelineConfig.load(a.config) if a.config else PipelineConfig()
    if a.command == "ocr" and a.sample_size:
        print(stats.required_sample_size(a.expected_cer, a.half_width, population=a.population))
        return 0
    spark = SparkSession.builder.appName("quern").getOrCreate()
    encode = _encoder(a.encoder, cfg)
    if a.command == "build":
        print(pipeline.build_index(spark, cfg, encode, force=a.force).count())
    elif a.command == "ask":
        cfg = _generation(cfg, provider=a.provider, model=a.model).with_(use_retrieval=not a.no_retrieval)
        q = spark.createDataFrame([("q", a.question)], "question_id string, question string")
        index = None if a.no_retrieval else pipeline.build_index(spark, cfg, encode)
        pipeline.ask(q, index, cfg, encode, k=a.k).select("status", "answer").show(truncate=False)
    elif a.command == "evaluate":
        questions, _ = io.read_benchmark(spark, a.benchmark)
        problems = benchmark.validate(questions)
        if a.strict and not problems.isEmpty():
            problems.show(truncate=False)
            return 1
        index = pipeline.build_index(spark, cfg, encode)
        base = [_generation(cfg, model=m, provider=a.provider, num_repeats=a.repeats) for m in a.models or [cfg.generation.model]]
        pipeline.run_conditions([c for b in base for c in ([b] if a.no_control else [b, b.with_(use_retrieval=False)])], questions, index, encode, a.out)
    elif a.command == "ablate":
        _ablate(a, spark, cfg, encode)
    elif a.command == "tables":
        records, meta = io.read_records(spark, a.log)
        pipeline.build_tables(records, a.out, strict=not a.lenient, source=a.log, meta=meta)
    elif a.command == "ocr":
        told = ocr.evaluate(io.read_transcriptions(spark, a.transcriptions), spark.read.parquet(a.pages))
        for name, df in told.items():
            if a.out:
                df.coalesce(1).write.mode("overwrite").json(f"{a.out}/{name}")
            else:
                df.show(truncate=False)
    elif a.command == "chunk-stats":
        pages = spark.read.parquet(a.pages)
        ocr.ingest_summary(pages).show()
        chunking.length_stats(chunking.chunk_pages(pages, cfg.chunk)).show()
    elif a.command == "annotate":
        io.write_sheet(annotation.sheet(io.read_records(spark, a.log)[0], a.sample or None, a.seed), annotation.COLUMNS, a.out)
    elif a.command == "power":
        sd = a.sd
        if a.from_log:
            told = stats.paired_sd(io.read_records(spark, a.from_log)[0], a.metric).first()
            if told is None:
                print("two models with three shared questions are needed", file=sys.stderr)
                return 1
            sd = told.sd
        print(json.dumps({"sd": sd, "pairs": stats.paired_sample_size(a.effect, sd, a.power, a.alpha, a.comparisons)}))
    elif a.command == "serve":
        from quern.service import Service, server

        server(Service(spark, cfg, encode).start(), a.host, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
