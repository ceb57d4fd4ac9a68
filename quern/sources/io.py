"""Readers and writers: page documents, question sets, record logs, indexes, transcriptions, sheets."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schemas
from quern.config import IngestConfig, PipelineConfig
from quern.operators import ocr


def read_pages(spark: SparkSession, folder: str, cfg: IngestConfig | None = None, patterns: tuple[str, ...] = ("*.pdf", "*.PDF")) -> DataFrame:
    """Pages of the PDF files of a folder: native text, and recognised text where that is short. Needs PyMuPDF, and Tesseract for recognition.

    Raises FileNotFoundError if no file matches. Files are read by executors, a page is a row.
    """
    cfg = cfg or IngestConfig()
    files = None
    for p in patterns:
        one = spark.read.format("binaryFile").option("pathGlobFilter", p).load(folder).select("path", "content")
        files = one if files is None else files.unionByName(one)
    files = files.dropDuplicates(["path"])
    if files.isEmpty():
        raise FileNotFoundError(f"no document in {folder}")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz  # PyMuPDF

        for b in batches:
            out = []
            for path, content in zip(b.path, b.content):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for i, page in enumerate(doc, 1):
                        native = page.get_text().strip()
                        out.append((path.rsplit("/", 1)[-1], i, native, recognise(page, cfg) if len(native) < cfg.ocr_char_threshold else None))
            yield pd.DataFrame(out, columns=["source_file", "page", "native_text", "ocr_text"])

    raw = files.mapInPandas(explode, "source_file string, page int, native_text string, ocr_text string")
    chosen = ocr.choose_text(raw, cfg=cfg)
    return chosen.withColumn("doc_id", F.concat("source_file", F.lit("#p"), F.col("page").cast("string"))).select(*[f.split(" ")[0] for f in schemas.PAGE.split(", ")])


def recognise(page, cfg: IngestConfig) -> str | None:
    """The text of a rendered page, or None where recognition fails, which is logged. Missing packages are an error."""
    import io

    import pytesseract
    from PIL import Image

    try:
        image = Image.open(io.BytesIO(page.get_pixmap(dpi=cfg.ocr_dpi).tobytes("png")))
        return pytesseract.image_to_string(image, lang=cfg.tesseract_lang, config=f"--psm {cfg.tesseract_psm}").strip()
    except (pytesseract.TesseractError, RuntimeError, OSError, ValueError) as e:
        logging.getLogger(__name__).warning("recognition failed: %s", e)
        return None


def nonempty(pages: DataFrame) -> DataFrame:
    return pages.where(F.length(F.regexp_replace("text", "(?U)\\s", "")) > 0)


def write_report(pages: DataFrame, path: str) -> None:
    """The pages as a table, and their summary as JSON beside it."""
    pages.write.mode("overwrite").parquet(f"{path}/pages")
    ocr.ingest_summary(pages).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.length(F.trim("value")) > 0)


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(questions, meta) of a JSON-lines file; ``//`` lines are comments, a ``_meta`` line names it. Bad fields raise ValueError with the line."""
    known = {f.split(" ")[0] for f in schemas.QUESTION.split(", ")}
    meta, rows = {"name": Path(path).stem, "version": "v1"}, []
    default = {"reference_version": "v1", "answerable": True, "references": [], "gold_chunk_ids": [], "gold_pages": [], "author_independent": False, "validated_by": [], "notes": ""}
    for r in _numbered_lines(spark, path).orderBy("line").toLocalIterator():
        if r.value.lstrip().startswith("//"):
            continue
        d = json.loads(r.value)
        if "_meta" in d:
            meta |= d["_meta"]
        elif set(d) - known or not {"question_id", "question", "difficulty"} <= set(d):
            raise ValueError(f"{path}, line {r.line + 1}: unknown or missing fields")
        else:
            rows.append(tuple((default | d).get(k) for k in [f.split(" ")[0] for f in schemas.QUESTION.split(", ")]))
    return spark.createDataFrame(rows, schemas.QUESTION), meta


def write_lines(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """A JSON-lines file with a meta line first; for question sets and other small tables."""
    with open(path, "w", encoding="utf-8") as f:
        if meta is not None:
            f.write(json.dumps({"_meta": meta}, ensure_ascii=False) + "\n")
        for line in df.toJSON().toLocalIterator():
            f.write(line + "\n")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(records, meta) of a foreign JSON-lines log: blanks skipped, the last meta line wins, seq keeps the order of the lines.

    The file is read in splits. Within a split rows are numbered in order, and a split is numbered by its first byte,
    of which it has at least as many as rows; so the sum orders all rows.
    """
    raw = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_line"))
    lines = raw.where(F.length(F.trim("value")) > 0)
    is_meta = F.get_json_object("value", "$._meta").isNotNull()
    last = lines.where(is_meta).agg(F.max_by("value", "_line").alias("v")).first().v
    schema = T.StructType.fromDDL(schemas.RECORD)
    parsed = lines.where(~is_meta).select("_line", F.from_json("value", schema).alias("r")).select("_line", "r.*")
    return parsed.withColumn("seq", F.coalesce("seq", "_line")).drop("_line"), json.loads(last)["_meta"] if last else {}


def write_log(records: DataFrame, path: str, append: bool, meta: dict | None = None) -> None:
    """Our own log: a table of the RECORD schema partitioned by condition; the first condition overwrites, later ones append. meta lies beside it."""
    records = schemas.conform(records, schemas.RECORD)
    records.write.mode("append" if append else "overwrite").partitionBy("condition").parquet(path)
    if meta is not None:
        records.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(records, meta) of a log of ours, or of a foreign one where the path is a JSON-lines file."""
    if path.endswith((".jsonl", ".json")):
        return read_log(spark, path)
    meta = _lines_if_any(spark, f"{path}/_meta")
    return schemas.conform(spark.read.schema(T.StructType.fromDDL(schemas.RECORD)).parquet(path), schemas.RECORD), json.loads(meta[0]) if meta else {}


def _lines_if_any(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small text file; none if there is no such path. Other errors are raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return [r.value for r in spark.read.text(path).collect()]


def save_index(chunks: DataFrame, folder: str, cfg: PipelineConfig, extra: dict | None = None) -> None:
    """One table of chunks with their vectors and a manifest beside it."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    spark = chunks.sparkSession
    saved = spark.read.parquet(f"{folder}/chunks")
    facts = saved.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), F.count("embedding").alias("vectors")).first()
    manifest = {"fingerprint": cfg.fingerprint, "n_chunks": facts.n, "n_vectors": facts.vectors, "dim": facts.dim, "metric": "cosine", **(extra or {})}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load_index(spark: SparkSession, folder: str, fingerprint: str | None = None) -> DataFrame:
    """The chunks of a saved index. FileNotFoundError without a manifest, ValueError if it doesn't fit."""
    lines = _lines_if_any(spark, f"{folder}/manifest")
    if not lines:
        raise FileNotFoundError(f"no manifest in {folder}")
    manifest = json.loads(lines[0])
    if fingerprint is not None and manifest["fingerprint"] != fingerprint:
        raise ValueError("the index was built with another configuration")
    chunks = spark.read.parquet(f"{folder}/chunks")
    if not chunks.count() == manifest["n_chunks"] == manifest["n_vectors"]:
        raise ValueError("the index's chunks and vectors differ in number")
    return chunks


def corpus_digest(pages: DataFrame) -> str:
    """A digest of all pages that doesn't depend on their order."""
    total = pages.agg(F.sum(F.xxhash64("source_file", "page", "text").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{total.s}:{total.n}".encode()).hexdigest()[:16]


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSCRIPTION).json(path)


def write_sheet(sheet: DataFrame, columns: list[str], path: str) -> None:
    sheet.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
