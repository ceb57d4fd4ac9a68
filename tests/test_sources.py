"""Readers and connectors, with stand-ins for the packages and services that are absent."""

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quern.config import GenerationConfig, IngestConfig, PipelineConfig
from quern.operators import chunking
from quern.plans import pipeline
from quern.sources import encoders, generators, io

# A "PDF" here is text with form feeds between pages; a page that starts with ! fails in recognition.
STUBS = {
    "fitz.py": '''
class Page:
    def __init__(self, text): self.text = text
    def get_text(self): return self.text.split("~")[0]
    def get_pixmap(self, dpi): return self
    def tobytes(self, kind): return self.text.split("~")[-1].encode()
class Doc:
    def __init__(self, data): self.pages = [Page(t) for t in data.decode().split("\\f")]
    def __enter__(self): return self
    def __exit__(self, *_): pass
    def __iter__(self): return iter(self.pages)
def open(stream, filetype): return Doc(stream)
''',
    "pytesseract.py": '''
class TesseractError(Exception): pass
def image_to_string(image, lang, config):
    if image.startswith("!"): raise TesseractError("unreadable")
    return f" {image} "
''',
    "PIL/__init__.py": "",
    "PIL/Image.py": "def open(f): return f.read().decode()",
}


@pytest.fixture(scope="module")
def pdf_folder(spark, tmp_path_factory):
    archive, folder = tmp_path_factory.mktemp("stubs") / "stubs.zip", tmp_path_factory.mktemp("data")
    with zipfile.ZipFile(archive, "w") as z:
        for name, text in STUBS.items():
            z.writestr(name, text)
    spark.sparkContext.addPyFile(str(archive))
    long = "native text that is long enough to be taken as it is, without any recognition"
    (folder / "a.pdf").write_text(f"{long}\fshort~recognised text of the page\fkept~x\fno~!")
    (folder / "b.PDF").write_text(long)
    (folder / "c.txt").write_text("no document")
    return str(folder)


def test_pages_of_documents(spark, pdf_folder, tmp_path):
    rows = {r.doc_id: r for r in io.read_pages(spark, pdf_folder, IngestConfig()).collect()}
    assert set(rows) == {"a.pdf#p1", "a.pdf#p2", "a.pdf#p3", "a.pdf#p4", "b.PDF#p1"}
    used = {k: (r.used_ocr, r.ocr_attempted, r.ocr_rejected) for k, r in rows.items()}
    assert used["a.pdf#p1"] == (False, False, False) and used["a.pdf#p2"] == (True, True, False)
    assert used["a.pdf#p3"] == (False, True, True) and used["a.pdf#p4"] == (False, True, True)
    assert rows["a.pdf#p2"].text == "recognised text of the page" and rows["a.pdf#p3"].text == "kept" and rows["a.pdf#p4"].ocr_chars == 0
    with pytest.raises(FileNotFoundError):
        io.read_pages(spark, str(tmp_path), IngestConfig())


def test_index_is_built_once_and_again_for_another_configuration(spark, pdf_folder, tmp_path):
    cfg = PipelineConfig(data_dir=pdf_folder, index_dir=str(tmp_path / "index"))
    encode, built = encoders.hashed_encoder(16), []

    def counted(df, column):
        built.append(column)
        return encode(df, column)

    first = pipeline.build_index(spark, cfg, counted)
    assert pipeline.build_index(spark, cfg, counted).count() == first.count() == chunking.chunk_pages(io.read_pages(spark, pdf_folder)).count()
    assert len(built) == 1
    pipeline.build_index(spark, cfg, counted, force=True)
    pipeline.build_index(spark, cfg.with_(ingest=IngestConfig(ocr_dpi=100)), counted)
    assert len(built) == 3
    with pytest.raises(FileNotFoundError):
        io.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        pipeline.build_index(spark, cfg, counted, io.read_pages(spark, pdf_folder).withColumn("text", F.lit(" ")), force=True)


def test_writers_and_readers(spark, tmp_path):
    q = [("a", "q", "easy", ["r"], "v2", True, ["f#p1#c0"], [1], "f", None, False, ["x"], "")]
    df = spark.createDataFrame(q, "question_id string, question string, difficulty string, references array<string>, reference_version string, answerable boolean, gold_chunk_ids array<string>, gold_pages array<int>, source_file string, author string, author_independent boolean, validated_by array<string>, notes string")
    io.write_lines(df, str(tmp_path / "b.jsonl"), {"name": "n", "version": "v2"})
    back, meta = io.read_benchmark(spark, str(tmp_path / "b.jsonl"))
    assert back.collect() == df.collect() and meta == {"name": "n", "version": "v2"}
    pages = spark.createDataFrame([("f", 1, "x", None), ("f", 2, "  ", None), ("f", 3, None, True)], "source_file string, page int, text string, used_ocr boolean").withColumns({"ocr_attempted": F.lit(False), "ocr_rejected": F.lit(False), "kannada_ratio": F.lit(0.0)})
    assert [r.page for r in io.nonempty(pages).collect()] == [1] and io.corpus_digest(pages) == io.corpus_digest(pages.orderBy(F.desc("page")))
    io.write_report(pages, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first().n_pages == 3 and spark.read.parquet(str(tmp_path / "report" / "pages")).count() == 3


def test_local_server_is_asked_with_the_settings():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"response": " said ", "prompt_eval_count": 3, "eval_count": 1}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        cfg = GenerationConfig(provider="ollama", model="m", ollama_host=f"http://127.0.0.1:{server.server_port}", seed=None)
        r = next(generators.responses(cfg, ["hello"]))
    finally:
        server.shutdown()
    assert (r["text"], r["prompt_tokens"], r["completion_tokens"], r["error"]) == ("said", 3, 1, None) and "seed" not in r["honoured_settings"]
    path, body = asked[0]
    assert path == "/api/generate" and body["prompt"] == "hello" and body["options"] == {"temperature": 0.3, "num_predict": 150, "top_p": 1.0} and body["stream"] is False


def test_hosted_server_needs_its_key(monkeypatch):
    sent = []
    monkeypatch.setattr(generators, "_post", lambda url, payload, timeout, headers: sent.append((payload, headers)) or {"choices": [{"message": {"content": "ok"}}], "usage": {"prompt_tokens": 2}})
    cfg = GenerationConfig(provider="groq", model="m")
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    assert next(generators.responses(cfg, ["x"]))["error"]
    monkeypatch.setenv("GROQ_API_KEY", "k")
    r = next(generators.responses(cfg, ["x"]))
    assert (r["text"], r["is_local"], r["prompt_tokens"]) == ("ok", False, 2)
    payload, headers = sent[0]
    assert payload["seed"] == 0 and payload["max_tokens"] == 150 and headers == {"Authorization": "Bearer k"}
