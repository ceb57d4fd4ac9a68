"""An HTTP service over the pipeline, with the standard library only: GET /api/health and POST /api/ask."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import PipelineConfig
from quern.functions import text as tx
from quern.plans import pipeline
from quern.sources.encoders import Encoder

# The bounds of a request.
QUERY_CHARS, MOST_K = 1000, 20


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def checked(body: Any) -> tuple[str, int | None]:
    """The question and k of a request; Refused with 422 where they are out of bounds."""
    query, k = (body.get("query"), body.get("k")) if isinstance(body, dict) else (None, None)
    if not isinstance(query, str) or not 1 <= len(query) <= QUERY_CHARS:
        raise Refused(422, f"query must have 1 to {QUERY_CHARS} characters")
    if k is not None and (isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_K):
        raise Refused(422, f"k must be a number from 1 to {MOST_K}")
    return query, k


class Service:
    """Answers from one index. Until :meth:`start` has loaded it, every call is refused with 503."""

    def __init__(self, spark: SparkSession, cfg: PipelineConfig, encode: Encoder):
        self.spark, self.cfg, self.encode = spark, cfg, encode
        self.index: DataFrame | None = None
        self.n_chunks = 0

    def start(self, index: DataFrame | None = None) -> Service:
        found = (index if index is not None else pipeline.build_index(self.spark, self.cfg, self.encode)).cache()
        self.n_chunks = found.count()
        self.index = found
        return self

    def _ready(self) -> DataFrame:
        if self.index is None:
            raise Refused(503, "not ready")
        return self.index

    def health(self) -> dict:
        self._ready()
        g = self.cfg.generation
        return {"status": "ok", "n_chunks": self.n_chunks, "model": g.model, "provider": g.provider, "embedding_model": self.cfg.embedding.model_name, "index_fingerprint": self.cfg.fingerprint}

    def ask(self, body: Any) -> dict:
        query, k = checked(body)
        index, began = self._ready(), time.perf_counter()
        asked = self.spark.createDataFrame([("q", query)], "question_id string, question string")
        out = pipeline.ask(asked, index, self.cfg, self.encode, k=k)
        excerpt = lambda c: F.struct(*(c[x].alias(x) for x in ("citation", "source_file", "page", "score", "used_ocr")), tx.excerpt(tx.strip(c["text"])).alias("excerpt"))
        sources = F.transform("sources", excerpt) if "sources" in out.columns else F.array()
        generation = F.col("generation.latency_s") if "generation" in out.columns else F.lit(None).cast("double")
        r = out.select("status", "answer", sources.alias("sources"), F.coalesce(generation, F.lit(0.0)).alias("g")).first()
        total = time.perf_counter() - began
        shown = [s.asDict() | {"score": round(s.score, 4)} for s in r.sources or []]
        return {"status": r.status, "answer": r.answer, "sources": shown, "retrieval_latency_s": round(max(total - r.g, 0.0), 4), "generation_latency_s": round(r.g, 4), "total_latency_s": round(total, 4), "model": self.cfg.generation.model}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that hasn't begun yet; call ``serve_forever``. Port 0 takes any free one."""
    one_at_a_time = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, make) -> None:
            try:
                status, body = 200, make()
            except Refused as e:
                status, body = e.status, {"detail": str(e)}
            except Exception as e:  # noqa: BLE001
                status, body = 500, {"detail": str(e)}
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _unknown(self) -> dict:
            raise Refused(404, "not found")

        def do_GET(self) -> None:  # noqa: N802
            self._send(service.health if self.path == "/api/health" else self._unknown)

        def do_POST(self) -> None:  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def answer() -> dict:
                try:
                    body = json.loads(raw)
                except ValueError as e:
                    raise Refused(422, "the body is no JSON") from e
                with one_at_a_time:
                    return service.ask(body)

            self._send(answer if self.path == "/api/ask" else self._unknown)

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
