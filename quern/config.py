"""Configuration of the pipeline: frozen dataclasses with a JSON round trip and a fingerprint."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


# The names and defaults of all fields, which saved configurations and result logs name.
@dataclass(frozen=True)
class IngestConfig:
    ocr_char_threshold: int = 50
    ocr_dpi: int = 200
    tesseract_lang: str = "kan"
    tesseract_psm: int = 3
    keep_ocr_only_if_longer: bool = True
    normalise_unicode: bool = True
    unicode_form: str = "NFC"


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 500
    chunk_overlap: int = 50
    separators: tuple[str, ...] = ("\n\n", "\n", "॥", "।", ". ", " ", "")


@dataclass(frozen=True)
class EmbeddingConfig:
    model_name: str = "sentence-transformers/paraphrase-multilingual-mpnet-base-v2"
    revision: str | None = None
    normalise_embeddings: bool = True
    batch_size: int = 32
    device: str | None = None


@dataclass(frozen=True)
class RetrievalConfig:
    k_max: int = 5
    k_min: int = 1
    sim_threshold: float = 0.55
    relative_floor: float = 0.85
    abstain_when_empty: bool = True
    index_type: str = "flat_ip"


@dataclass(frozen=True)
class GenerationConfig:
    provider: str = "ollama"
    model: str = "gemma3:4b"
    temperature: float = 0.3
    max_tokens: int = 150
    top_p: float = 1.0
    seed: int | None = 0
    timeout_s: float = 180.0
    ollama_host: str = "http://localhost:11434"
    num_repeats: int = 3


@dataclass(frozen=True)
class MetricConfig:
    bertscore_model: str = "xlm-roberta-base"
    bertscore_layer: int = 9
    bertscore_idf: bool = False
    bertscore_batch_size: int = 16
    meteor_alpha: float = 0.9
    meteor_beta: float = 3.0
    meteor_gamma: float = 0.5
    meteor_fuzzy: float | None = None
    chrf_order: int = 6
    chrf_beta: float = 2.0
    keep_numerals: bool = True


PARTS = {"ingest": IngestConfig, "chunk": ChunkConfig, "embedding": EmbeddingConfig, "retrieval": RetrievalConfig, "generation": GenerationConfig}


@dataclass(frozen=True)
class PipelineConfig:
    ingest: IngestConfig = field(default_factory=IngestConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    use_retrieval: bool = True
    data_dir: str = "data"
    index_dir: str = "index"
    results_dir: str = "results"
    random_seed: int = 20240101

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(dataclasses.asdict(self)))

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_dict(cls, payload: dict[str, Any]) -> PipelineConfig:
        """Unknown keys, also in a part, raise TypeError."""
        given = dict(payload)
        for name, part in PARTS.items():
            if isinstance(given.get(name), dict):
                values = dict(given[name])
                if "separators" in values:
                    values["separators"] = tuple(values["separators"])
                given[name] = part(**values)
        return cls(**given)

    @classmethod
    def load(cls, path: str | Path) -> PipelineConfig:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def with_(self, **overrides: Any) -> PipelineConfig:
        return dataclasses.replace(self, **overrides)

    @property
    def fingerprint(self) -> str:
        """Sixteen hex digits over everything that shapes an index."""
        d = self.to_dict()
        shaped = json.dumps({k: d[k] for k in ("ingest", "chunk", "embedding")}, sort_keys=True, ensure_ascii=False)
        return hashlib.sha256(shaped.encode()).hexdigest()[:16]

    def fingerprint_with(self, corpus_digest: str) -> str:
        """An extension: the fingerprint that also follows the corpus."""
        return hashlib.sha256(f"{self.fingerprint}:{corpus_digest}".encode()).hexdigest()[:16]

    @property
    def condition_id(self) -> str:
        model = self.generation.model.replace(":", "-").replace("/", "-")
        return f"{model}__{'rag' if self.use_retrieval else 'norag'}__k{self.retrieval.k_max}__c{self.chunk.chunk_size}"
