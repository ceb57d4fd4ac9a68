"""Encoders: functions that add the column ``embedding`` to a table by one of its text columns.

``sentence_encoder`` needs the optional package sentence_transformers; ``hashed_encoder`` needs nothing and is made of
built-in expressions, for tests and for indexes that only have to match words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import EmbeddingConfig
from quern.functions import text as tx
from quern.functions import vectors as vx

Encoder = Callable[[DataFrame, str], DataFrame]


def sentence_encoder(cfg: EmbeddingConfig | None = None, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Encoder:
    """Vectors of a sentence model: loaded once a task, asked batch by batch, as floats of length 1 if so configured.

    ``load`` gives a function from texts to a matrix and stands in for the configured model.
    """
    cfg = cfg or EmbeddingConfig()

    def from_package() -> Callable[[list[str]], np.ndarray]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(cfg.model_name, revision=cfg.revision, device=cfg.device)
        return lambda texts: model.encode(texts, batch_size=cfg.batch_size, convert_to_numpy=True, show_progress_bar=False)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = (load or from_package)()
        for texts in batches:
            v = np.asarray(encode(texts.fillna("").tolist()), np.float32).reshape(len(texts), -1)
            if cfg.normalise_embeddings:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-10))
            yield pd.Series(list(v))

    def add(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR_ITER)(F.col(column)))

    return add


def hashed_encoder(dim: int = 64) -> Encoder:
    """An extension: word counts hashed into ``dim`` places, of length 1; a text without a word has a zero vector."""

    def add(df: DataFrame, column: str) -> DataFrame:
        places = F.transform(tx.tokens(F.coalesce(F.col(column), F.lit("")), form=None), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
        counts = tx.let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double")))
        return df.withColumn("embedding", vx.l2_normalise(counts).cast("array<float>"))

    return add
