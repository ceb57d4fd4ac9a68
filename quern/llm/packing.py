"""Problem 8: filling containers of fixed capacity with documents.

Documents become hashed vectors of their tokens, projected to few dimensions; their Hilbert
key orders them along a space-filling curve. The curve is cut into ranges, and along each
range neighbouring documents are packed best-fit-decreasing window by window, with the open
containers carried on. Only documents larger than a container are split.

Results for odd input: null and empty texts have no token and take no room; they are assigned
all the same; targets whose capacity is null or below 1 are passed over; equal keys are
ordered by doc_id; repeated rows are assigned each; an empty table gives none.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import durable

#: Folder of the public tokenizer files; the environment or the parameter may name another one.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the vocabulary's own word pattern, a fixed value
BUCKETS, DIMENSIONS, BITS = 512, 3, 10
WINDOW = 4096  # documents packed together along the curve
OPEN = 256  # containers carried from window to window
ROWS_PER_RANGE = 50_000  # documents of one range, so at most one badly filled container per OPEN and range


def load_tokenizer(folder: str = TOKENIZERS, name: str = RANKS):
    """The tokenizer of a vocabulary file."""
    import tiktoken

    with open(Path(folder) / name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def projection(n_ids: int) -> np.ndarray:
    """Per token id its place in the projection of the hashed vectors: signed hashing into BUCKETS, then a fixed random matrix."""
    ids = np.arange(n_ids, dtype=np.uint64)
    mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) ^ (ids >> np.uint64(7))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sign = np.where((mixed >> np.uint64(63)) & np.uint64(1), 1.0, -1.0)
    matrix = np.random.default_rng(11).normal(size=(BUCKETS, DIMENSIONS))
    return (sign[:, None] * matrix[(mixed >> np.uint64(20)) % np.uint64(BUCKETS)]).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of rows of cell numbers below 2**bits, by the transposed form of the curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Packer:
    """Best fit into open containers of one capacity; items come window by window in curve order."""

    def __init__(self, capacity: int, prefix: str):
        self.capacity, self.prefix = capacity, prefix
        self.open: list[tuple[int, int]] = []  # (free, number), sorted
        self.next = 0

    def place(self, items: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
        """(container, doc, part, first token, tokens) of each (doc, tokens)."""
        rest = []
        for doc, size in items:
            part = first = 0
            while size - first > self.capacity:
                yield f"{self.prefix}-{self.next}", doc, part, first, self.capacity
                self.next, part, first = self.next + 1, part + 1, first + self.capacity
            rest.append((size - first, doc, part, first))
        rest.sort(key=lambda r: (-r[0], r[1], r[2]))
        for size, doc, part, first in rest:
            at = bisect_left(self.open, (size, -1))
            if at < len(self.open):
                free, number = self.open.pop(at)
            else:
                free, number, self.next = self.capacity, self.next, self.next + 1
            if free - size > 0:
                insort(self.open, (free - size, number))
            yield f"{self.prefix}-{number}", doc, part, first, size
        if len(self.open) > OPEN:  # the fullest are closed
            del self.open[: len(self.open) - OPEN]


def curve(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """Rows (doc_id, n_tokens, hkey)."""
    dims = [f"x{i}" for i in range(DIMENSIONS)]
    documents.sparkSession.sparkContext.addFile(str(Path(folder) / name))  # executors need no folder of their own

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_tokenizer(SparkFiles.getRootDirectory(), name)
        table = projection(enc.n_vocab)
        for b in batches:
            n, at = np.zeros(len(b), np.int64), np.zeros((len(b), DIMENSIONS))
            for i, t in enumerate(b.text):
                if t:
                    ids = enc.encode_to_numpy(t, disallowed_special=())
                    n[i] = len(ids)
                    at[i] = table[ids].sum(axis=0) / np.sqrt(len(ids))
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": n, **{d: at[:, i] for i, d in enumerate(dims)}})

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    points = durable(rows.mapInPandas(sketch, "doc_id bigint, n_tokens bigint, " + ", ".join(f"{d} double" for d in dims)))
    stats = points.where("n_tokens > 0").agg(*(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([stats[f"avg_{d}"] or 0.0 for d in dims])
    spread = np.array([stats[f"stddev_pop_{d}"] or 1.0 for d in dims])

    def place(*xs: pd.Series) -> pd.Series:
        z = (np.stack([x.to_numpy(float) for x in xs], axis=1) - mean) / spread
        return pd.Series(hilbert(np.minimum((1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return points.select("doc_id", "n_tokens", F.pandas_udf(place, "bigint")(*dims).alias("hkey"))


def pack(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """Rows (target_id, container_id, doc_id, part_no, first_token, n_tokens): all documents for each target.

    ``targets`` is a handful of container sizes. Containers don't reach over the ranges of the curve.
    """
    wanted = [(r.target_id, r.capacity_tokens) for r in targets.where("capacity_tokens >= 1").select("target_id", "capacity_tokens").distinct().orderBy("target_id", "capacity_tokens").collect()]
    keyed = durable(curve(documents, key, text, folder, name))
    ranges = max(1, -(-keyed.count() // ROWS_PER_RANGE))
    ordered = keyed.repartitionByRange(ranges, "hkey", "doc_id").sortWithinPartitions("hkey", "doc_id")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packers = [(t, Packer(c, f"{t}-{part}")) for t, c in wanted]
        columns = ["container_id", "doc_id", "part_no", "first_token", "n_tokens"]
        waiting: list[tuple[int, int]] = []

        def flush() -> Iterator[pd.DataFrame]:
            for t, p in packers:
                yield pd.DataFrame(list(p.place(waiting)), columns=columns).assign(target_id=t)
            waiting.clear()

        for b in batches:
            for row in zip(b.doc_id, b.n_tokens):
                waiting.append(row)
                if len(waiting) == WINDOW:
                    yield from flush()
        yield from flush()

    return ordered.mapInPandas(fill, "target_id int, container_id string, doc_id bigint, part_no int, first_token bigint, n_tokens bigint")


def pack_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (target_id, capacity_tokens, containers, tokens, filled): how full the containers are."""
    used = packed.groupBy("target_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(targets.select("target_id", "capacity_tokens").distinct()), "target_id").select("target_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
