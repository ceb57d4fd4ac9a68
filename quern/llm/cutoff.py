"""Problem 7: generated texts that break off before their last sentence is complete.

Near-copies are found by min-hash banding over five-word shingles and verified by
alignment: the copy whose alignment ends inside a sentence of the other is cut off. Texts
without such a copy are scored by the terminality of their closing words.

Results for odd input: null and empty texts and failed calls (error_message set) are never
cut off; repeated rows are flagged each; texts under five words have no shingle and are
scored by their closing words; an empty table gives none.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import endings
from quern.llm.scripts import TERMINATORS
from quern.session import durable

SHINGLE, BANDS, ROWS = 5, 16, 4
SIMILARITY = 0.8
BLOCK = 2_000  # rows of a bucket that meet the whole bucket in one task
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")
_SEEDS = np.random.default_rng(7).integers(1, (1 << 61) - 1, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def tokens(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold())


@functools.lru_cache(maxsize=1 << 17)
def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def shingles(toks: list[str]) -> np.ndarray:
    """The distinct shingles of a text as 64-bit numbers, made of their tokens' for all places at once."""
    n = len(toks) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_code, toks), np.uint64, len(toks))
    h = codes[:n].copy()
    for k in range(1, SHINGLE):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    return np.unique((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def bands(hashes: np.ndarray) -> list[int]:
    """One key per band; equal keys make candidates. Similarity 0.8 meets in some band with a chance of 0.9998."""
    low = (hashes[:, None] * _SEEDS[0] + _SEEDS[1]) >> np.uint64(16)
    mins = low.min(axis=0).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(m.tobytes(), seed=k) - (1 << 63) for k, m in enumerate(mins)]


def aligned_end(a: list[str], b: list[str]) -> tuple[int, int]:
    """(edits, end): the cheapest alignment of all of ``a`` with a prefix of ``b``, the shortest of these.

    Edit distances to every prefix come column by column, each the bits of two integers (Myers, Hyyro).
    """
    if not a:
        return 0, 0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, edits, best = full, 0, len(a), (len(a), 0)
    for j, y in enumerate(b, 1):
        eq = at.get(y, 0)
        flat = (((eq & up) + up) ^ up | eq) & full
        more, less = down | full & ~(flat | up), up & flat
        edits += (more >> last & 1) - (less >> last & 1)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(eq | down | more), more & (eq | down)
        best = min(best, (edits, j))
    return best


@functools.lru_cache(maxsize=4096)
def _parsed(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens and shingles of a text, which meets many others."""
    toks = tokens(text)
    return toks, shingles(toks)


def judge_pair(short: str, long: str) -> bool | None:
    """True where ``short`` ends inside a sentence of its near-copy, False where the sentence ends there, too."""
    (a, sa), (b, sb) = _parsed(endings.body(endings._DOTS.sub("", short))), _parsed(endings.body(long))
    if len(a) < SHINGLE or len(b) < len(a):
        return None
    both = len(np.intersect1d(sa, sb, assume_unique=True))
    if both < SIMILARITY * (len(sa) + len(sb) - both):
        return None
    edits, end = aligned_end(a[:-1], b)
    if edits > 0.1 * len(a) or end >= len(b):
        return None
    last, there = a[-1], b[end]
    if there != last:
        return True if there.startswith(last) else None
    rest = b[end + 1 : end + 2]
    if not rest:
        return None
    return not (rest[0] in TERMINATORS)


def near_copies(rows: DataFrame) -> DataFrame:
    """Rows (id, partner) of all distinct texts of a band bucket that judge_pair may tell about.

    rows: id, text, distinct texts. A text whose words must tell meets each other text of its buckets, but for those
    that judge_pair turns away by the numbers of words or shingles alone. Large buckets are worked in blocks.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.id, b.text):
                h = shingles(toks := tokens(t))
                if not len(h):
                    continue
                known = {t: (len(toks), len(h))}

                def counts(x: str) -> tuple[int, int]:
                    if x not in known:
                        known[x] = len(k := tokens(x)), len(shingles(k))
                    return known[x]

                short = counts(endings.body(endings._DOTS.sub("", t))) if endings.closes(t) is None else (None, None)
                out.append((i, bands(h), *short, *counts(endings.body(t))))
            yield pd.DataFrame(out, columns=["id", "bands", "words", "grams", "words_b", "grams_b"]).astype({"words": "Int32", "grams": "Int32"})

    sketched = durable(rows.mapInPandas(sketch, "id string, bands array<bigint>, words int, grams int, words_b int, grams_b int"))
    keyed = sketched.select("id", F.explode("bands").alias("band"), "words", "grams", "words_b", "grams_b")
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    keyed = durable(keyed.join(shared, "band")).withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int"))
    short = keyed.where(F.col("words") >= SHINGLE).select("id", "band", "words", "grams", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    long = keyed.select(F.col("id").alias("partner"), "band", "words_b", "grams_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    alike = F.least("grams", "grams_b") >= F.greatest("grams", "grams_b") * F.lit(SIMILARITY)
    return short.join(long, ["band", "part"]).where((F.col("id") != F.col("partner")) & (F.col("words_b") >= F.col("words")) & alike).select("id", "partner").distinct()


def cut_off(outputs: DataFrame) -> DataFrame:
    """Rows (gen_id, reason) of the generations that break off; reason ``copy`` or ``ending``."""
    live = outputs.where("error_message IS NULL OR trim(error_message) = ''").where(F.length(F.trim("text")) > 0)
    live = live.select(F.col("gen_id").cast("bigint").alias("gen_id"), "text").withColumn("id", F.md5("text"))
    texts = durable(live.groupBy("id").agg(F.min("gen_id").alias("rep"), F.first("text").alias("text")))
    pairs = near_copies(texts.select("id", "text"))
    sides = pairs.join(texts.select("id", "rep", F.col("text").alias("a")), "id").join(texts.select(F.col("id").alias("partner"), F.col("text").alias("b")), "partner").select("rep", "a", "b")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r, a, b in zip(x.rep, x.a, x.b):
                if endings.closes(a) is None:
                    v = judge_pair(a, b)
                    if v is not None:
                        out.append((r, v))
            yield pd.DataFrame(out, columns=["key", "cut"])

    verdicts = sides.mapInPandas(align, "key bigint, cut boolean").groupBy("key").agg(F.bool_or("cut").alias("cut"))
    ending = endings.broken_off(texts.select("rep", "text"), "rep", "text")
    both = ending.select("key", F.lit(True).alias("open")).join(verdicts, "key", "full")
    cut = both.where(F.coalesce("cut", "open")).select(F.col("key").alias("rep"), F.when(F.col("cut"), "copy").otherwise("ending").alias("reason"))
    return live.join(texts.select("id", "rep"), "id").join(cut, "rep").select("gen_id", "reason")


def cut_off_share(outputs: DataFrame) -> DataFrame:
    """Rows (provider, model, n_texts, n_cut, share): how often each source truncates."""
    cut = cut_off(outputs).select("gen_id", F.lit(1).alias("is_cut"))
    live = outputs.where("error_message IS NULL OR trim(error_message) = ''").where(F.length(F.trim("text")) > 0)
    joined = live.select(F.col("gen_id").cast("bigint").alias("gen_id"), "provider", "model").join(cut, "gen_id", "left")
    return joined.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("is_cut"), F.lit(0)).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
