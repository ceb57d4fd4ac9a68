"""Problem 2: cutting oversized items at natural boundaries.

Content-defined chunking: a rolling hash over the characters marks landmarks; each cut is
the natural boundary nearest to the first landmark between a minimum and the maximum size,
of the strongest separator that occurs there. Cuts depend on nearby characters only, so an
edit alters the neighbouring pieces and later cuts fall back to the same places.

Results for odd input: null and empty texts and texts within the limit give no piece; a
null configuration means configuration 1, so does an unknown one; an overlap that is not
below the limit counts as limit - 1; text without any separator is cut between graphemes;
repeated rows give their pieces once; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12  # characters the rolling hash covers
SPACING = 24  # a landmark every so many characters, on average
_BASE, _MOD = 257, (1 << 31) - 1
_GRAPHEME = regex.compile(r"\X")


def landmarks(text: str) -> list[int]:
    """Positions after which the hash of the last WINDOW characters is 0 modulo SPACING."""
    out, h, drop = [], 0, pow(_BASE, WINDOW, _MOD)
    for i, ch in enumerate(text):
        h = (h * _BASE + ord(ch)) % _MOD
        if i >= WINDOW:
            h = (h - ord(text[i - WINDOW]) * drop) % _MOD
            if h % SPACING == 0:
                out.append(i + 1)
    return out


def cuts(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[int]:
    """End positions of the pieces; consecutive ends are at most size - overlap apart."""
    most = max(size - max(min(overlap, size - 1), 0), 1)
    least = max(most // 3, 1)
    ends = {}
    for level, sep in enumerate(s for s in separators if s):
        at = text.find(sep)
        while at >= 0:
            ends.setdefault(at + len(sep), level)
            at = text.find(sep, at + 1)
    marks, last, out = landmarks(text), 0, []
    while len(text) - last > most:
        lo, hi = last + least, last + most
        near = [(ends[p], p) for p in range(lo, hi + 1) if p in ends]
        if near:
            best = min(near)[0]
            k = bisect_left(marks, lo)
            goal = marks[k] if k < len(marks) and marks[k] <= hi else hi
            cut = min((p for level, p in near if level == best), key=lambda p: (abs(p - goal), p))
        else:
            cut = last
            for g in _GRAPHEME.finditer(text, last):
                if g.end() > hi:
                    break
                cut = g.end()
            cut = cut if cut > last else hi
        out.append(cut)
        last = cut
    return [*out, len(text)]


def pieces(text: str | None, size: int, overlap: int, separators: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text longer than ``size``; none for other texts."""
    if not text or size < 1 or len(text) <= size:
        return []
    overlap = max(min(overlap, size - 1), 0)
    out, last = [], 0
    for end in cuts(text, size, overlap, separators):
        out.append((max(last - overlap, 0), end))
        last = end
    return out


def split_oversized(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows (chunk_id, piece_no, start_pos, end_pos, char_len, text) of each chunk over its configured size.

    ``configs`` has a handful of rows (one per pipeline configuration) and is broadcast.
    """
    default = configs.where("config_id = 1").select(F.col("chunk_size").alias("d_size"), F.col("chunk_overlap").alias("d_overlap"), F.col("separators").alias("d_separators"))
    conf = configs.select(F.col("config_id").alias("c_id"), "chunk_size", "chunk_overlap", "separators")
    rows = (
        chunks.where(F.col("text").isNotNull())
        .select("chunk_id", "text", F.coalesce("config_id", F.lit(1)).alias("c_id"))
        .join(F.broadcast(conf), "c_id", "left")
        .join(F.broadcast(default), F.lit(True), "left")
        .select("chunk_id", "text", F.coalesce("chunk_size", "d_size").alias("size"), F.coalesce("chunk_overlap", "d_overlap").alias("overlap"), F.coalesce("separators", "d_separators").alias("separators"))
        .where(F.length("text") > F.col("size"))
        .distinct()
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(c, k, s, e, e - s, t[s:e]) for c, t, size, ov, seps in zip(b.chunk_id, b.text, b["size"], b.overlap, b.separators)
                   for k, (s, e) in enumerate(pieces(t, int(size), 0 if pd.isna(ov) else int(ov), list(seps) if seps is not None else []))]
            yield pd.DataFrame(out, columns=["chunk_id", "piece_no", "start_pos", "end_pos", "char_len", "text"])

    return rows.mapInPandas(cut, "chunk_id string, piece_no int, start_pos int, end_pos int, char_len int, text string")
