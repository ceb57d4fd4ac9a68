"""Recursive splitting of pages into chunks, overlap, offsets and length statistics."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.config import ChunkConfig
from quern.functions import text as tx


def spans(text: str, separators: Sequence[str], size: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text: cut after the first separator that occurs, packed up to ``size``.

    A part that is still too long is taken up again with the separators that follow and joined to no neighbour;
    where none is left (or the empty one is met) it is cut every ``size`` characters. Pieces of white space only
    are dropped, unless the text as a whole was short or cut by size. Linear in the text for each separator.
    """
    if len(text) <= size:
        return [(0, len(text))] if text else []
    work, out, by_size = [(0, len(text), 0)], [], True
    while work:
        lo, hi, level = work.pop()
        if level < 0:  # a finished piece
            out.append((lo, hi))
            continue
        while level < len(separators) and separators[level] and text.find(separators[level], lo, hi) < 0:
            level += 1
        if level == len(separators) or not separators[level]:
            out += [(i, min(i + size, hi)) for i in range(lo, hi, size)]
            continue
        by_size = False
        sep, todo, begin, last, at = separators[level], [], lo, lo, text.find(separators[level], lo, hi)
        while last < hi:
            end = at + len(sep) if at >= 0 else hi
            if begin < last and (end - begin > size):  # what is held is full
                todo.append((begin, last, -1))
                begin = last
            if end - last > size:
                todo.append((last, end, level + 1))
                begin = end
            last = end
            at = text.find(sep, last, hi) if at >= 0 else -1
        if begin < hi:
            todo.append((begin, hi, -1))
        work += reversed(todo)
    return out if by_size else [(a, b) for a, b in out if not text[a:b].isspace()]


def split_pieces(text: str, separators: Sequence[str], size: int) -> list[str]:
    return [text[a:b] for a, b in spans(text, separators, size)]


def raw_pieces(text: Column, cfg: ChunkConfig | None = None) -> Column:
    """array<string> of the pieces of a text, before overlap."""
    cfg = cfg or ChunkConfig()

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: split_pieces(t, cfg.separators, cfg.chunk_size), na_action="ignore")

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(text)


def fixed_pieces(text: Column, size: int) -> Column:
    """Pieces of a fixed width; null for null, none for empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def chunk_pages(pages: DataFrame, cfg: ChunkConfig | None = None, pieces: Column | None = None) -> DataFrame:
    """Chunks with provenance: the last characters of the piece before are put in front, offsets run on.

    Needs source_file, page, text and used_ocr; blank pages have no chunk. (source_file, page) is unique.
    """
    cfg = cfg or ChunkConfig()
    ov = cfg.chunk_overlap
    rows = pages.where(F.length(tx.strip(F.col("text"))) > 0)
    rows = rows.select("source_file", "page", "used_ocr", F.posexplode(pieces if pieces is not None else raw_pieces(F.col("text"), cfg)).alias("i", "piece"))
    w = Window.partitionBy("source_file", "page").orderBy("i")
    before = F.lag("piece").over(w)
    text = F.when(before.isNotNull() & F.lit(ov > 0), F.concat(F.substring(before, F.greatest(F.length(before) - ov + 1, F.lit(1)), F.lit(max(ov, 0))), F.col("piece"))).otherwise(F.col("piece"))
    rows = rows.withColumn("text", text).withColumn("char_len", F.length("text"))
    start = F.coalesce(F.sum(F.greatest(F.col("char_len") - ov, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select(
        F.concat("source_file", F.lit("#p"), F.col("page").cast("string"), F.lit("#c"), F.col("i").cast("string")).alias("chunk_id"),
        "text", "source_file", "page", "used_ocr", start.alias("char_start"), "char_len",
    )


def length_stats(chunks: DataFrame) -> DataFrame:
    """One row: n, and for characters and tokens mean, upper median, population deviation, minimum, quartiles and maximum; n_ocr.

    One scan makes a histogram of (measure, length), from which all figures follow, so that no task gathers all lengths.
    """
    measured = chunks.select(F.explode(F.array(F.struct(F.lit("chars").alias("what"), F.length("text").alias("v")), F.struct(F.lit("toks").alias("what"), F.size(tx.tokens(F.col("text"))).alias("v")))).alias("x"), F.coalesce("used_ocr", F.lit(False)).cast("int").alias("ocr"))
    hist = measured.groupBy("x.what", "x.v").agg(F.count(F.lit(1)).alias("m"), F.sum("ocr").alias("ocr"))
    known = F.col("v").isNotNull() & (F.col("v") >= 0)
    hist = hist.withColumn("upto", F.sum(F.when(known, F.col("m"))).over(Window.partitionBy("what").orderBy("v"))).withColumn("total", F.sum(F.when(known, F.col("m"))).over(Window.partitionBy("what")))  # a row per length
    out = [F.coalesce(F.sum(F.when(F.col("what") == "chars", F.col("m"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("what") == "chars", F.col("ocr"))), F.lit(0)).alias("n_ocr")]
    for c in ("chars", "toks"):
        own = lambda x, c=c: F.when((F.col("what") == c) & known, x)
        v, m = F.col("v").cast("double"), F.col("m")
        n, total, square = F.sum(own(m)), F.sum(own(v * m)), F.sum(own(v * v * m))
        pick = lambda pos, own=own: F.min(own(F.when(F.col("upto") > pos, F.col("v"))))
        out += [
            (total / n).alias(f"{c}_mean"), F.sqrt(F.greatest(square / n - (total / n) * (total / n), F.lit(0.0))).alias(f"{c}_stdev"), F.min(own(F.col("v"))).alias(f"{c}_min"), F.max(own(F.col("v"))).alias(f"{c}_max"),
            pick(F.floor(F.col("total") / 2)).alias(f"{c}_median"), pick(F.floor(0.25 * (F.col("total") - 1))).alias(f"{c}_p25"), pick(F.floor(0.75 * (F.col("total") - 1))).alias(f"{c}_p75"),
        ]
    return hist.agg(*out)
