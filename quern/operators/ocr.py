"""Choice between native and recognised text, and error rates against transcriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import IngestConfig
from quern.functions import overlap as ov
from quern.functions import text as tx


def choose_text(pages: DataFrame, native: str = "native_text", ocr: str = "ocr_text", cfg: IngestConfig | None = None, normalised: bool = True) -> DataFrame:
    """``pages`` with text, used_ocr, ocr_attempted, ocr_rejected, native_chars, ocr_chars and kannada_ratio.

    Recognition is tried below the threshold of native characters and taken if longer (or always, if so configured);
    a null recognised text stands for a failed attempt. The counts are of the texts before normalisation.
    """
    cfg = cfg or IngestConfig()
    n, o = tx.strip(F.coalesce(F.col(native), F.lit(""))), tx.strip(F.col(ocr))
    tried = F.length(n) < cfg.ocr_char_threshold
    better = F.lit(not cfg.keep_ocr_only_if_longer) | (F.length(o) > F.length(n))
    used = tried & o.isNotNull() & better
    text = F.when(used, o).otherwise(n)
    rows = pages.withColumns({
        "ocr_attempted": tried, "used_ocr": used, "ocr_rejected": tried & ~used,
        "native_chars": F.length(n), "ocr_chars": F.when(tried, F.coalesce(F.length(o), F.lit(0))).otherwise(0),
        "text": tx.normalise(text, cfg.unicode_form) if normalised and cfg.normalise_unicode else text,
    })
    return rows.withColumn("kannada_ratio", tx.script_ratio(F.col("text")))


def ingest_summary(pages: DataFrame) -> DataFrame:
    """One row of counts and means over the pages."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return pages.agg(
        F.count(F.lit(1)).alias("n_pages"), yes("used_ocr").alias("n_ocr_pages"), yes("ocr_attempted").alias("n_ocr_attempted"), yes("ocr_rejected").alias("n_ocr_rejected"),
        F.try_divide(yes("used_ocr").cast("double"), F.count(F.lit(1)).cast("double")).alias("ocr_page_fraction"),
        F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).alias("n_empty_pages"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("mean_chars"), F.avg("kannada_ratio").alias("mean_ratio"),
    )


def last_of_page(pages: DataFrame, order: str) -> DataFrame:
    """The last row by ``order`` of each (source_file, page)."""
    w = Window.partitionBy("source_file", "page").orderBy(F.desc(order))
    return pages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def whole_transcriptions(chunks: DataFrame) -> DataFrame:
    """Rows (source_file, page, transcription): the distinct chunks of a page in the order of char_start, overlaps once.

    char_start counts in the transcription. Chunks are stripped, so what lies between two that don't touch
    was white space, and is filled with as many spaces. Bounded by a page.
    """
    piece = F.when(F.col("text").isNotNull(), F.struct("char_start", "text"))
    pieces = chunks.groupBy("source_file", "page").agg(F.array_sort(F.collect_set(piece)).alias("pieces"))

    def add(done: Column, x: Column) -> Column:
        over = F.length(done) - x["char_start"]
        return F.concat(done, F.repeat(F.lit(" "), -over), F.substring(x["text"], F.greatest(over, F.lit(0)) + 1, F.length(x["text"])))

    return pieces.select("source_file", "page", F.when(F.size("pieces") > 0, F.aggregate("pieces", F.lit(""), add)).alias("transcription"))


def match_transcriptions(transcriptions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) transcriptions by source_file and page."""
    keys = ["source_file", "page"]
    return transcriptions.join(pages.select(*keys, "text", "used_ocr"), keys), transcriptions.join(pages.select(*keys), keys, "left_anti")


def error_rates(matched: DataFrame) -> DataFrame:
    """``matched`` with cer, wer, ref_chars and hyp_chars."""
    hyp, ref = F.col("text"), F.col("transcription")
    return matched.withColumns({"cer": ov.character_error_rate(hyp, ref), "wer": ov.word_error_rate(hyp, ref), "ref_chars": F.size(tx.graphemes(tx.normalise(ref))), "hyp_chars": F.size(tx.graphemes(tx.normalise(hyp)))})


def _in_blocks(rates: DataFrame) -> DataFrame:
    """Each page in the block ``all`` and in ``ocr`` or ``native``."""
    own = F.when(F.coalesce(F.col("used_ocr"), F.lit(False)), "ocr").otherwise("native")
    return rates.withColumn("block", F.explode(F.array(own, F.lit("all"))))


def _every_block(blocks: DataFrame, n: str = "n") -> DataFrame:
    names = blocks.sparkSession.createDataFrame([("ocr",), ("native",), ("all",)], "block string").coalesce(1)
    return names.join(blocks, "block", "left").na.fill(0, [n])


def error_blocks(rates: DataFrame) -> DataFrame:
    """Rows (block, n, cer, wer) for recognised, native and all pages, in one pass; a block without pages has n 0."""
    value = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    return _every_block(_in_blocks(rates).groupBy("block").agg(F.count(F.lit(1)).alias("n"), value("cer"), value("wer")))


def evaluate(transcriptions: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """The evaluation of recognised text: ``summary`` of the pages, ``per_page`` rates, ``unmatched`` transcriptions and ``blocks``.

    blocks: block, n, and mean, std, ci_low, ci_high of cer and wer over the pages, which are as many as were transcribed by hand.
    """
    from quern.operators import stats
    from quern.session import durable

    matched, missing = match_transcriptions(transcriptions, pages)
    rates = durable(error_rates(matched).select("source_file", "page", "used_ocr", "cer", "wer", "ref_chars", "hyp_chars"))
    rows = _in_blocks(rates)
    out = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    for c in ("cer", "wer"):
        told = stats.describe(rows.where(~F.isnan(c)).select("block", c, F.concat_ws("#", "source_file", F.lpad(F.col("page").cast("string"), 9, "0")).alias("_at")), ["block"], c, "_at")
        out = out.join(told.select("block", *(F.col(x).alias(f"{c}_{x}") for x in ("mean", "std", "ci_low", "ci_high"))), "block", "left")
    return {"summary": ingest_summary(pages), "per_page": rates, "unmatched": missing.select("source_file", "page"), "blocks": _every_block(out)}
