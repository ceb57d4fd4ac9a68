"""Problem 10: the reading level of each document.

Classic readability formulas are computed for each sentence from its words, letters, long words
and syllables, the last counted by hyphenation-style rules (vowel groups less mute endings;
in Indic scripts one per consonant or vowel sign group; in Han and kana one per character).
Each formula grades the sentence: its value is put on the scale of the graded passages, where 1
and 4 are what it typically gives in a language's easiest and hardest passages. The sentence's
grade is the median of these grades. The share of sentences whose grade is a hard one then makes
the document's level, by one mapping a language that is fitted on the graded passages. All counting runs inside the JVM.

Results for odd input: null texts, texts under the least length and texts without a letter
give no row; a language without graded passages uses the mean of the others; repeated rows
are graded each; an empty table gives none, and without graded passages there is no level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let

MIN_CHARS = 300
LEVELS = (1, 2, 3, 4)
#: At most so many graded passages are fitted on.
FIT_ROWS = 10_000
#: A formula grades in a language if one bound tells the easiest from the hardest passages' sentences with no more errors (shares of both) than this.
MOST_ERRORS = 0.12

# Abbreviations whose full stop ends no sentence, and words that carry one on.
_ABBR = "Dr|Prof|No|no|nos|vol|pp|p|fig|cf|approx|c|al|St|env|apr|av|art|chap|Nr|Bd|S|vgl|ca|z|h|u|d|a|n|M|e\\.g|i\\.e|[A-Z]|ಡಾ|ಪ್ರೊ|ಸಂ|ಪು|ಶ|ಪೂ|ಕಿ|ಕ್ರಿ|डॉ|प्रो|सं|पृ|ई|कि"
_CARRY = "ಇದೆ|ಉದ್ದ|है|लंबी|ಎಂದು|ಎಂಬ|ने "
_UNITS = "เมตร|คน|แห่ง|อย่าง|ยืนยัน"
# White space between sentences; it is matched first, so that other characters cost one test each.
SPACED = f"\\s+(?:(?<=\\n)|(?<=[.!?؟…।॥۔”\"»]\\s)(?<!(?<![\\p{{L}}\\p{{M}}])(?:{_ABBR})\\.\\s)(?<![^.!?؟…।॥۔\\s][”\"»]\\s)(?![\\p{{Ll}}\\p{{Nd}}।॥]|{_CARRY}))"
HAN = "(?<=[。！？])(?![”」』])|\\n+"
THAI = f"\\s+(?:(?<=\\n)|(?<=[฀-๿]\\s)(?=[฀-๿])|(?<=[\\d]\\s)(?!{_UNITS})(?=[฀-๿]))"

_V = "aeiouyäöüàâéèêëîïôûùœáíóúAEIOUYÄÖÜÉÈ"
# What a vowel group, and a mute final e, look like; every match stands for one syllable.
_GROUPS = f"[^{_V}]*+[{_V}]++|[^{_V}]++$"
_MUTE = f"(?<=[^{_V}\\W])es?(?!\\p{{L}})"
# Scripts with one syllable per sign: what counts, and what takes one away (a virama).
SIGNS = {"kn": ("ಅ-ಹ", "್"), "hi": ("\\u0905-\\u0939", "\\u094D"), "ur": ("اآویےہعی", None), "th": ("ะ-ูเ-ไๅ็", None), "ja": ("ぁ-んァ-ヴ一-鿿", None), "zh": ("一-鿿", None)}
UNSPACED = ("th", "ja", "zh")
LONG = "[\\p{L}\\p{M}]{7,}"
FORMULAS = ("kincaid", "ari", "strain", "rix", "lix")


def _cases(language: Column, by: dict[str, Column], rest: Column) -> Column:
    out = None
    for k, v in by.items():
        out = F.when(language == k, v) if out is None else out.when(language == k, v)
    return out.otherwise(rest)


def language_of(text: Column) -> tuple[Column, Column]:
    """The script's language (``en?`` for Latin) and the language by function words; a ``lang`` column is not trusted."""
    n = F.length(text)
    share = lambda cls, least: n - F.length(F.regexp_replace(text, F.lit(f"[{cls}]+"), F.lit(""))) > least * n

    def hits(*words: str) -> Column:
        return sum(((F.length(text) - F.length(F.replace(text, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2.0) for w in words), F.lit(0.0))

    de, fr, en = hits("der", "die", "von", "und", "in"), hits("le", "la", "de", "des", "un"), hits("the", "of", "and", "is", "in", "by", "at", "to")
    script = (
        F.when(share("ಀ-೿", 0.25), "kn").when(~text.rlike("[\\u0300-\\u1FFF\\u3040-\\uDFFF]"), "en?").when(share("\\u0900-\\u097F", 0.25), "hi")
        .when(share("ぁ-ヿ", 0.08), "ja").when(share("一-鿿", 0.2), "zh").when(share("฀-๿", 0.25), "th").when(share("؀-ۿ", 0.25), "ur").otherwise("en?")
    )
    return script, F.when((de > en) & (de > fr), "de").when(fr > en, "fr").otherwise("en")


def sentence_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, the language, and per sentence letters l, words w, syllables y and long words g."""
    script, latin = language_of(F.col(text))
    df = df.withColumn("_script", script).withColumn("language", F.when(F.col("_script") == "en?", latin).otherwise(F.col("_script")))
    lang = F.col("language")
    only = lambda s, cls: F.length(F.regexp_replace(s, F.lit(f"[^{cls}]+"), F.lit("")))
    groups = lambda s: F.length(F.regexp_replace(s, F.lit(_GROUPS), F.lit("x")))

    def syllables(s: Column) -> Column:
        by = {k: only(s, cls) - (only(s, off) if off else 0) for k, (cls, off) in SIGNS.items()}
        return _cases(lang, by | {"de": groups(s)}, groups(F.regexp_replace(s, F.lit(_MUTE), F.lit(""))))

    one = lambda s: F.struct(
        F.length(s).alias("l"),
        F.when(lang.isin(*UNSPACED), F.length(s) / 2.0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1.0).alias("w"),
        syllables(s).alias("y"),
        F.regexp_count(s, F.lit(LONG)).alias("g"),
    )
    split = F.when(lang.isin("ja", "zh"), F.split(F.col(text), HAN)).when(lang == "th", F.split(F.col(text), THAI)).otherwise(F.split(F.col(text), SPACED))
    df = df.withColumn("_parts", F.filter(split, lambda s: F.length(F.trim(s)) > 3))
    return df.select(*keep, "language", F.transform("_parts", one).alias("sentences"))


def formula(name: str, s: Column | dict):
    """A formula's value for one sentence; ``s`` is a struct column or a row."""
    l, w, y, g = (s.getField(k) if isinstance(s, Column) else float(s[k] or 0) for k in "lwyg")
    return {
        "kincaid": 0.39 * w + 11.8 * y / w - 15.59,
        "ari": 4.71 * l / w + 0.5 * w - 21.43,
        "strain": 0.3 * y,
        "rix": 1.0 * g,
        "lix": w + 100.0 * g / w,
    }[name]


def _bound(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """The bound that parts low from high values best, and the sum of both error shares."""
    cuts = np.unique(np.concatenate([low, high]))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if not len(cuts):
        return 0.0, 2.0
    errors = np.array([(low > c).mean() + (high <= c).mean() for c in cuts])
    return float(cuts[errors <= errors.min() + 1e-9].mean()), float(errors.min())


def fit(rows: list) -> dict[str, dict]:
    """Per language ``scale`` (by formula the values of grades 1 and 4), ``hard`` (the grade that hard sentences exceed), ``shares`` (of hard sentences, by level)."""
    out = {}
    for lang in sorted({r["language"] for r in rows}):
        own = [(r["reading_level"], r["sentences"]) for r in rows if r["language"] == lang and r["sentences"]]
        by = lambda level, own=own: [s for k, sents in own if k == level for s in sents]
        easy, hard = by(LEVELS[0]), by(LEVELS[-1])
        if not easy or not hard or {k for k, _ in own} != set(LEVELS):
            continue
        scale = {}
        for f in FORMULAS:
            low, high = (np.array([formula(f, s) for s in sents]) for sents in (easy, hard))
            one, four = float(np.median(low)), float(np.median(high))
            if four > one and _bound(low, high)[1] <= MOST_ERRORS:
                scale[f] = (one, four)
        if not scale:
            continue
        grade = lambda s, scale=scale: float(np.median([1 + 3 * (formula(f, s) - one) / (four - one) for f, (one, four) in scale.items()]))
        cut, _ = _bound(np.array([grade(s) for s in easy]), np.array([grade(s) for s in hard]))
        shares = [float(np.mean([np.mean([grade(s) > cut for s in sents]) for k, sents in own if k == level])) for level in LEVELS]
        if all(b > a for a, b in zip(shares, shares[1:])):
            out[lang] = {"scale": scale, "hard": cut, "shares": shares}
    return out


def pooled(fitted: dict[str, dict]) -> dict:
    """What languages without passages use: the means of the others."""
    scale = {f: tuple(float(x) for x in np.mean([v["scale"][f] for v in fitted.values() if f in v["scale"]], axis=0)) for f in FORMULAS if any(f in v["scale"] for v in fitted.values())}
    return {"scale": scale, "hard": float(np.mean([v["hard"] for v in fitted.values()])), "shares": np.mean([v["shares"] for v in fitted.values()], axis=0).tolist()}


def reading_levels(documents: DataFrame, graded_passages: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, reading_level, grade) of the documents of at least ``min_chars`` characters."""
    spark = documents.sparkSession
    passages = graded_passages.where("text IS NOT NULL AND reading_level IS NOT NULL").orderBy(F.xxhash64("text")).limit(FIT_ROWS)
    fitted = fit(sentence_counts(passages, "text", ["reading_level"]).collect())
    docs = documents.where(F.length("text") >= min_chars).where(F.col("text").rlike("\\p{L}")).select(F.col(key).cast("bigint").alias("doc_id"), "text")
    if not fitted:
        return docs.select("doc_id", F.lit(None).cast("int").alias("reading_level"), F.lit(None).cast("double").alias("grade")).where("false")
    by = fitted | {"*": pooled(fitted)}
    table = spark.createDataFrame([(k, [list(v["scale"][f]) if f in v["scale"] else None for f in FORMULAS], v["hard"], v["shares"]) for k, v in by.items()], "language string, scale array<array<double>>, hard double, shares array<double>")  # a row per language
    counted = sentence_counts(docs, "text", ["doc_id"])
    known = F.when(F.col("language").isin(list(fitted)), F.col("language")).otherwise("*")
    scored = counted.withColumn("language", known).join(F.broadcast(table), "language", "left")  # an inner join would evaluate the language twice

    def grade(s: Column) -> Column:
        """The median of the formulas' grades of a sentence."""
        each = []
        for k, f in enumerate(FORMULAS):
            one, four = F.col("scale")[k][0], F.col("scale")[k][1]
            each.append(1 + 3 * (formula(f, s) - one) / (four - one))
        return let(F.array_sort(F.array_compact(F.array(*each))), lambda g: (F.element_at(g, F.floor((F.size(g) + 1) / 2).cast("int")) + F.element_at(g, F.floor((F.size(g) + 2) / 2).cast("int"))) / 2)

    hard = F.size(F.filter("sentences", lambda s: grade(s) > F.col("hard")))
    x = F.col("share")
    m = [F.col("shares")[i] for i in range(4)]
    b = [(m[i] + m[i + 1]) / 2 for i in range(3)]
    steps = [(x - m[i]) / (b[i] - m[i]) * 0.5 + (i + 1) for i in range(3)]
    rest = [(x - b[i]) / (m[i + 1] - b[i]) * 0.5 + (i + 1.5) for i in range(3)]
    level = F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.when(x < b[0], steps[0]).when(x < m[1], rest[0]).when(x < b[1], steps[1]).when(x < m[2], rest[1]).when(x < b[2], steps[2]).otherwise(rest[2])))
    shares = scored.select("doc_id", "shares", (hard / F.greatest(F.size("sentences"), F.lit(1))).alias("share"))
    return shares.select("doc_id", level.alias("grade")).select("doc_id", F.floor(F.col("grade") + 0.5).cast("int").alias("reading_level"), "grade")
