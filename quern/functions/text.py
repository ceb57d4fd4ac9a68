"""Text expressions: normalisation, script ratio, tokens, n-grams, sentences, graphemes.

All are Column to Column and run inside the JVM, but for Unicode composition, which Spark has no
function for and which is one Arrow UDF. Null gives null; empty gives the empty result.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The block that the script guard counts, and characters deleted by normalisation.
KANNADA = "\\x{0C80}-\\x{0CFF}"
JUNK = "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}\\x{FEFF}\\x{00AD}\\x{200B}\\x{2060}]"
BLANKS = "[\\t\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000} ]+"
TOKEN = "[\\x{0C80}-\\x{0CFF}\\x{200C}\\x{200D}]+|[A-Za-z]+|[0-9\\x{0CE6}-\\x{0CEF}]+"
SENTENCE_END = "(?<=[।॥.!?])(?U)\\s+"
WHITE = "(?U)^\\s+|\\s+$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def composed(text: Column, form: str = "NFC") -> Column:
    """Unicode normalisation to ``form``."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t.isascii() else unicodedata.normalize(form, t), na_action="ignore")

    return F.pandas_udf(run, T.StringType())(text)


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, WHITE, "")


def normalise(text: Column, form: str | None = "NFC") -> Column:
    """The form texts are indexed in. ``form`` None leaves composition out (for text known to be composed)."""
    t = composed(text, form) if form else text
    t = F.regexp_replace(t, JUNK, "")
    t = F.replace(F.replace(t, F.lit("||"), F.lit("॥")), F.lit("|"), F.lit("।"))
    t = F.regexp_replace(t, BLANKS, " ")
    t = F.regexp_replace(t, " *\\n *", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return strip(t)


def script_ratio(text: Column, block: str = KANNADA) -> Column:
    """The share of a script block among the characters that aren't white space; 0 for none."""
    inside = F.length(F.regexp_replace(text, f"[^{block}]", ""))
    total = F.length(F.regexp_replace(text, "(?U)\\s", ""))
    return F.when(total == 0, 0.0).otherwise(inside / total)


def is_mostly(text: Column, threshold: float = 0.5, block: str = KANNADA) -> Column:
    return script_ratio(text, block) >= threshold


def tokens(text: Column, keep_numerals: bool = True, form: str | None = "NFC") -> Column:
    """Metric tokens: script runs, Latin runs in lower case, digit runs."""
    raw = F.regexp_extract_all(composed(text, form) if form else text, F.lit(TOKEN), F.lit(0))
    clean = F.transform(raw, lambda t: F.when(t.rlike("^[A-Za-z]+$"), F.lower(t)).otherwise(F.regexp_replace(t, "[\\x{200C}\\x{200D}]", "")))
    keep = F.filter(clean, lambda t: t != "")
    if not keep_numerals:
        keep = F.filter(keep, lambda t: ~t.rlike("^[0-9\\x{0CE6}-\\x{0CEF}]+$"))
    return keep


def grams_of(joined: Column, n: int) -> Column:
    """The character n-grams of a string without spaces; a shorter one is its own only gram."""

    def grams(t: Column) -> Column:
        size = F.length(t)
        many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(t)).otherwise(many)

    return let(joined, grams)


def character_ngrams(text: Column, n: int = 4, form: str | None = "NFC") -> Column:
    return grams_of(F.array_join(tokens(text, form=form), ""), n)


def token_ngrams(toks: Column, n: int) -> Column:
    """The token n-grams as strings with a separator that no token has."""

    def grams(t: Column) -> Column:
        size = F.size(t)
        many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\x1f"))
        return F.when(size < n, F.array().cast("array<string>")).otherwise(many)

    return let(toks, grams)


def sentences(text: Column, form: str | None = "NFC") -> Column:
    """The normalised text split after danda, double danda, full stop, question and exclamation mark."""
    parts = F.transform(F.split(normalise(text, form), SENTENCE_END), strip)
    return F.filter(parts, lambda s: s != "")


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text, F.lit("\\X"), F.lit(0))


def excerpt(text: Column, size: int = 400) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def citation(file: Column, page: Column) -> Column:
    return F.concat(file, F.lit(" p."), page.cast("string"))


def page_id(file: Column, page: Column) -> Column:
    return F.concat(file, F.lit("#p"), page.cast("string"))
