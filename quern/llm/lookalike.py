"""Problem 3: one character form for texts that look alike.

Per token the resolved script set is the intersection of its characters' script extensions.
An empty set is a mixed-script token; a set whose characters all have look-alikes in the
text's main script is a whole-script confusable. Both are respelt in one script; widths,
spaces, zero-width characters and composition are normalised afterwards. Compatibility
differences that can be seen (raised digits, ligatures, case, accents, joiners that change
the shaping) stay.

Results for odd input: null gives null, empty gives empty; text without look-alikes only has
its widths and composition normalised; texts equal character by character are copies, not
pairs; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.scripts import script_set

# Look-alike letters, each row as the same shape in the scripts named.
ALIKE = {
    ("Cyrillic", "Latin"): "А A В B Е E Ѕ S І I Ј J К K М M Н H О O Р P С C Т T Х X У Y Ү Y Ԛ Q Ԝ W а a с c ԁ d е e һ h і i ј j ӏ l о o р p ԛ q ѕ s ѵ v ԝ w х x у y ё ë ї ï",
    ("Greek", "Latin"): "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X ο o ν v ι i α a ρ p υ u γ y κ k χ x ϲ c ϳ j",
    ("Telugu", "Kannada"): "ం ಂ ః ಃ అ ಅ ఆ ಆ ఇ ಇ ఌ ಌ ఒ ಒ ఓ ಓ ఔ ಔ జ ಜ ఞ ಞ ణ ಣ ద ದ న ನ బ ಬ ర ర య ಯ ఱ ಱ ల ಲ ళ ಳ ౠ ೠ ౡ ೡ ౦ ೦ ౧ ೧ ౨ ೨ ౯ ೯",
}
# Scripts that may stand in for each other; the first of a family is the default spelling.
FAMILIES = (("Latin", "Cyrillic", "Greek"), ("Kannada", "Telugu"))
# Characters without any width, and the two joiners.
ZERO_WIDTH = "­​⁠⁡⁢⁣⁤﻿᠎"
JOINERS = "‌‍"

PAIR_ROWS = 2000  # rows of a look that one task meets with the others

_TO: dict[str, dict[str, str]] = {}
for (_a, _b), _row in ALIKE.items():
    _cs = _row.split()
    for _x, _y in zip(_cs[::2], _cs[1::2]):
        if _x != _y:
            _TO.setdefault(_x, {}).setdefault(_b, _y)
            _TO.setdefault(_y, {}).setdefault(_a, _x)
_SUSPECT = re.compile("[Ͱ-ӿԀ-ԯఀ-౿]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_JOIN = re.compile(f"[{JOINERS}]+")
_SPACES = re.compile(r" {2,}")
_EDGE = re.compile(r" *\n *")
_ALEF = "ํา"


def _widths() -> dict[int, str | None]:
    """Wide and narrow forms to ordinary ones, every space to a blank, zero widths to nothing."""
    table: dict[int, str | None] = {ord(c): None for c in ZERO_WIDTH}
    for cp in [*range(0x2000, 0x2010), 0x20, 0xA0, 0x09, 0x202F, 0x205F, 0x3000, 0x1680, *range(0xFF00, 0xFFF0)]:
        kind, _, to = unicodedata.decomposition(chr(cp)).partition(" ")
        if unicodedata.category(chr(cp)) == "Zs" or cp == 0x09:
            table[cp] = " "
        elif kind in ("<wide>", "<narrow>"):
            table[cp] = "".join(chr(int(x, 16)) for x in to.split())
    table[ord("\r")] = "\n"
    return table


WIDTHS = _widths()


def respell(token: str, main: str | None) -> str:
    """The token in one script where its characters allow that."""
    sets = [(c, script_set(c)) for c in token]
    sets = [(c, s) for c, s in sets if s]
    if not sets:
        return token
    resolved = frozenset.intersection(*(s for _, s in sets))
    possible = lambda script: all(script in s or script in _TO.get(c, ()) for c, s in sets)
    if resolved:
        if main is None or main in resolved or not possible(main):
            return token
        target = main
    else:
        native = Counter(x for _, s in sets for x in s)
        family = next((f for f in FAMILIES if f[0] in native or f[1] in native), ())
        fits = [x for x in family if possible(x)]
        if not fits:
            return token
        target = max(fits, key=lambda x: (x == main, native[x], -family.index(x)))
    return "".join(_TO[c][target] if target in _TO.get(c, ()) and target not in script_set(c) else c for c in token)


def _main_script(text: str) -> str | None:
    count = Counter(x for c in text if c.isalpha() for x in script_set(c))
    return max(count, key=lambda x: (count[x], x)) if count else None


def _joiner(m: re.Match) -> str:
    """Joiners count only where they can change the shaping: after a virama or between joining letters."""
    text, at, to = m.string, m.start(), m.end()
    if at == 0 or to == len(text):
        return ""
    before, after = text[at - 1], text[to]
    if unicodedata.combining(before) == 9 or ("؀" <= before <= "ۿ" and "؀" <= after <= "ۿ"):
        return m.group()[0]
    return ""


def unify(text: str | None) -> str | None:
    """The text in one character form."""
    if not text:
        return text
    if text.isascii():
        return _EDGE.sub("\n", _SPACES.sub(" ", text.replace("\r\n", "\n").translate(WIDTHS))).strip()
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(WIDTHS))
    if "‌" in text or "‍" in text:
        text = _JOIN.sub(_joiner, text)
    text = text.replace(_ALEF, "ำ")
    if _SUSPECT.search(text):
        main = _main_script(text)
        text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: respell(m.group(), main), text))
    return _EDGE.sub("\n", _SPACES.sub(" ", text)).strip()


@F.pandas_udf(T.StringType())
def _unify_udf(text: pd.Series) -> pd.Series:
    return text.map(unify, na_action="ignore")


def unify_column(text: Column) -> Column:
    """Column form of :func:`unify`."""
    return _unify_udf(text)


def lookalike_classes(df: DataFrame, entity: str, key: str, text: str) -> DataFrame:
    """Rows (entity, id, form, look): every row's exact text and its unified form, as 128-bit digests.

    Rows whose text is null or has no visible character have no class.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    return (
        rows.withColumn("look", unify_column(F.col("text")))
        .where(F.length("look") > 0)
        .select(F.lit(entity).alias("entity"), "id", F.md5("text").alias("form"), F.md5("look").alias("look"))
    )


def lookalike_links(classes: DataFrame) -> DataFrame:
    """Rows (entity, id, class_id, n_links): every row's look, and how many rows look like it but differ in characters."""
    per_form = classes.groupBy("entity", "look", "form").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_form.groupBy("entity", "look").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("forms"))
    shared = per_form.join(sizes.where("forms > 1"), ["entity", "look"])  # looks of one form have no links
    found = classes.join(shared.select("entity", "look", "form", (F.col("rows") - F.col("n")).alias("n_links")), ["entity", "look", "form"], "left")
    return found.select("entity", "id", F.col("look").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def lookalike_pairs(classes: DataFrame) -> DataFrame:
    """Rows (entity, id_a, id_b), the smaller id first: rows that look alike and differ in characters.

    Only looks with two or more forms reach the join. A popular look is spread over tasks by its rows; the rows met
    there are those of all forms but the look's most frequent one, so that copies of one text aren't repeated to meet
    each other. What is repeated is thus bounded by the pairs that come out.
    """
    per_form = classes.groupBy("entity", "look", "form").agg(F.count(F.lit(1)).alias("n"))
    many = per_form.groupBy("entity", "look").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows"), F.max_by("form", F.struct("n", "form")).alias("main")).where("forms > 1")
    rows = classes.join(many.drop("forms"), ["entity", "look"])
    salts = F.greatest(F.lit(1), F.ceil(F.col("rows") / PAIR_ROWS)).cast("int")
    left = rows.select("entity", "look", F.col("form").alias("form_a"), F.col("id").alias("id_a"), (F.col("form") == F.col("main")).alias("is_main"), F.pmod(F.xxhash64("id"), salts.cast("bigint")).alias("salt"))
    right = rows.where("form <> main").select("entity", "look", F.col("form").alias("form_b"), F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))).alias("salt"))
    met = left.join(right, ["entity", "look", "salt"]).where("form_a <> form_b AND (is_main OR id_a < id_b)")
    return met.select("entity", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
