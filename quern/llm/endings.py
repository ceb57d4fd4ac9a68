"""How well the last words of a text can close a sentence, learned from the texts themselves.

Words that are frequent in their script class stay as they are, numbers become ``#`` and other
words keep their last letters only. A closing context is the last one to three words (up to
fourteen characters in scripts without spaces); its terminality is the share of its
occurrences in the corpus that end a sentence. Counts cover all rows. Contexts are kept as 64-bit keys, made for a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import sentences
from quern.llm.scripts import CLOSE_QUOTES, CLOSERS, OPEN_QUOTES, PAIRS, TERMINATORS
from quern.session import durable

#: A word stays itself where at least this share of its script class's words are it; so at most 1000 per class do.
FREQUENT = 1e-3
#: A context seen less often than this is passed over for a shorter one.
LEAST_SEEN = 4
#: Below these shares a closing context doesn't end a sentence. Thai has no marks, so most complete texts end openly there.
LIMITS = {"words": 0.15, "cjk": 0.3, "thai": 0.025}

_TOKENS = regex.compile(r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{Katakana}ー]+|[\p{Han}\p{Hiragana}\p{Thai}]|[\p{L}\p{M}‌‍'’]+|[^\s\p{L}\p{M}\p{Nd}]")
_CHAR = regex.compile(r"[\p{Han}\p{Hiragana}\p{Thai}]")
_CITE = re.compile(r"(?:\s*(?:\[\d+\]|\((?:file|ಕಡತ|source|p\.|pp\.)[^()\n]*\)))+\s*$")
_DOTS = re.compile(r"(?:\.{2,}|…)\s*$")
_KEY = regex.compile(r"\p{Kannada}|\p{Devanagari}|\p{Arabic}|\p{Thai}|\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Latin}")
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")


def words(text: str) -> list[str]:
    return _TOKENS.findall(text)


def word_class(word: str) -> str:
    """The script class whose frequency counts for a word."""
    c = word[0]
    return "d" if c.isdigit() else "k" if "ಀ" <= c <= "೿" else "h" if "ऀ" <= c <= "ॿ" else "a" if "؀" <= c <= "ۿ" else "c" if ord(c) > 0x2FFF else "t" if "฀" <= c <= "๿" else "l" if c.isalpha() else "p"


def mask(word: str, frequent: frozenset[str]) -> str:
    if word[0].isdigit():
        return "#"
    if word in frequent or not word[0].isalpha():
        return word
    return ("R:" if len(word) > 3 else "r:") + word[-3:]


def code_of(masked: str) -> tuple[int, bool]:
    """A masked token as a number, and whether it is a character of a script without spaces."""
    return xxhash.xxh64_intdigest(masked), bool(_CHAR.match(masked))


DEPTHS = {False: (3, 2, 1), True: (14, 9, 5, 3)}
_MIX, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(xxhash.xxh64_intdigest("<s>"))


def contexts(codes: np.ndarray, place: np.ndarray, char: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Per depth the positions of ``at`` whose contexts have it, its rank (0: the longest) and the contexts as 64-bit keys.

    A context is the tokens up to a position, at most so many as the depth says and with a sign for the sentence's start where it reaches
    there. codes: the tokens of all sentences in a row; place: each one's place in its sentence; char: whether it is a character.
    """
    out, last, started = [], codes[at].copy(), np.zeros(len(at), bool)
    live = np.arange(len(at))
    for m in range(1, max(DEPTHS[True]) + 1):
        if m > 1:
            if m > max(DEPTHS[False]):
                live = live[char[at[live]]]
            here = at[live]
            inside = place[here] >= m - 1
            grown, fresh = live[inside], live[~inside & ~started[live]]
            last[grown] = (last[grown] ^ (last[grown] >> np.uint64(31))) * _MIX + codes[at[grown] - (m - 1)]
            last[fresh] = (last[fresh] ^ (last[fresh] >> np.uint64(31))) * _MIX + _START
            started[fresh] = True
        for kind, depths in DEPTHS.items():
            if m in depths:
                own = live[char[at[live]] == kind]
                if len(own):
                    key = (last[own] ^ np.uint64(m)) * _MIX
                    out.append((own, depths.index(m), (key ^ (key >> np.uint64(29))).view(np.int64)))
    return out


def body(text: str) -> str:
    """The text without trailing citations and white space."""
    return _CITE.sub("", text).rstrip() if text else ""


def closes(text: str, inner: frozenset[str] = frozenset()) -> bool | None:
    """True where the last mark ends a sentence, False where it can't, None where the words must tell.

    A trailing ellipsis is no end. A full stop after an abbreviation (``inner``, learnt with the sentence model) is none.
    """
    t = body(text)
    if not t:
        return None
    if t[-1] == "\ufffd":  # half a character
        return False
    if _DOTS.search(t):
        return None if _DOTS.sub("", t) else False
    core = t.rstrip(CLOSERS + CLOSE_QUOTES + " ")
    mark = core[-1:]
    if mark not in TERMINATORS:
        return None if mark not in ",;:、，；：،–-(" + OPEN_QUOTES else False
    if mark == ".":
        token = re.split(r"[\s(（“«„「\"–'’]", core[:-1])[-1].rstrip(".").lower()
        if token in inner:
            return False
        if len(token) == 1 and token.isalpha() and core[-2].isupper():
            return False
    return True


# Tags that hold nothing.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SIGNS = regex.compile(r"""(?P<fence>^\s*(?:```|~~~)|```)|(?P<code>`)|(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>\n]*)?(?P<void>/)?>)|(?P<cut><[A-Za-z/][^<>\n]{0,200}\Z)|(?P<bold>\*\*|__)|(?P<item>^[ \t]*(?:[-*•+]|\d{1,3}[.)])(?=\s|\Z))|(?P<cell>^[ \t]*\|)|(?P<line>\n)|(?P<sign>[()\[\]{}（）「」『』«»【】„“”"])""", regex.M)
_CLOSING = frozenset(PAIRS.values()) | {"”", "“"}


def stack(text: str) -> list[str]:
    """What is still open at the end: fences, code, brackets, quotations, tags, bold marks, list items and table rows, by a pushdown parser.

    Within a fence or code only its end counts. A line break ends a list item's head and a table row, and a blank line
    inline code and bold. A closer without its opener is passed over: the text may start within it. A list item is open
    while it has no text (only a number that goes on counting or a bullet that was there before makes one), a table row
    while its last cell has no end.
    """
    open_: list[str] = []
    items: set[str] = set()

    def close(what: str) -> bool:
        if what in open_:
            while open_.pop() != what:
                pass
            return True
        return False

    at = 0
    for m in _SIGNS.finditer(text):
        kind, sign = m.lastgroup if m.lastgroup not in ("name", "void") else "tag", m.group()
        if open_ and open_[-1] == "item" and text[at : m.start()].strip():
            open_.pop()
        at = m.end()
        top = open_[-1] if open_ else ""
        if top == "```" and kind != "fence":
            continue
        if top == "`" and kind not in ("code", "line"):
            continue
        if kind == "fence":
            close("```") or open_.append("```")
        elif kind == "code":
            close("`") or open_.append("`")
        elif kind == "cut":
            open_.append(">")
        elif kind == "tag":
            name = m.group("name").lower()
            if sign.startswith("</"):
                close(f"</{name}>")
            elif not m.group("void") and name not in VOID:
                open_.append(f"</{name}>")
        elif kind == "bold":
            close(sign) or open_.append(sign)
        elif kind == "item":
            mark = sign.strip().rstrip(".)")
            if (str(int(mark) - 1) if mark.isdecimal() else mark) in items:
                open_.append("item")
            items.add(str(int(mark)) if mark.isdecimal() else mark)
        elif kind == "cell":
            open_.append("|")
        elif kind == "line":
            if top in ("item", "|"):
                open_.pop()
            if text[m.end() : m.end() + 1] == "\n":
                for what in ("`", "**", "__"):
                    close(what)
        elif sign == "“" and top == "“":  # „...“
            open_.pop()
        elif sign == "„":
            open_.append("“")
        elif sign == "“":
            open_.append("”")
        elif sign in PAIRS:
            open_.append(PAIRS[sign])
        elif sign == '"':
            close('"') or open_.append('"')
        elif sign in _CLOSING:
            close(sign)
    if open_ and open_[-1] == "item" and text[at:].strip():
        open_.pop()
    if open_ and open_[-1] == "|" and text.rstrip().endswith("|") and text[at:].strip():
        open_.pop()
    return open_


def count_words(df: DataFrame, text: str) -> DataFrame:
    """Rows (word, n), pre-aggregated per batch."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(w for t in b.t for w in words(t))
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text: str) -> frozenset[str]:
    """The words that stay as they are: at most 1 / FREQUENT of each script class."""
    counted = count_words(df, text).withColumn("c", F.when(F.col("word").rlike("^[0-9]"), "d").when(F.col("word").rlike("^[ಀ-೿]"), "k").when(F.col("word").rlike("^[ऀ-ॿ]"), "h").when(F.col("word").rlike("^[؀-ۿ]"), "a").when(F.col("word").rlike("^[฀-๿]"), "t").when(F.col("word").rlike("^[぀-鿿]"), "c").when(F.col("word").rlike("^\\p{L}"), "l").otherwise("p"))
    total = counted.groupBy("c").agg(F.sum("n").alias("total"))
    return frozenset(r.word for r in counted.join(F.broadcast(total), "c").where((F.col("n") >= FREQUENT * F.col("total")) & (F.col("n") > 1)).select("word").collect())


def _lines(text: str, model: dict) -> Iterator[tuple[str, bool]]:
    """Sentence units and whether each is known to be complete."""
    spans = sentences.units(text, model)
    last_line = max(text.rfind("\n"), 0)
    for k, (a, b) in enumerate(spans):
        unit = text[a:b]
        yield unit, k + 1 < len(spans) or (closes(unit, model["known"]["inner"]) is True and b >= last_line)


def context_counts(df: DataFrame, text: str, frequent: frozenset[str], model: dict) -> DataFrame:
    """Rows (context, n_end, n_all): how often a context occurs and how often it ends a sentence."""
    shared = df.sparkSession.sparkContext.broadcast((frequent, model))  # both bounded

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq, m = shared.value
        memo: dict[str, tuple[int, bool]] = {}
        for b in batches:
            found: list[tuple[int, bool]] = []
            sizes: list[int] = []
            closed: list[bool] = []
            for t in b.t:
                for unit, whole in _lines(body(t), m):
                    core = unit.rstrip(TERMINATORS + CLOSERS + CLOSE_QUOTES + " ")
                    toks = [memo.get(w) or memo.setdefault(w, code_of(mask(w, freq))) for w in words(core)]
                    found += toks
                    sizes.append(len(toks))
                    closed.append(whole)
                if len(memo) > 500_000:
                    memo.clear()
            n = np.array(sizes, np.int64)
            end = np.repeat(np.cumsum(n), n) - 1  # each token's last neighbour
            place = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
            is_end = np.arange(len(found)) == end
            at = np.flatnonzero(~is_end | np.repeat(np.array(closed, bool), n))  # how an unknown end goes on isn't told
            codes, char = np.fromiter((c for c, _ in found), np.uint64, len(found)), np.fromiter((c for _, c in found), bool, len(found))
            parts = contexts(codes, place, char, at)
            keys = np.concatenate([k for *_, k in parts]) if parts else np.zeros(0, np.int64)
            ends = np.concatenate([is_end[at[own]] for own, *_ in parts]) if parts else np.zeros(0, bool)
            key, where = np.unique(keys, return_inverse=True)
            yield pd.DataFrame({"context": key, "n_end": np.bincount(where, ends, len(key)).astype(np.int64), "n_all": np.bincount(where, minlength=len(key))})

    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("t"))
    return rows.mapInPandas(count, "context bigint, n_end bigint, n_all bigint").groupBy("context").agg(F.sum("n_end").alias("n_end"), F.sum("n_all").alias("n_all"))


def open_endings(df: DataFrame, key: str, text: str, frequent: frozenset[str], model: dict) -> DataFrame:
    """Rows (key, kind, script, head, depth, context) of the texts whose marks don't close them.

    kind: ``cut`` (marks alone show that it breaks off), ``name`` (a bare name or number, as
    answer or list item) or ``open`` (the contexts follow, one row each). head: the first
    context holds a whole short text in a script without spaces.
    """
    shared = df.sparkSession.sparkContext.broadcast((frequent, model))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq, m = shared.value
        for b in batches:
            out = []
            for k, t in zip(b.k, b.t):
                t = body(t)
                if not regex.search(r"[\p{L}\p{N}]", t):
                    continue
                if stack(t):
                    out.append((k, "cut", "", False, 0, None))
                    continue
                done = closes(t, m["known"]["inner"])
                if done is not None:
                    if not done:
                        out.append((k, "cut", "", False, 0, None))
                    continue
                spans = sentences.units(t, m)
                unit = _DOTS.sub("", t[spans[-1][0] : spans[-1][1]]).rstrip(TERMINATORS + CLOSERS + CLOSE_QUOTES + " ")
                raw = words(_BULLET.sub("", unit))
                toks = [code_of(mask(w, freq)) for w in words(unit)]
                if not raw:
                    continue
                alone = len(spans) == 1 or _BULLET.match(unit)
                if alone and len(raw) == 1 and raw[0] not in freq:
                    out.append((k, "name", "", False, 0, None))
                    continue
                script = "thai" if "฀" <= raw[-1][0] <= "๿" else "cjk" if ord(raw[-1][0]) > 0x2FFF else "words"
                n = len(toks)
                for _, d, c in contexts(np.array([c for c, _ in toks], np.uint64), np.arange(n), np.array([c for _, c in toks], bool), np.array([n - 1])):
                    out.append((k, "open", script, bool(alone) and d == 0 and script != "words" and len(raw) <= 10, d, int(c[0])))
            yield pd.DataFrame(out, columns=["key", "kind", "script", "head", "depth", "context"], dtype=object)  # keys must not become floats

    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(find, "key bigint, kind string, script string, head boolean, depth int, context bigint")


def broken_off(df: DataFrame, key: str, text: str, per_script: int = sentences.TRAIN_PER_SCRIPT) -> DataFrame:
    """Rows (key, terminality) of the texts that break off before their last sentence is complete.

    ``key`` is unique. Texts that end with a sentence mark, a bare name or a list of names
    are complete; open brackets and quotations, trailing commas and abbreviations break off;
    the rest is decided by the terminality of its closing context against LIMITS.
    """
    model = sentences.learn(df.select(text), text, per_script)
    frequent = frequent_words(df, text)
    ends = durable(open_endings(df, key, text, frequent, model))
    contexts_ = ends.where("kind = 'open'").select("key", "script", "head", "depth", "context")
    counts = context_counts(df, text, frequent, model)
    seen = contexts_.join(counts, "context", "left").na.fill(0, ["n_end", "n_all"])
    enough = F.col("n_all") >= F.when((F.col("script") == "words") | (F.col("depth") < 2), LEAST_SEEN).otherwise(3 * LEAST_SEEN)
    best = seen.groupBy("key", "script").agg(
        F.min_by(F.struct("n_end", "n_all"), F.when(enough, F.col("depth"))).alias("c"),
        F.bool_or(F.col("head") & (F.col("n_all") < LEAST_SEEN)).alias("short_name"),
    )
    limit = F.when(F.col("script") == "thai", LIMITS["thai"]).when(F.col("script") == "cjk", LIMITS["cjk"]).otherwise(LIMITS["words"])
    share = F.coalesce(F.try_divide(F.col("c.n_end"), F.col("c.n_all")), F.lit(0.0))
    scored = best.where(~F.col("short_name")).select("key", share.alias("terminality"), limit.alias("limit")).where("terminality < limit").drop("limit")
    return scored.unionByName(ends.where("kind = 'cut'").select("key", F.lit(0.0).alias("terminality")))
