"""Problem 1: sentence units of texts in many languages.

A linear-chain model tags the characters of each line as boundary or inside and is decoded
with Viterbi. A boundary can only stand after sentence marks and, in script without sentence marks
(Thai), at white space; all other characters are inside by definition, so the decoder keeps
the possible breaks only. The model is an averaged structured perceptron
trained per run on a bounded sample of the table's own texts. Its targets come from what lines tell over all rows, where
the ends of lines are boundaries for certain: a word with a full stop that hardly ever ends a line is an
abbreviation; a word that follows a full stop or a quotation but hardly ever begins a line, and always follows the same,
carries the sentence on; in Thai, text whose marks are stripped, what opens lines is weighed against what follows a number.
Both weights are ratios of likelihoods. Quotation nesting and the letter case that follows tell the rest.

Results for odd input: null, empty and letterless texts have no unit; a text without any
possible break is one unit per line; repeated rows give repeated units unless the caller
removes them; an empty table trains an empty model and gives no row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.scripts import OPEN_QUOTES, TERMINATORS
from quern.session import durable

#: Texts per script class that the model is trained on.
TRAIN_PER_SCRIPT = 350
EPOCHS = 5
#: How many single features the joint one weighs, so that what is known of a break overrules the words about it.
JOINT = 4

#: How often an abbreviation still ends a line, or a word that carries on begins one.
SLIP = 0.01
#: The logarithm of the ratio of likelihoods at which a word is believed to be one.
EVIDENCE = 8.0
#: The share of a carrying word's occurrences after marks that follow one and the same word.
SAME = 0.9
#: Words that make no more than this share of all that is counted aren't learnt, so that fewer than its inverse are.
RARE = 1e-6
#: Thai beginnings that open lines in no more than this share of cases continue a number.
THAI_OPEN = 0.1

_RUN = re.compile(rf"[{re.escape(TERMINATORS)}]+(?:[   ]?»)?[”\"“»」』’)\]）】]*")
_SPACES = frozenset(" \u00a0\u2009\u202f")
_QUOTE = re.compile('[«「『„“"”»」』]|\n(?=\n)')
_LETTER = re.compile(r"\w")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_THAI = re.compile("[฀-๿]")
_BLANK = re.compile(r"\s*")
_NEXT = re.compile(r"[^\s,.;:!?।॥。]*")
_BEFORE = frozenset(" \t\u00a0\u2009\u202f\u3000(（“«„「\"–'’。！？।॥۔؟!?")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")
_GAP = re.compile(r"[^\S\n\r]+")


def _class(ch: str) -> str:
    if not ch:
        return "end"
    if ch.isdigit():
        return "digit"
    if ch in OPEN_QUOTES or ch in "\"'([（":
        return "open"
    if ch.isupper():
        return "upper"
    if ch.islower():
        return "lower"
    return "uncased" if ch.isalpha() else "mark"


def _quotes(text: str) -> list[tuple[int, int, bool, bool]]:
    """Quotations as (start, end, opens a sentence, is whole); ends of a cut quotation are the text's."""
    out, start, mark = [], -1, ""
    floor = 0
    for m in _QUOTE.finditer(text):
        i, ch = m.start(), m.group()
        if ch == "\n":
            if start >= 0:
                out.append((start, i, False, False))
            start, floor = -1, i + 1
            continue
        opens = ch in "«「『„" or (ch == "“" and mark != "„")
        if ch == '"':
            opens = start < 0 and (i == 0 or text[i - 1].isspace()) and text[i + 1 : i + 2].strip() != ""
        if opens:
            if start < 0:
                start, mark = i, ch
        else:
            if start >= 0:
                before = text[max(floor, start - 8) : start].rstrip(" \u00a0\u2009\u202f")
                out.append((start, i + 1, not before or before[-1] in TERMINATORS + "\n", True))
            elif not out or out[-1][0] < floor:
                out.append((floor, i + 1, True, False))
            start, mark = -1, ""
    if start >= 0:
        out.append((start, len(text), False, False))
    return out


def _word_before(line: str, end: int) -> str:
    """The word that ends at a position, in lower case."""
    at = end
    while at and line[at - 1] not in _BEFORE:
        at -= 1
    return line[at:end].rstrip(".").lower()


def _opening(word: str) -> str:
    """What of the word after a break is counted: in scripts without spaces its first character."""
    return word[:1] if _UNSPACED.match(word) else word


def nodes(text: str, known: dict | None = None) -> list[tuple[int, int, list[tuple[int, dict]]]]:
    """For each line its start, end and possible breaks: position and what is known there. known: see :func:`conclude`."""
    inner, carrying = (known["inner"], known["carry"]) if known else ((), ())
    quotes = _quotes(text)
    starts = [a for a, *_ in quotes]  # quotations follow one another

    def inside(i: int) -> bool:
        k = bisect_left(starts, i) - 1
        return k >= 0 and i < quotes[k][1]

    ends = {b: (a, first, whole) for a, b, first, whole in quotes}
    lines: list = []
    for m in _LINE.finditer(text):
        lo, hi = m.span()
        line, found = m.group(), []
        for r in _RUN.finditer(line):
            at, first = lo + r.end(), r.start() - (r.start() > 0 and line[r.start() - 1] in _SPACES)
            while text[at - 1] in "“\"" and at not in ends:  # it opens the next sentence
                at -= 1
            begin = _BLANK.match(text, at, hi).end()
            if begin == hi:
                continue
            mark = next(c for c in r.group() if c in TERMINATORS)
            gap, nxt = begin - at, text[begin]
            if not gap and (nxt in ",;:.-–)" or (mark in ".．" and (nxt.isdigit() or nxt.islower()))):
                continue
            if mark == "." and not gap and len(r.group()) == 1 and not (nxt.isalpha() or nxt in OPEN_QUOTES):
                continue
            token = _word_before(line, first)
            quote = next((ends[e] for e in range(at, lo + first, -1) if e in ends), None)
            # of a quotation whose start is cut off, only the mark tells whether it opened its sentence, as questions do
            opens = quote is not None and (quote[1] if quote[2] else mark not in ".．।॥۔。")
            word = _NEXT.match(text, begin, hi).group().lower()
            initial = len(token) == 1 and token.isalpha() and line[first - 1].isupper()
            abbr = "inner" if token in inner or initial else "number" if token.isdecimal() else "none"
            what = "”" if quote is not None else "#" if token.isdecimal() else token
            carry = (what, _opening(word)) in carrying
            found.append((at, {"mark": "dot" if mark in ".．" else mark, "abbr": abbr, "next": _class(nxt), "gap": min(gap, 2), "in": inside(at), "carry": carry, "quote": "none" if quote is None else "first" if opens else "said", "what": what, "full": word, "token": token[-8:], "word": word[:8], "digit": token[-1:].isdigit()}))
        if _THAI.search(line) and 2 * len(_THAI.findall(line)) > sum(map(str.isalpha, line)):
            marks = {at for at, _ in found}
            for g in _GAP.finditer(line.rstrip()):
                at = lo + g.start()
                if at in marks or g.start() == 0:
                    continue
                word, last = text[lo + g.end() : lo + g.end() + 4], line[g.start() - 1]
                found.append((at, {"mark": "gap", "abbr": "none", "next": _class(word[:1]), "gap": min(len(g.group()), 2), "in": inside(at), "carry": bool(known) and word[:3] in known["thai"], "quote": "none", "what": "", "full": word, "token": line[max(0, g.start() - 4) : g.start()].split()[-1], "word": word, "digit": last.isdigit()}))
            found.sort(key=lambda x: x[0])
        lines.append((lo, hi, found))
    return lines


def _script(ch: str) -> int:
    """A coarse number of a letter's or vowel sign's script; 0 for what has none."""
    return int(ch.isalpha()) if ch < "\u0370" else ord(ch) >> 7


def observed(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, word, next) of what is counted. Words with a full stop that end a line (``end``) or stand within it (``mid``), words that
    begin a line (``start``) or follow a full stop or a quotation's end (``follow``), the ``pair`` of both (” for a quotation's end, # for
    any number), and what Thai gaps precede (``open``, ``number``)."""
    for lo, hi, found in nodes(text):
        line = text[lo:hi].strip()
        if not line:
            continue
        yield "start", _opening(_NEXT.match(line).group().lower()), ""
        if _THAI.match(line):
            yield "open", line[:3], ""
        if line.endswith(".") and not line.endswith(".."):
            token = _word_before(line, len(line) - 1)
            yield "end", "#" if token.isdecimal() else token, ""
        for _, n in found:
            if n["mark"] == "gap":
                if n["next"] != "digit":
                    yield "number" if n["digit"] else "open", n["word"][:3], ""
            elif not n["in"] and (n["mark"] == "dot" or n["quote"] != "none"):
                a, b = _script(n["what"][-1:]), _script(n["full"][:1])
                if not (a and b) or a == b:  # what an abbreviation stands for goes on in its script
                    yield "mid", n["what"], ""
                if n["what"] in "”#" or n["next"] == "uncased":
                    yield "follow", _opening(n["full"]), ""
                    yield "pair", n["what"], _opening(n["full"])


def _believed(plus: float, minus: float, rate: float) -> bool:
    """Whether plus cases without and minus cases with a line's edge speak for SLIP against the usual rate."""
    return plus * math.log((1 - SLIP) / (1 - rate)) + minus * math.log(SLIP / rate) >= EVIDENCE


def conclude(counts: Iterable[tuple[str, str, str, int]], totals: dict[str, int] | None = None) -> dict:
    """What the counts of :func:`observed` tell: ``inner`` abbreviations, ``carry`` pairs that don't part, and ``thai`` beginnings that continue a number.

    totals: by kind, where the counts leave rare words out.
    """
    by: dict[str, Counter] = {k: Counter() for k in ("end", "mid", "start", "follow", "pair", "open", "number")}
    for kind, a, b, n in counts:
        by[kind][(a, b) if kind == "pair" else a] += n
    totals = totals or {k: sum(c.values()) for k, c in by.items()}
    end, mid, start, follow, pair = (by[k] for k in ("end", "mid", "start", "follow", "pair"))
    rate = lambda edge, within: min(max(edge / max(edge + within, 1), 2 * SLIP), 0.5)
    closing = rate(totals.get("end", 0), totals.get("mid", 0))
    inner = frozenset(w for w, n in mid.items() if w and w not in "”#" and _believed(n, end[w], closing))
    for (a, b), n in pair.items():
        if a in inner:
            follow[b] -= n
    opening = rate(sum(start[w] for w in follow), sum(follow.values()))
    carry = frozenset((a, b) for (a, b), n in pair.items() if a not in inner and b and n >= SAME * follow[b] and _believed(n, start[b], opening))
    thai = frozenset(w for w, n in by["number"].items() if by["open"][w] <= THAI_OPEN * (by["open"][w] + n))
    return {"inner": inner, "carry": carry, "thai": thai}


def features(n: dict) -> list[str]:
    base = f"{n['mark']}|{n['abbr']}|{n['next']}"
    joint = f"{base}|{n['carry']}|{n['quote']}|{n['in']}|{n['digit']}"
    return [*[joint] * JOINT, base, f"{base}|{n['carry']}|{n['quote']}", f"in{n['in']}", f"in{n['in']}|{n['mark']}", f"q{n['quote']}|{n['next']}|{n['carry']}",
            f"q{n['quote']}", f"t{n['token']}|{n['mark']}", f"t{n['token']}|{n['next']}", f"w{n['word']}|{n['digit']}|{n['mark']}", f"w{n['word'][:3]}|{n['digit']}|{n['mark']}",
            f"w{n['word'][:2]}|{n['digit']}|{n['mark']}", f"g{n['gap']}|{n['mark']}", f"d{n['digit']}|{n['next']}|{n['mark']}", f"c{n['carry']}|{n['abbr']}"]


def viterbi(emit: list[float], trans: dict[tuple[int, int], float]) -> list[int]:
    """The best tags (1: boundary) of a chain; emit: score of a boundary against inside."""
    if not emit:
        return []
    score, back = [0.0, emit[0]], []
    for e in emit[1:]:
        step, new = [], []
        for tag in (0, 1):
            best = max((0, 1), key=lambda p: score[p] + trans.get((p, tag), 0.0))
            step.append(best)
            new.append(score[best] + trans.get((best, tag), 0.0) + (e if tag else 0.0))
        back.append(step)
        score = new
    tag = int(score[1] > score[0])
    tags = [tag]
    for step in reversed(back):
        tag = step[tag]
        tags.append(tag)
    return tags[::-1]


def target(n: dict) -> int:
    """The training target of a possible break."""
    if n["in"]:
        return 0
    if n["mark"] == "gap":
        return int(n["next"] != "digit" and not (n["digit"] and n["carry"]))
    if n["next"] == "lower" or n["carry"]:
        return 0
    if n["quote"] != "none":
        return int(n["quote"] == "said" or n["next"] in ("upper", "open"))
    if n["mark"] == "…":
        return int(n["next"] in ("upper", "open"))
    if n["mark"] == "dot":
        return int(n["abbr"] != "inner")
    return 1


def train(texts: Iterable[str], known: dict | None = None) -> dict:
    """Weights of the chain model from a sample of texts. known: see :func:`conclude`; without it the sample's own counts stand in."""
    texts, chains = list(texts), []
    if known is None:
        known = conclude((*k, n) for k, n in Counter(x for t in texts for x in observed(t)).items())
    for t in texts:
        chains += [([features(n) for _, n in found], [target(n) for _, n in found]) for *_, found in nodes(t, known) if found]
    w, total, trans, ttotal, seen = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float), 1
    for _ in range(EPOCHS):
        wrong = 0
        for feats, gold in chains:
            guess = viterbi([sum(w[f] for f in fs) for fs in feats], trans)
            seen += 1
            if guess == gold:
                continue
            wrong += 1
            for k, (fs, g, y) in enumerate(zip(feats, guess, gold)):
                if g != y:
                    for f in fs:
                        w[f] += y - g
                        total[f] += seen * (y - g)
                if k:
                    for tags, sign in ((gold, 1), (guess, -1)):
                        trans[tags[k - 1], tags[k]] += sign
                        ttotal[tags[k - 1], tags[k]] += seen * sign
        if not wrong:
            break
    return {"w": {f: v for f in w if (v := w[f] - total[f] / seen)}, "trans": {k: trans[k] - ttotal[k] / seen for k in trans}, "known": known}


def units(text: str | None, model: dict) -> list[tuple[int, int]]:
    """Start and end of each sentence unit, without outer white space."""
    if not text or not _LETTER.search(text):
        return []
    w, trans, out = model["w"], model["trans"], []
    for lo, hi, found in nodes(text, model["known"]):
        tags = viterbi([sum(w.get(f, 0.0) for f in features(n)) for _, n in found], trans)
        cuts = [lo, *(at for (at, _), tag in zip(found, tags) if tag), hi]
        for a, b in zip(cuts, cuts[1:]):
            piece = text[a:b]
            if _LETTER.search(piece):
                a += len(piece) - len(piece.lstrip())
                out.append((a, a + len(piece.strip())))
    return out


def script_class(text: Column) -> Column:
    """A coarse script class, to draw a sample from every script."""
    return (F.when(text.rlike("[฀-๿]"), "th").when(text.rlike("[ಀ-೿]"), "kn").when(text.rlike("[ऀ-ॿ]"), "hi")
            .when(text.rlike("[؀-ۿ]"), "ur").when(text.rlike("[぀-ヿ]"), "ja").when(text.rlike("[一-鿿]"), "zh")
            .when(text.rlike("[„ßäöü]| und | der | die "), "de").when(text.rlike("[éèàç]| le | la | du "), "fr").otherwise("en"))


def sample(df: DataFrame, text: str, per_script: int) -> list[str]:
    """At most ``per_script`` distinct texts of each script class, the same ones on every run: those of the least hashes.

    Hashes are ranked first, so that only the texts taken are moved.
    """
    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    ranked = rows.select(script_class(F.col("t")).alias("s"), "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("h")))
    least = ranked.where(F.col("r") <= per_script).select("h")  # a fixed number
    return [r.t for r in rows.join(F.broadcast(least), "h").dropDuplicates(["h"]).orderBy("h", "t").select("t").collect()]


def count_observed(df: DataFrame, text: str) -> DataFrame:
    """Rows (kind, word, next, n) of :func:`observed` over all rows, pre-aggregated per batch."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(x for t in b.t for x in observed(t))
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "word", "next", "n"])

    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("t"))
    return rows.mapInPandas(count, "kind string, word string, next string, n bigint").groupBy("kind", "word", "next").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str, per_script: int = TRAIN_PER_SCRIPT) -> dict:
    """The model of a table: counts of all its rows, and weights trained on a bounded sample of them."""
    counts = durable(count_observed(df, text))
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    often = counts.where(F.col("n") > RARE * sum(totals.values())).select("kind", "word", "next", "n").collect()  # at most 1 / RARE
    return train(sample(df, text, per_script), conclude(often, totals))


def sentence_units(df: DataFrame, table: str = "unit_table", key: str = "row_key", text: str = "text", per_script: int = TRAIN_PER_SCRIPT) -> DataFrame:
    """One row (unit_table, row_key, start_pos, end_pos) per sentence unit of each row of ``df``."""
    rows = df.select(F.col(table).alias("unit_table"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    model = learn(rows, "text", per_script)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = [(t, k, s, e) for t, k, x in zip(b.unit_table, b.row_key, b.text) for s, e in units(x, m)]
            yield pd.DataFrame(out, columns=["unit_table", "row_key", "start_pos", "end_pos"])

    return rows.where(F.col("text").isNotNull()).mapInPandas(tag, "unit_table string, row_key string, start_pos int, end_pos int")
