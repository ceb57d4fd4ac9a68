"""Problem 6: noise in text from scanned pages, and its repair.

A page counts as a scan if its lines are wrapped like print, whatever its flag says. Bare
numbers are page numbers; short unfilled lines at the head or foot of a printed page are
running headers, and between two printed pages if the line recurs in its file. Misread words
are found in SQL: words with equal anagram hashes after leaving out one or two characters are
joined, rare ones to frequent ones. Which shapes are confused is learnt from these pairs: what
is taken for what in many words, and far more often than the other way round or as often as
the script's commonest confusion. Words broken across lines are joined without a mark unless
the corpus writes them with a hyphen.

Results for odd input: null and empty texts have no noise and come out as they are; pages of
one or two lines are scans only if flagged so; repeated pages are reported each; words without
a counterpart are left alone; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import lookalike
from quern.llm.scripts import TERMINATORS
from quern.session import durable

WRAP = 80  # characters that a printed line has at most
FREQUENT = 12  # a variant is that much more frequent than the rare word,
KNOWN_FREQUENT = 4  # or that much, if their shapes are known to be confused
SHORT = 3  # words of so many characters and fewer need both
LEAST_SUPPORT = 3  # rare words that show a confusion before it is believed,
COMMON_SHARE = 0.15  # and their share of the script's best supported confusion,
SUPPORT_SHARE = 0.03  # or this share, if
ASYMMETRY = 4  # they are so many times those that show the reverse: letters of names vary both ways

# Shapes taken for one another folded to one spelling, to compare titles in spite of misreadings.
_FOLD = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("in", "m"), ("ವು", "ಮ"), ("ಯು", "ಯ")]
_FOLD_CHARS = str.maketrans({"c": "e", "f": "t", "!": "i", "0": "o", "1": "l", "b": "h", "ಠ": "ರ", "ೀ": "ಿ", "ಪ": "ಸ", "ವ": "ಸ", "ೂ": "ಾ", "ಚ": "ಬ", "ಞ": "ಣ", "ಕ": "ಶ", "ಧ": "ಥ", "ी": "ि", "भ": "म", "ष": "प", "थ": "य", "व": "ब", "घ": "ध"})

MARKS = "-‐¬­"
_NUMBER = regex.compile(r"^[^\p{L}\p{N}]*(?:(?:p|pp|page|seite|s|पृष्ठ|पृ|ಪುಟ|صفحہ|หน้า|頁|第)[^\p{L}\p{N}]*)?(?:[\p{Nd}OolI]{1,4}|[ivxlc]{1,8})(?:\s*(?:of|/|von|sur)\s*\p{Nd}+)?[^\p{L}\p{N}]*(?:頁|页)?$", regex.I)
_EDGE_NUMBER = regex.compile(r"^[\[(]?[\p{Nd}OolI]{1,4}[\])]?\s*[|.–—-]?\s{1,}|\s*[|–—-]?\s{1,}[\[(]?[\p{Nd}OolI]{1,4}[\])]?$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}!|‌‍]+(?:-[\p{L}\p{M}]+)*")
_ODD = regex.compile(f"[{lookalike.ZERO_WIDTH}{lookalike.JOINERS}\u0370-\u04FF\u0C00-\u0C7F\u3000\uFF00-\uFFEF]")
_ENDS = TERMINATORS + "”\"»:"


def wrapped(text: str | None, flagged: bool | None) -> bool:
    """Whether the text is laid out like print."""
    lengths = [len(x) for x in (text or "").split("\n") if x.strip()]
    return bool(lengths) and max(lengths) <= WRAP and (len(lengths) >= 3 or flagged is True)


def title_key(line: str) -> str:
    """A title without its page number, folded so that misreadings agree."""
    t = _EDGE_NUMBER.sub("", _EDGE_NUMBER.sub("", line.strip())).casefold()
    for a, b in _FOLD:
        t = t.replace(a, b)
    return "".join(c for c in t.translate(_FOLD_CHARS) if c.isalnum() or unicodedata.category(c)[0] == "M")


def layout(text: str) -> list[tuple[int, str, str, str]]:
    """(line number, line, role, title key) of each line with text.

    role: ``number``, ``title`` (certain), ``perhaps`` (a title if it recurs), ``text``.
    """
    lines = [(i, x.rstrip()) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    width = max(len(x) for _, x in lines)
    roles = {i: "number" if _NUMBER.match(x.strip()) else "text" for i, x in lines}
    rest = [(i, x) for i, x in lines if roles[i] == "text"]
    for k, (i, x) in enumerate(rest):
        after = rest[k + 1][1].split() if k + 1 < len(rest) else []
        s = x.strip()
        if s[-1] in _ENDS or s[-1] in MARKS:
            continue
        unfilled = not after or len(x) + 1 + len(after[0]) <= width - 2
        if k == 0 and len(rest) > 1:
            roles[i] = "title" if unfilled else "perhaps"
        elif k == len(rest) - 1:
            ended = rest[k - 1][1].strip()[-1] in _ENDS if k else False
            roles[i] = "title" if ended and len(x) <= 0.8 * width else "perhaps"
        elif unfilled:
            at = next(n for n, y in enumerate(lines) if y[0] == i)
            beside = any(0 <= n < len(lines) and roles[lines[n][0]] == "number" for n in (at - 1, at + 1))
            roles[i] = "title" if beside and not s[0].islower() and not s[0].isdigit() and len(s) <= 0.75 * width else "perhaps"
            if beside and s[0].isdigit() and _EDGE_NUMBER.match(s):
                roles[i] = "title"
    return [(i, x, roles[i], title_key(x) if roles[i] in ("title", "perhaps") else "") for i, x in lines]


def page_words(rows: list[tuple[int, str, str, str]]) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, str, str]]]:
    """(words, breaks) of the text lines: (word, line, next line, length of the part on the first) and (line, left, right)."""
    body = [(i, x.strip()) for i, x, role, _ in rows if role in ("text", "perhaps")]
    out, breaks, head = [], [], ""
    for k, (i, x) in enumerate(body):
        found = list(_WORD.finditer(x))
        if head and found and found[0].start() == 0:
            found = found[1:]  # it ended the word before
        broken = len(x) > 1 and x[-1] in MARKS and k + 1 < len(body) and x[-2].isalpha() | (unicodedata.category(x[-2])[0] == "M")
        head = ""
        last = None
        if broken:
            last = _WORD.search(body[k + 1][1])
            left = regex.search(r"[\p{L}\p{M}\p{Nd}!|‌‍]+$", x[:-1])
            if last and last.start() == 0 and left:
                head = left.group()
                right = last.group()
                breaks.append((i, head, right))
                out.append((head + right, i, body[k + 1][0], len(head)))
                found = [m for m in found if m.end() < left.end() or m.end() <= left.start()]
        out += [(m.group().rstrip("!|"), i, i, 0) for m in found]
    return [w for w in out if w[0]], breaks


def _variants(words: DataFrame, name: str) -> DataFrame:
    """Rows (hash, <name>, <name>_n): each word's anagram hash less up to two adjacent characters.

    The anagram hash is the sum of powers of the characters' codes, whatever their order.
    """
    code = lambda c: F.pow((F.ascii(c) % 9973).cast("double"), 3).cast("bigint")
    chars = F.split(F.col("word"), "(?!^)(?!$)")
    coded = words.withColumn("codes", F.transform(chars, code)).withColumn("total", F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, b: a + b))
    size = F.size("codes")
    at = lambda i: F.col("codes")[i]
    one = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("total") - at(i))
    two = F.when(size > 2, F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.col("total") - at(i) - at(i + 1))).otherwise(F.array().cast("array<bigint>"))
    return coded.select(F.explode(F.array_distinct(F.concat(one, two))).alias("hash"), F.col("word").alias(name), F.col("n").alias(f"{name}_n"))


def spelling(word: str) -> str:
    """The word as it is compared: look-alike letters and joiners are no misreadings."""
    return lookalike._JOIN.sub("", lookalike.unify(word) or "") if _ODD.search(word) else word


def difference(right: str, wrong: str) -> tuple[str, str, int] | None:
    """The one stretch of at most two characters in which two words differ, as it should be and as it is, and where it starts.

    What has only been added is told with the character before; what has only been lost is no confusion of shapes.
    """
    lo = 0
    while lo < min(len(right), len(wrong)) and right[lo] == wrong[lo]:
        lo += 1
    hi = 0
    while hi < min(len(right), len(wrong)) - lo and right[-1 - hi] == wrong[-1 - hi]:
        hi += 1
    if lo == len(right) - hi:
        lo -= 1
    a, b = right[max(lo, 0) : len(right) - hi], wrong[max(lo, 0) : len(wrong) - hi]
    return (a, b, lo) if lo >= 0 and a != b and 0 < len(a) <= 2 and 0 < len(b) <= 2 and "-" not in a + b else None


def corrections(counts: DataFrame) -> DataFrame:
    """Rows (word, correction, place, support): the best variant of each misread word. counts: word, n."""
    words = counts.where(~F.col("word").rlike("^[\\p{Nd}]+$"))
    signs = F.col("word").rlike("[0-9!|]")
    rare = _variants(words.where((F.length("word") >= SHORT) | (signs & (F.length("word") >= 2))), "rare")
    common = _variants(words.where((F.col("n") >= KNOWN_FREQUENT) & (F.length("word") >= 2)).where(~signs), "common")
    pairs = rare.join(common, "hash").where((F.col("rare") != F.col("common")) & (F.col("common_n") >= KNOWN_FREQUENT * F.col("rare_n")) & (F.abs(F.length("rare") - F.length("common")) <= 1))
    pairs = pairs.select("rare", "rare_n", "common", "common_n").distinct()

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, wn, f, fn in zip(b.rare, b.rare_n, b.common, b.common_n):
                if d := difference(f, w):
                    script = "l" if ord(w[0]) < 0x250 else format(ord(w[0]) >> 7, "x")
                    out.append((w, f, fn, *d, len(w) > SHORT, fn >= FREQUENT * wn, script))
            yield pd.DataFrame(out, columns=["word", "correction", "n", "right", "wrong", "place", "long", "sure", "script"])

    told = durable(pairs.mapInPandas(tell, "word string, correction string, n bigint, right string, wrong string, place int, long boolean, sure boolean, script string"))
    support = told.where("long AND sure").groupBy("script", "right", "wrong").agg(F.countDistinct("word").alias("support"))
    reverse = support.select("script", F.col("wrong").alias("right"), F.col("right").alias("wrong"), F.col("support").alias("reverse"))
    best = support.groupBy("script").agg(F.max("support").alias("best"))
    one_way = (F.col("support") >= SUPPORT_SHARE * F.col("best")) & (F.col("support") >= ASYMMETRY * F.coalesce("reverse", F.lit(0)))
    believed = support.join(reverse, ["script", "right", "wrong"], "left").join(F.broadcast(best), "script")  # a row per script
    believed = believed.where((F.col("support") >= LEAST_SUPPORT) & ((F.col("support") >= COMMON_SHARE * F.col("best")) | one_way))
    kept = told.where("long OR sure").join(believed.select("script", "right", "wrong", "support"), ["script", "right", "wrong"])
    order = F.struct("support", "n", "correction")
    return kept.groupBy("word").agg(F.max_by(F.struct("correction", "place", "support"), order).alias("c")).select("word", "c.*")


def _scan(pages: DataFrame) -> DataFrame:
    """All that one pass over the pages tells, one row per finding; ``what``: title, number, word, break, count. word is in its compared spelling, other as it stands."""
    schema = "what string, page bigint, file string, doc string, line int, line2 int, cut int, word string, other string, sure boolean, n bigint"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            out = []
            for key, file, doc, flagged, text in zip(b.page_key, b.source_file, b.doc_id, b.used_ocr, b.text):
                text = unicodedata.normalize("NFC", text)
                if not wrapped(text, bool(flagged) if flagged is not None and flagged == flagged else None):
                    counts.update(spelling(w.rstrip("!|")) for w in _WORD.findall(text))
                    continue
                rows = layout(text)
                for i, _, role, title in rows:
                    if role == "number":
                        out.append(("number", key, None, None, i, None, None, None, None, True, None))
                    elif role in ("title", "perhaps"):
                        out.append(("title", key, file, doc, i, None, None, title, None, role == "title", None))
                words, breaks = page_words(rows)
                for w, i, j, cut in words:
                    told = spelling(w)
                    counts[told] += 1
                    if len(told) >= 2 and not told.isdigit():
                        out.append(("word", key, None, None, i, j, cut, told, w, None, None))
                out += [("break", key, None, None, i, None, None, left, right, None, None) for i, left, right in breaks]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([("count", None, None, None, None, None, None, w, None, None, n) for w, n in counts.items()], columns=names)

    rows = pages.where(F.length(F.trim("text")) > 0).select(F.col("page_key").cast("bigint").alias("page_key"), "source_file", "doc_id", "used_ocr", "text")
    return rows.mapInPandas(read, schema)


def noise(pages: DataFrame) -> DataFrame:
    """Rows (page_key, line_no, kind, word, correction) of the noise on scanned pages.

    word and correction are set for misread words and for words broken across lines.
    """
    found = durable(_scan(pages))
    none = F.lit(None).cast("string")
    numbers = found.where("what = 'number'").select("page", "line", F.lit("page_number").alias("kind"), none.alias("word"), none.alias("correction"))
    titles = found.where("what = 'title' AND word <> ''")
    recurring = titles.groupBy("file", "word").agg(F.countDistinct("doc").alias("pages"), F.count(F.lit(1)).alias("times"))
    headers = titles.join(recurring, ["file", "word"], "left").where("sure OR pages > 1 OR times > 1").select("page", "line").distinct()
    headers = headers.withColumns({"kind": F.lit("running_header"), "word": none, "correction": none})
    furniture = numbers.select("page", "line").unionByName(headers.select("page", "line"))

    counts = durable(found.where("what = 'count'").groupBy("word").agg(F.sum("n").alias("n")))
    fixes = corrections(counts)
    words = found.where("what = 'word'").select("page", "line", "line2", "cut", "word", "other").join(fixes, "word")
    at = F.when((F.col("cut") > 0) & (F.col("place") >= F.col("cut")), F.col("line2")).otherwise(F.col("line"))
    misread = words.select("page", at.alias("line"), F.col("other").alias("word"), "correction").distinct()
    misread = misread.withColumn("kind", F.lit("misread")).join(furniture, ["page", "line"], "left_anti")

    breaks = found.where("what = 'break'").select("page", "line", F.col("word").alias("left"), F.col("other").alias("right"))
    n_with, n_without = counts.select(F.col("word").alias("with_mark"), F.col("n").alias("n_with")), counts.select(F.col("word").alias("joined"), F.col("n").alias("n_without"))
    evidence = breaks.withColumn("with_mark", F.concat_ws("-", "left", "right")).withColumn("joined", F.concat("left", "right"))
    evidence = evidence.join(n_with, "with_mark", "left").join(n_without, "joined", "left")
    hyphens = evidence.where(F.coalesce("n_with", F.lit(0)) < F.coalesce("n_without", F.lit(1))).join(furniture, ["page", "line"], "left_anti")
    hyphens = hyphens.select("page", "line", F.lit("hyphen_break").alias("kind"), F.col("left").alias("word"), F.col("joined").alias("correction"))
    columns = ["page", "line", "kind", "word", "correction"]
    parts = numbers.select(columns).unionByName(headers.select(columns)).unionByName(misread.select(columns)).unionByName(hyphens.select(columns))
    return parts.select(F.col("page").alias("page_key"), F.col("line").alias("line_no"), "kind", "word", "correction")


def repair(pages: DataFrame) -> DataFrame:
    """Rows (page_key, text): every page, the scanned ones as continuous paragraphs without the noise found."""
    edits = noise(pages).groupBy("page_key").agg(F.collect_list(F.struct("line_no", "kind", "word", "correction")).alias("edits"))  # bounded by the page

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if t is None or not wrapped(t, bool(f) if f is not None and f == f else None) else mended(t, list(e) if e is not None else []) for t, f, e in zip(b.text, b.used_ocr, b.edits)]
            yield pd.DataFrame({"page_key": b.page_key, "text": texts})

    rows = pages.select(F.col("page_key").cast("bigint").alias("page_key"), "text", "used_ocr").join(edits, "page_key", "left")
    return rows.mapInPandas(mend, "page_key bigint, text string")


def mended(text: str, edits: list) -> str:
    """The text without furniture, with words corrected and joined and lines run on within paragraphs.

    Only whole words are corrected, and only where they were found misread; a word broken across lines after it is joined.
    """
    text = unicodedata.normalize("NFC", text)
    drop = {e["line_no"] for e in edits if e["kind"] in ("running_header", "page_number")}
    join = {e["line_no"] for e in edits if e["kind"] == "hyphen_break"}
    fixes = {(e["line_no"], e["word"]): e["correction"] for e in edits if e["kind"] == "misread" and e["correction"]}
    any_line = {word: right for (_, word), right in fixes.items()}

    def corrected(known: dict, line: int | None) -> Callable[[regex.Match], str]:
        def put(m: regex.Match) -> str:
            core = m.group().rstrip("!|")
            return known.get(core if line is None else (line, core), core) + m.group()[len(core) :]

        return put

    out, fresh, broken = [], True, False
    for i, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if i in drop:
            continue
        if not s:
            fresh = not broken
            continue
        s = _WORD.sub(corrected(fixes, i), s)
        if broken and out:
            head, tail = out[-1].rstrip(MARKS), _WORD.match(s)
            start = next((m.start() for m in regex.finditer(r"[\p{L}\p{M}\p{Nd}!|‌‍]+$", head)), len(head))
            whole = head[start:] + (tail.group() if tail else "")
            out[-1] = head[:start] + _WORD.sub(corrected(any_line, None), whole) + s[tail.end() if tail else 0 :]
        else:
            out.append(("" if not out else "\n\n" if fresh else " ") + s)
        broken = i in join
        fresh = False
    return "".join(out)
