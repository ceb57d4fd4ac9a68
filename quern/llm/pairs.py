"""Problem 5: question and answer pairs that don't work as a pair.

Empty answers, refusals (:mod:`quern.llm.refusals`: grammars over categories of words), copies of the question (greedy
string tiling), answers in another language (script, then function words) and truncated
answers (a pushdown parser over fences, brackets, quotations, lists and markup, then the
terminality of the closing words). One defect per row, in that order.

Results for odd input: a null answer is empty; a null question leaves only the defects of
the answer itself; rows whose status isn't ok, or is null, are not looked at; repeated rows are flagged
each; an empty table gives none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import endings
from quern.llm.refusals import is_refusal
from quern.llm.scripts import language, script_counts
from quern.session import durable

# What stands for "no answer", after punctuation is taken away.
NOTHING = frozenset("null|none|nil|na|n a|nan|undefined|tbd|answer|ans|a|ಉತ್ತರ|उत्तर|جواب|antwort|réponse|reponse|回答|答案|答|答え|คำตอบ|no answer|empty|blank|unknown".split("|"))

TILE = 2  # words (in scripts without spaces characters) of the least tile
COPY_SHARE = 0.9

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+")
_LABEL = regex.compile(r"^\s*(?:question|q|ಪ್ರಶ್ನೆ|प्रश्न|سوال|frage|问题|問|質問|คำถาม)\s*[:：.]\s*", regex.I)


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def is_nothing(answer: str | None) -> bool:
    if not answer:
        return True
    core = " ".join(_WORD.findall(_fold(answer))) if not regex.search(r"[\p{Han}\p{Hiragana}\p{Thai}]", answer) else "".join(_WORD.findall(_fold(answer)))
    return not core or core in NOTHING


def tiles(answer: list[str], question: list[str], least: int) -> list[bool]:
    """Which answer tokens greedy string tiling covers with stretches of the question.

    In each round the longest stretches common to what is unmarked on both sides become tiles, until none
    of ``least`` tokens is left; every token of the question serves one tile only.
    """
    at: dict[str, list[int]] = {}
    for j, w in enumerate(question):
        at.setdefault(w, []).append(j)
    marked, used = [False] * len(answer), [False] * len(question)
    while True:
        longest, found = least, []
        for i, w in enumerate(answer):
            for j in at.get(w, ()):
                n = 0
                while i + n < len(answer) and j + n < len(question) and answer[i + n] == question[j + n] and not marked[i + n] and not used[j + n]:
                    n += 1
                if n > longest:
                    longest, found = n, []
                if n == longest:
                    found.append((i, j))
        if not found:
            return marked
        for i, j in found:
            if not any(marked[i : i + longest]) and not any(used[j : j + longest]):
                marked[i : i + longest] = used[j : j + longest] = [True] * longest


def copies(question: str | None, answer: str) -> bool:
    """Nothing but the question, once or more often: what one tiling leaves of the answer is tiled with the question again."""
    if not question:
        return False
    q, a = _WORD.findall(_fold(_LABEL.sub("", question))), _WORD.findall(_fold(_LABEL.sub("", answer)))
    known = set(q)
    if not q or not a or len(a) < 0.7 * len(q) or sum(w in known for w in a) < COPY_SHARE * len(a):  # no tiling could cover enough
        return False
    rest = a
    while rest:
        marked = tiles(rest, q, min(TILE, len(q)))
        left = [w for w, m in zip(rest, marked) if not m]
        if len(rest) - len(left) < 0.7 * len(q):
            break
        rest = left
    return len(rest) <= (1 - COPY_SHARE) * len(a)


def other_language(question: str | None, answer: str) -> bool:
    """The answer's script, or the language its function words show, is not the question's."""
    q, a = language(question or ""), language(answer)
    if q is None or a is None:
        counts = script_counts(answer)
        qs = script_counts(question or "")
        if q is not None and a is None and counts and q not in ("en", "de", "fr"):
            return max(counts, key=counts.get) == "latin" and q != "latin"
        if q is None and a is not None and a not in ("en", "de", "fr") and qs:
            return max(qs, key=qs.get) == "latin"
        return False
    return q != a and {q, a} != {"ja", "zh"} or (q == "ja" and a == "zh" and len(answer) > 8) or (q == "zh" and a == "ja")


def defective_pairs(answers: DataFrame) -> DataFrame:
    """Rows (seq, defect) of the answers with status ok that are defective."""
    rows = answers.where(F.lower(F.trim("status")) == "ok").select(F.col("seq").cast("bigint").alias("seq"), "question", "answer")
    schema = "seq bigint, defect string, answer string"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for seq, q, a in zip(b.seq, b.question, b.answer):
                d = None
                if is_nothing(a):
                    d = "empty"
                elif is_refusal(a):
                    d = "refusal"
                elif copies(q, a):
                    d = "copies_question"
                elif other_language(q, a):
                    d = "other_language"
                out.append((seq, d, None if d else a))
            yield pd.DataFrame(out, columns=["seq", "defect", "answer"])

    judged = durable(rows.mapInPandas(judge, schema))
    cut = endings.broken_off(judged.where("defect IS NULL"), "seq", "answer")
    return judged.where("defect IS NOT NULL").select("seq", "defect").unionByName(cut.select(F.col("key").alias("seq"), F.lit("truncated").alias("defect")))
