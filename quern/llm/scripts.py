"""Scripts, languages and sentence marks shared by the text operators."""

from __future__ import annotations

import functools
import re

import regex

# Sentence marks, opening and closing quotation marks, brackets.
TERMINATORS = ".!?…。！？।॥۔؟｡．"
CLOSERS = "”\"»」』’)]）】"
OPEN_QUOTES = "“«「『„"
CLOSE_QUOTES = "”»」』“"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "«": "»", "【": "】"}

# Script ranges that tell the languages of the corpus apart.
SCRIPT_LANG = (
    ("kn", "ಀ-೿"), ("te", "ఀ-౿"), ("hi", "ऀ-ॣ०-ॿ"),
    ("th", "฀-๿"), ("ur", "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"),
    ("ja", "぀-ヿｦ-ﾝ"), ("zh", "㐀-鿿"), ("latin", "A-Za-zÀ-ɏＡ-Ｚａ-ｚ"),
)
_COUNT = [(n, re.compile(f"[{r}]")) for n, r in SCRIPT_LANG]

# Frequent function words of the three languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and is in at by to was are with from has its whether such or how what who when why did although however that this it not i we for",
    "de": "der die das und ist in im von mit den dem ein eine wurde wer was wie warum ging nach wirklich für auf nicht sich zu ich mir hat haben",
    "fr": "le la les de des du et est un une dans en par qui que pourquoi au aux il sur pour ce avec je ne pas a bâti date",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LATIN = regex.compile(r"[\p{Latin}']+")


def latin_language(text: str) -> str | None:
    """``en``, ``de`` or ``fr`` by function words; None where none or several fit alike."""
    words = _LATIN.findall(text.lower())
    if not words:
        return None
    best = sorted(((sum(w in v for w in words), k) for k, v in _WORDS.items()), reverse=True)
    if best[0][0] == 0 or best[0][0] == best[1][0]:
        return None
    return best[0][1]


def script_counts(text: str) -> dict[str, int]:
    return {n: c for n, p in _COUNT if (c := len(p.findall(text)))}


def language(text: str) -> str | None:
    """The language of a text by script, then by function words; None where it can't be told.

    Any kana makes Han text Japanese. Null and letterless texts give None.
    """
    if not text:
        return None
    counts = script_counts(text)
    if not counts:
        return None
    if counts.get("ja", 0) * 20 > counts.get("zh", 0) and "ja" in counts:
        counts["ja"] += counts.pop("zh", 0)
    top = max(counts, key=counts.get)
    return latin_language(text) if top == "latin" else top


@functools.lru_cache(maxsize=65536)
def script_set(ch: str) -> frozenset[str]:
    """The script extensions of a character; empty for common and inherited ones."""
    for name in _SCRIPTS:
        if _SCRIPT_RE[name].match(ch):
            return frozenset(n for n in _SCRIPTS if _SCRIPT_RE[n].match(ch))
    return frozenset()


_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Kannada", "Telugu", "Devanagari", "Thai", "Arabic", "Hiragana", "Katakana", "Han", "Hangul", "Hebrew", "Armenian", "Tamil", "Malayalam", "Bengali", "Gujarati", "Gurmukhi", "Oriya", "Sinhala")
_SCRIPT_RE = {n: regex.compile(rf"\p{{Script={n}}}|\p{{Script_Extensions={n}}}") for n in _SCRIPTS}
