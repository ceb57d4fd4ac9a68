"""Prompt templates and fixed responses, and their expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The templates and responses.
GROUNDED = """ನೀವು ಕರ್ನಾಟಕದ ಪಾರಂಪರಿಕ ತಾಣಗಳ ಕುರಿತ ಪ್ರಶ್ನೆಗಳಿಗೆ ಉತ್ತರಿಸುವ ಸಹಾಯಕ.

ಕೆಳಗೆ ನೀಡಿರುವ ಆಧಾರ ಪಠ್ಯದಲ್ಲಿ ಇರುವ ಮಾಹಿತಿಯನ್ನು ಮಾತ್ರ ಬಳಸಿ ಉತ್ತರಿಸಿ.
ಆಧಾರ ಪಠ್ಯದಲ್ಲಿ ಇಲ್ಲದ ಯಾವುದೇ ಮಾಹಿತಿಯನ್ನು ಸೇರಿಸಬೇಡಿ.
ಆಧಾರ ಪಠ್ಯದಲ್ಲಿ ಉತ್ತರ ಸಿಗದಿದ್ದರೆ "ಈ ಮಾಹಿತಿ ದಾಖಲೆಯಲ್ಲಿ ಲಭ್ಯವಿಲ್ಲ" ಎಂದು ಮಾತ್ರ ಹೇಳಿ.
ಸಂಪೂರ್ಣ ಉತ್ತರವನ್ನು ಕನ್ನಡದಲ್ಲಿಯೇ ಬರೆಯಿರಿ.
ಉತ್ತರವು {n_sentences} ವಾಕ್ಯಗಳಲ್ಲಿ ಇರಲಿ.

ಆಧಾರ ಪಠ್ಯ:
{context}

ಪ್ರಶ್ನೆ: {question}

ಉತ್ತರ:"""
UNGROUNDED = """ನೀವು ಕರ್ನಾಟಕದ ಪಾರಂಪರಿಕ ತಾಣಗಳ ಕುರಿತ ಪ್ರಶ್ನೆಗಳಿಗೆ ಉತ್ತರಿಸುವ ಸಹಾಯಕ.

ನಿಮಗೆ ತಿಳಿದಿರುವ ಮಾಹಿತಿಯನ್ನು ಬಳಸಿ ಉತ್ತರಿಸಿ.
ಉತ್ತರ ತಿಳಿಯದಿದ್ದರೆ "ಈ ಮಾಹಿತಿ ನನಗೆ ತಿಳಿದಿಲ್ಲ" ಎಂದು ಮಾತ್ರ ಹೇಳಿ.
ಸಂಪೂರ್ಣ ಉತ್ತರವನ್ನು ಕನ್ನಡದಲ್ಲಿಯೇ ಬರೆಯಿರಿ.
ಉತ್ತರವು {n_sentences} ವಾಕ್ಯಗಳಲ್ಲಿ ಇರಲಿ.

ಪ್ರಶ್ನೆ: {question}

ಉತ್ತರ:"""
ABSTENTION = "ಈ ಮಾಹಿತಿ ದಾಖಲೆಯಲ್ಲಿ ಲಭ್ಯವಿಲ್ಲ."
OTHER_LANGUAGE = "ದಯವಿಟ್ಟು ನಿಮ್ಮ ಪ್ರಶ್ನೆಯನ್ನು ಕನ್ನಡದಲ್ಲಿ ಕೇಳಿ. ಈ ವ್ಯವಸ್ಥೆ ಕನ್ನಡ ಪ್ರಶ್ನೆಗಳಿಗೆ ಮಾತ್ರ ಉತ್ತರಿಸುತ್ತದೆ."
MARKER = "ಆಧಾರ ಪಠ್ಯ:"


def _filled(template: str, **columns: Column) -> Column:
    """The template with its fields, concatenated, so that text within a field is never taken for a field."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name]]
    return F.concat(*parts, F.lit(rest))


def build_prompt(question: Column, context: Column, n_sentences: str = "2-3") -> Column:
    """The grounded prompt, or the ungrounded one where the context is null."""
    n = F.lit(n_sentences)
    return F.when(context.isNull(), _filled(UNGROUNDED, question=question, n_sentences=n)).otherwise(_filled(GROUNDED, question=question, context=context, n_sentences=n))


def echo(prompt: Column) -> Column:
    """What the echo generator answers: the start of the grounding text up to a blank line; empty without grounding."""
    at = F.instr(prompt, MARKER)
    after = F.regexp_replace(F.substring(prompt, at + len(MARKER), F.length(prompt)), "(?U)^\\s+|\\s+$", "")
    return F.when(at == 0, "").otherwise(F.substring_index(after, "\n\n", 1))
