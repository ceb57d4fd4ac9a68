"""Rendering of result tables, which are small: CSV, LaTeX and Markdown."""

from __future__ import annotations

import csv
import io
import math
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def shown(value: Any, low: float | None = None, high: float | None = None, digits: int | None = None) -> str:
    """A value as tables show it: ``--`` for null and NaN, floats with three decimals (of ``digits`` first, if given), bounds in brackets."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "--"
    text = [f"{x if digits is None else round(x, digits):.3f}" if isinstance(x, float) else str(x) for x in (value, low, high)]
    return text[0] if low is None or high is None else f"{text[0]} [{text[1]}, {text[2]}]"


def cell(mean: float | None, low: float | None = None, high: float | None = None) -> str:
    """A mean with its interval, all rounded to four decimals before."""
    return shown(mean, low, high, 4)


@dataclass
class Table:
    caption: str
    label: str
    columns: list[str]
    rows: list[list[Any]] = field(default_factory=list)
    notes: str = ""

    @classmethod
    def of(cls, df: DataFrame, caption: str, label: str, notes: str = "") -> Table:
        """A table of at most MOST_ROWS rows; a larger one is refused, not cut."""
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError("too many rows to render")
        return cls(caption, label, list(df.columns), [list(r) for r in rows], notes)

    def to_csv(self, path: str | Path | None = None) -> str:
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(self.columns)
        w.writerows(self.rows)
        if path is not None:
            Path(path).write_text(out.getvalue(), encoding="utf-8")
        return out.getvalue()

    def to_latex(self) -> str:
        lines = ["\\begin{table}[t]", "\\centering", f"\\caption{{{self.caption}}}", f"\\label{{{self.label}}}", f"\\begin{{tabular}}{{l{'c' * (len(self.columns) - 1)}}}", "\\hline"]
        lines += [" & ".join(self.columns) + " \\\\", "\\hline", *(" & ".join(map(shown, r)) + " \\\\" for r in self.rows), "\\hline", "\\end{tabular}"]
        return "\n".join([*lines, *([f"\\footnotesize{{{self.notes}}}"] if self.notes else []), "\\end{table}"])

    def to_markdown(self) -> str:
        bar = lambda xs: "| " + " | ".join(xs) + " |"
        lines = [f"**{self.caption}**", "", bar(self.columns), bar(["---"] * len(self.columns)), *(bar(map(shown, r)) for r in self.rows)]
        return "\n".join([*lines, *(["", f"_{self.notes}_"] if self.notes else [])])
