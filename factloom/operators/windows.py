"""Windows of a chunk for a scorer with a token limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.batch import batch_function

WINDOW_TOKENS = 380
HEADER_ROWS = 3


def split_windows(text: str, limit: int = WINDOW_TOKENS, count=lambda line: len(line.split())) -> list[str]:
    """Windows of whole lines that cost at most ``limit`` (a line: its tokens and one). A window that begins inside a table
    repeats the caption, the table's mark and its first rows, unless its first line is one of these."""
    lines = text.split("\n")
    out, held, cost = [], [], 0
    caption, opening, inside = "", [], False
    for i, line in enumerate(lines):
        mark = line.strip()
        if mark == "<TABLE>":
            inside, opening = True, ([caption] if caption else []) + lines[i : i + 1 + HEADER_ROWS]
        inside = inside and mark != "</TABLE>"
        own = count(line) + 1
        if held and cost + own > limit:
            out.append("\n".join(held))
            held = list(opening) if inside and line not in opening else []
            cost = sum(count(h) + 1 for h in held)
        held.append(line)
        cost += own
        caption = line if mark else caption
    return [*out, "\n".join(held)] if held else out


def windows_of(text: Column, limit: int = WINDOW_TOKENS) -> Column:
    @batch_function("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_windows(t or "", limit))

    return split(text)
