"""Text layout: greedy wrapping and shrinking to fit. Order-dependent, so an Arrow-batched UDF; measures as in functions.text."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shoal.functions.text import WIDTH_DIGIT, WIDTH_LOWER, WIDTH_UPPER, WIDTHS

# The share of a frame that text may take, the least share of the nominal size, the smallest size,
# the margin of a size that would just fit, and the tracking from which letters are set apart.
SAFE_WIDTH, MIN_SCALE, SMALLEST, MARGIN, SPREAD = 0.84, 0.62, 14.0, 0.98, 5
FIT_SCHEMA = "struct<lines:array<string>,size:int,width:double>"


def advances(text: str) -> list[int]:
    return [WIDTHS.get(c) or (WIDTH_DIGIT if c.isdigit() else WIDTH_UPPER if c.isupper() else WIDTH_LOWER) for c in text]


def measure(text: str, size: float) -> float:
    return sum(advances(text)) * size / 1000.0


def spaced(text: str, tracking: int) -> str:
    return text if tracking < SPREAD else "   ".join(" ".join(w) for w in text.split(" "))


def split_word(word: str, size: float, most: float, tracking: int = 0) -> list[str]:
    """A word cut into the fewest parts that fit, each as long as can be; a letter alone always counts as fitting.

    Prefix sums of the advances (and of the blanks between letters set apart) make each part one search.
    """
    blank = WIDTHS[" "] if tracking >= SPREAD else 0
    upto = list(accumulate((a + blank for a in advances(word)), initial=0))
    cuts = [0]
    while cuts[-1] < len(word):
        room = upto[cuts[-1]] + most * 1000.0 / size + blank  # no blank stands after the last letter
        cuts.append(max(cuts[-1] + 1, bisect_right(upto, room + 1e-9) - 1))
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def wrap(text: str, size: float, most: float, max_lines: int, tracking: int = 0) -> list[str]:
    """Greedy lines; what doesn't fit into ``max_lines`` joins the last."""
    words = [p for w in text.split() for p in split_word(w, size, most, tracking)]
    lines: list[str] = []
    for w in words:
        longer = f"{lines[-1]} {w}" if lines else w
        if lines and measure(spaced(longer, tracking), size) <= most:
            lines[-1] = longer
        else:
            lines.append(w)
    if len(lines) > max_lines:
        lines = [*lines[: max_lines - 1], " ".join(lines[max_lines - 1 :])]
    return [spaced(x, tracking) for x in lines]


def fit(text: str, nominal: float, frame: int, max_lines: int = 3, tracking: int = 0) -> tuple[list[str], int, float]:
    """Lines, rounded size and width. While a line is too wide, the size goes to the one at which it would fit, less a
    margin, but not below 0.62 of the nominal size nor 14. A text without words keeps the nominal size."""
    most, least, size = frame * SAFE_WIDTH, max(SMALLEST, nominal * MIN_SCALE), float(nominal)
    if not text.split():
        return [], int(nominal), 0.0
    while True:
        lines = wrap(text, size, most, max_lines, tracking)
        width = max(measure(x, size) for x in lines)
        if width <= most or size <= least:
            return lines, round(size), width
        size = max(least, MARGIN * size * most / width)


def fit_column(text: Column, nominal: float, frame: int, max_lines: int = 3, tracking: int = 0) -> Column:
    @F.pandas_udf(FIT_SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [fit(t or "", nominal, frame, max_lines, tracking) for t in s]
        return pd.DataFrame(rows, columns=["lines", "size", "width"])

    return run(text)
