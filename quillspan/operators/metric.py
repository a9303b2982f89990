"""Widths of texts from a table of advances by code point.

A text's prefix sums are made once; the width of any range of it is then a subtraction.  Advances are whole
thousandths of the font size, so all sums and comparisons are exact.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Advances of the printable ASCII characters in a common sans-serif font, from the space on; of any other
# character; of wide ones; first and last code points of wide characters and of those that take no room.
ASCII = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556]
ASCII += [1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556]
ASCII += [333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
OTHER, WIDE, SPACE = 556, 1000, ASCII[0]
WIDE_RANGES = [(0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF01, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1FAFF), (0x20000, 0x3FFFD)]
NO_ROOM = [(0x00, 0x1F), (0x7F, 0x9F), (0xAD, 0xAD), (0x300, 0x36F), (0x200B, 0x200F), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
#: Letters with accents are as wide as without, up to here.
ACCENTED = 0x1F00


@cache
def advances() -> np.ndarray:
    """The advance of every code point."""
    table = np.full(0x110000, OTHER, np.int64)
    table[0x20:0x7F] = ASCII
    for i in range(0xA0, ACCENTED):
        base = ord(unicodedata.normalize("NFD", chr(i))[0])
        if 0x20 <= base < 0x7F:
            table[i] = table[base]
    table[0xA0] = SPACE
    for ranges, advance in ((WIDE_RANGES, WIDE), (NO_ROOM, 0)):
        for lo, hi in ranges:
            table[lo : hi + 1] = advance
    return table


def prefix(text: str) -> np.ndarray:
    """Widths of all beginnings of a text, the empty one first."""
    run = np.zeros(len(text) + 1, np.int64)
    np.cumsum(advances()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], out=run[1:])
    return run


@F.pandas_udf(T.ArrayType(T.LongType()))
def prefix_widths(text: pd.Series) -> pd.Series:
    """The prefix sums of each text, for `range_width`; null gives those of an empty text."""
    whole = [x or "" for x in text]
    run = prefix("".join(whole))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int64)
    return pd.Series([run[a : b + 1] - run[a] for a, b in zip(ends[:-1], ends[1:])])


def range_width(widths: Column, start: Column, end: Column) -> Column:
    """Width of the characters start to end (half-open) in thousandths of the font size."""
    return F.get(widths, end) - F.get(widths, start)


def measure_text(text: Column) -> Column:
    """Width of a text in thousandths of the font size."""
    return F.element_at(prefix_widths(text), -1)


def sql_advance(char: str) -> str:
    """SQL for the advance of a character (the same table, for the other engine)."""
    table = advances()
    by: dict[int, list[int]] = {}
    for i in range(ACCENTED):
        if table[i] != OTHER:
            by.setdefault(int(table[i]), []).append(i)
    narrow = " ".join(f"WHEN unicode({char}) IN ({', '.join(map(str, c))}) THEN {a}" for a, c in by.items())
    ranges = lambda rs: " OR ".join(f"unicode({char}) BETWEEN {lo} AND {hi}" for lo, hi in rs if hi >= ACCENTED)
    return f"CASE {narrow} WHEN {ranges(NO_ROOM)} THEN 0 WHEN {ranges(WIDE_RANGES)} THEN {WIDE} ELSE {OTHER} END"
