"""Where the lines of a document go on its pages, by a table of advances instead of fonts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators import metric
from quillspan.sources.scratch import written

# A4 in points, margins, sizes, indents and space around blocks.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, BODY, TABLE, LINE, INDENT, PADDING = 595.28, 841.89, 56.69, 11.0, 10.0, 1.35, 18.0, 4.0
HEADINGS, BULLETS = [20.0, 16.0, 13.5, 12.0, 11.5, 11.0], ["•", "◦", "▪"]
BEFORE_HEADING, AFTER = 10.0, {"heading": 4.0, "listItem": 2.0, "paragraph": 6.0}


def _broken(text: str, width: int, by_width: bool) -> list[str]:
    """Greedy lines: each begins where the last ends and takes all parts up to the last that fits, found in the prefix sums."""
    text = text.replace("\t", " ")
    run, space = (metric.prefix(text), metric.SPACE) if by_width else (np.arange(len(text) + 1), 1)
    parts, gaps = [], []
    for word in re.finditer("[^ ]+", text):
        at, end, gap = word.start(), word.end(), space if parts else 0
        while at < end:
            # a word wider than the line is cut where it no longer fits, after one character at least
            cut = end if run[end] - run[at] <= width else min(end, max(at + 1, int(np.searchsorted(run, run[at] + width, "right")) - 1))
            parts.append((at, cut))
            gaps.append(gap)
            at, gap = cut, 0
    if not parts:
        return []
    starts, ends = np.array(parts).T
    size = run[ends] - run[starts]
    right = np.cumsum(size + np.array(gaps))
    left, out, i = right - size, [], 0
    while i < len(parts):
        j = max(i + 1, int(np.searchsorted(right, left[i] + width, "right")))
        out.append("".join((" " if gaps[k] and k > i else "") + text[slice(*parts[k])] for k in range(i, j)))
        i = j
    return out


def break_lines(text: Column, width: Column, by_width: bool = False) -> Column:
    """Greedy lines of at most `width` characters or, by_width, thousandths of the font size: spaces at a line's ends
    go, runs of spaces are one, longer words are cut.  Null and blank texts give no line."""

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([_broken(x or "", int(w), by_width) for x, w in zip(texts, widths)])

    return lines(text, width)


def marker(ordered: Column, number: Column, level: Column) -> Column:
    """T4: what stands before a list item."""
    bullets = F.array(*map(F.lit, BULLETS))
    return F.when(ordered, F.concat(number.cast("string"), F.lit("."))).otherwise(F.get(bullets, F.pmod(level, F.lit(len(BULLETS)))))


def block_size(kind: Column, level: Column) -> Column:
    sizes = F.array(*map(F.lit, HEADINGS))
    return F.when(kind == "heading", F.get(sizes, F.least(level, F.lit(6)) - 1)).otherwise(BODY)


def _steps(blocks: DataFrame) -> DataFrame:
    """What a document's lines ask of its pages, in order: doc_id, op, block_no, line_no (null: room asked for by a
    heading), at (height used up before, as if there were one endless page), need, height; in thousandths of a point."""
    milli = lambda c: F.round(c * 1000).cast("long")
    size = block_size(F.col("kind"), F.col("level"))
    heading = F.col("kind") == "heading"
    after = F.lit(AFTER["paragraph"])
    for name, gap in AFTER.items():
        after = F.when(F.col("kind") == name, gap).otherwise(after)
    height = milli(size * LINE)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    step = lambda line, need, used, tall: F.struct(line.alias("line_no"), need.alias("need"), used.alias("used"), tall.alias("height"))
    # a heading asks for two lines, then leaves some space
    ahead = F.when(heading, F.array(step(none, milli(size * LINE * 2 + BEFORE_HEADING), milli(F.lit(BEFORE_HEADING)), zero))).otherwise(F.array())
    line = lambda i: step(i.cast("int"), height, height + F.when(i == F.col("n_lines") - 1, milli(after)).otherwise(zero), height)
    every = F.concat(ahead, F.transform(F.sequence(F.lit(0), F.col("n_lines") - 1), line))
    rows = blocks.filter("n_lines > 0").select("doc_id", "block_no", F.posexplode(every).alias("k", "s")).select("doc_id", "block_no", "k", "s.*")
    w = W.partitionBy("doc_id").orderBy("block_no", "k")
    at = F.coalesce(F.sum("used").over(w.rowsBetween(W.unboundedPreceding, -1)), zero)
    return rows.select("doc_id", (F.row_number().over(w) - 1).alias("op"), "block_no", "line_no", at.alias("at"), "need", "height")


def _successors(steps: DataFrame, room: int) -> DataFrame:
    """doc_id, op, next: the first step that no longer fits on a page that begins with `op` (none: no row).

    A step at height `at` that needs `need` turns the page if both pass what the page's first step has before it plus the
    room of a page, and if the page has something on it; both together say at + least(need, room) > start + room.  The
    running maximum of the left side only grows, so its place among the right sides is the successor: one ordered pass.
    """
    reach = F.col("at") + F.least("need", F.lit(room))
    ordered = W.partitionBy("doc_id").orderBy("op")
    ends = steps.select("doc_id", "op", F.max(reach).over(ordered).alias("value"), F.lit(0).alias("asks"))
    asks = steps.select("doc_id", "op", (F.col("at") + room).alias("value"), F.lit(1).alias("asks"))
    passed = F.sum(1 - F.col("asks")).over(W.partitionBy("doc_id").orderBy("value", "asks").rowsBetween(W.unboundedPreceding, 0))
    last = F.max("op").over(W.partitionBy("doc_id"))
    both = ends.unionByName(asks).withColumn("next", passed).withColumn("last", last)
    return both.filter("asks = 1 and next <= last").select("doc_id", "op", F.col("next").cast("int").alias("next"))


def paginate(blocks: DataFrame) -> DataFrame:
    """Blocks doc_id, block_no, kind, level, n_lines -> doc_id, block_no, line_no, page, y.

    A new page begins where a height no longer fits and the page is not empty; a heading asks for room for the line
    that follows it.  Where a page that begins with some step ends is a function of that step alone.  The steps that
    really begin pages are those reached from a document's first one: found in as many rounds as the logarithm of the
    number of pages, each of which doubles both the jumps and the beginnings known.
    """
    top, room = round((PAGE_HEIGHT - MARGIN) * 1000), round((PAGE_HEIGHT - 2 * MARGIN) * 1000)
    steps = written(_steps(blocks))
    jumps = written(_successors(steps, room))
    starts = steps.filter("op = 0").select("doc_id", "op", F.lit(0).alias("page"))
    stride = 1
    while True:
        more = starts.join(jumps, ["doc_id", "op"]).select("doc_id", F.col("next").alias("op"), (F.col("page") + stride).alias("page"))
        grown = written(starts.unionByName(more))
        if not grown.filter(F.col("page") >= stride).limit(1).count():
            break
        starts, stride = grown, stride * 2
        far = jumps.select("doc_id", F.col("op").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(far, ["doc_id", "next"]).select("doc_id", "op", F.col("far").alias("next")))
    w = W.partitionBy("doc_id").orderBy("op")
    begun = steps.join(starts, ["doc_id", "op"], "left").withColumn("from", F.when(F.col("page").isNotNull(), F.col("at")))
    placed = begun.withColumn("page", F.last("page", True).over(w)).withColumn("from", F.last("from", True).over(w)).filter("line_no is not null")
    return placed.select("doc_id", "block_no", "line_no", "page", ((F.lit(top) - (F.col("at") - F.col("from")) - F.col("height")) / 1000).alias("y"))


def table_rows(cells: DataFrame) -> DataFrame:
    """Cells doc_id, row_no, col_no, n_lines -> doc_id, row_no, n_columns, column_width, height."""
    wide = cells.groupBy("doc_id").agg((F.max("col_no") + 1).alias("n_columns"))
    rows = cells.groupBy("doc_id", "row_no").agg((F.greatest(F.lit(1), F.max("n_lines")) * (TABLE * LINE) + 2 * PADDING).alias("height"))
    return rows.join(wide, "doc_id").withColumn("column_width", (PAGE_WIDTH - 2 * MARGIN) / F.col("n_columns"))
