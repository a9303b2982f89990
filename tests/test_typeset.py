"""Widths, lines and pages against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import metric, typeset


def plain_lines(text, width):
    """Piece by piece, with the width of a line so far."""
    measure = lambda s: sum(int(metric.advances()[ord(c)]) for c in s)
    lines, now, used = [], [], 0

    def flush():
        nonlocal now, used
        while now and now[-1] == " ":
            now.pop()
        if now:
            lines.append("".join(now))
        now, used = [], 0

    for piece in re.split("( +)", text.replace("\t", " ")):
        if not piece:
            continue
        if piece.startswith(" "):
            if now:
                now.append(" ")
                used += measure(" ")
            continue
        parts, part = [], ""
        for c in piece:
            if part and measure(part + c) > width:
                parts.append(part)
                part = ""
            part += c
        for part in [*parts, part] if measure(piece) > width else [piece]:
            if used + measure(part) > width and now:
                flush()
            now.append(part)
            used += measure(part)
    flush()
    return lines


def test_widths(spark):
    texts = ["", "A", "él é", "日本 x", "áb", "​\n", None, "😀Wi" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", metric.prefix_widths("text"))
    want = {i: [sum(int(metric.advances()[ord(c)]) for c in (x or "")[:n]) for n in range(len(x or "") + 1)] for i, x in enumerate(texts)}
    assert {r.id: list(r.w) for r in df.collect()} == want
    part = df.filter("id = 7").select(metric.range_width(F.col("w"), F.lit(3), F.lit(10)).alias("p"), metric.measure_text(F.col("text")).alias("all")).head()
    assert part.p == want[7][10] - want[7][3] and part["all"] == want[7][-1]
    assert metric.advances()[ord("é")] == metric.advances()[ord("e")] and metric.advances()[0x3042] == 1000


@pytest.mark.parametrize("seed", range(2))
def test_lines(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("iIlWmé日á.", k=r.choice([1, 2, 3, 5, 8, 40])))
    texts = ["".join(r.choices([word(), word(), " ", "  ", "\t"], k=r.randrange(0, 30))) for _ in range(150)] + [" ".join(word() for _ in range(60)) for _ in range(30)]
    rows = [(i, x, r.choice([1, 600, 2500, 9000, 40000])) for i, x in enumerate([*texts, None, "", "   ", "W" * 500])]
    df = spark.createDataFrame(rows, "id int, text string, width int").withColumn("l", typeset.break_lines(F.col("text"), F.col("width"), by_width=True))
    assert {x.id: list(x.l) for x in df.collect()} == {i: plain_lines(x or "", w) for i, x, w in rows}


def plain_pages(blocks):
    """blocks of one document: (block_no, kind, level, n_lines), line by line with the place so far."""
    top, margin = round((typeset.PAGE_HEIGHT - typeset.MARGIN) * 1000), round(typeset.MARGIN * 1000)
    page, y, out = 0, top, []

    def ensure(h):
        nonlocal page, y
        if y - h < margin and y < top:
            page, y = page + 1, top

    for no, kind, level, n in sorted(blocks):
        size = typeset.HEADINGS[min(level, 6) - 1] if kind == "heading" else typeset.BODY
        h = round(size * typeset.LINE * 1000)
        if n and kind == "heading":
            ensure(round((size * typeset.LINE * 2 + typeset.BEFORE_HEADING) * 1000))
            y -= round(typeset.BEFORE_HEADING * 1000)
        for i in range(n):
            ensure(h)
            y -= h
            out.append((no, i, page, y / 1000))
        if n:
            y -= round(typeset.AFTER[kind] * 1000)
    return out


def test_pages(spark):
    r = random.Random(4)
    rows = []
    for doc in range(12):
        for no in range(r.choice([0, 1, 3, 60, 300])):
            rows.append((doc, no, r.choice(["heading", "paragraph", "paragraph", "listItem"]), r.randrange(1, 8), r.choice([0, 1, 1, 2, 5, 60])))
    # a heading as the last but one line that fits must go on with the next page
    rows += [(50, 0, "paragraph", 1, 46), (50, 1, "heading", 1, 1), (50, 2, "paragraph", 1, 1), (51, 0, "heading", 1, 1)]
    got = typeset.paginate(spark.createDataFrame(rows, "doc_id int, block_no int, kind string, level int, n_lines int"))
    want = [(doc, *x) for doc in {x[0] for x in rows} for x in plain_pages([x[1:] for x in rows if x[0] == doc])]
    assert sorted(tuple(x) for x in got.select("doc_id", "block_no", "line_no", "page", "y").collect()) == sorted(want)
    moved = {x[1]: x[3] for x in want if x[0] == 50 and x[2] == 0}
    assert moved[0] == 0 and moved[1] == 1


def test_pages_of_a_long_document(spark):
    rows = [(1, i, "heading" if i % 9 == 0 else "paragraph", i % 3 + 1, 10) for i in range(10_000)]
    got = typeset.paginate(spark.createDataFrame(rows, "doc_id int, block_no int, kind string, level int, n_lines int"))
    want = plain_pages([x[1:] for x in rows])
    assert len(want) == 100_000 and max(x[2] for x in want) > 2000
    sums = got.agg(F.count("*").alias("n"), F.sum("page").alias("p"), F.round(F.sum(F.col("y") * (F.col("block_no") % 7 + 1)), 3).alias("y")).head()
    assert sums.n == 100_000 and sums.p == sum(x[2] for x in want) and abs(sums.y - sum(x[3] * (x[0] % 7 + 1) for x in want)) < 1
