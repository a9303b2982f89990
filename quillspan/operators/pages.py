"""Page sets and page geometry as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators.intervals import overlapping
from quillspan.operators.metric import prefix_widths, range_width

from quillspan.functions.text import SPACE

# Margin around a box as a share of the text height; rendering limits; reach of letters above and below the baseline.
MARGIN, SCALE, MAX_SIDE, ASCENT, DESCENT = 0.15, 2.0, 4000.0, 0.9, 0.25


def merge_pages(pages: DataFrame) -> DataFrame:
    """set_id, file_order, page -> out_page (from 0): all pages of all files of a set in order."""
    return pages.withColumn("out_page", F.row_number().over(W.partitionBy("set_id").orderBy("file_order", "page")) - 1)


def move_file(files: DataFrame, source: Column, target: Column) -> DataFrame:
    """file_order after the file at `source` has gone to `target`; places outside the list change nothing."""
    n = F.count("*").over(W.partitionBy("set_id"))
    p = F.col("file_order")
    new = F.when((target < 0) | (target >= n) | (source < 0) | (source >= n), p).when(p == source, target).when((p > source) & (p <= target), p - 1).when((p < source) & (p >= target), p + 1).otherwise(p)
    return files.withColumn("file_order", new.cast("int"))


def remove_file(files: DataFrame, place: Column) -> DataFrame:
    rest = files.filter(F.col("file_order") != place)
    return rest.withColumn("file_order", F.row_number().over(W.partitionBy("set_id").orderBy("file_order")) - 1)


def parse_ranges(text: Column, page_count: Column) -> Column:
    """P5: struct<groups, error> of "1-3, 4; 7": pages from 0, or empty, syntax or bounds, whichever part fails first."""
    trim = lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+\\z", "")
    shape = f"^([0-9]+)(?:[{SPACE}]*[-–][{SPACE}]*([0-9]+))?\\z"
    parts = F.filter(F.transform(F.split(text, "[,;]", -1), trim), lambda x: x != "")

    def ends(x: Column) -> tuple[Column, Column]:
        last = F.regexp_extract(x, shape, 2)
        first = F.regexp_extract(x, shape, 1)
        return first.try_cast("long"), F.when(last == "", first).otherwise(last).try_cast("long")

    def fault(x: Column) -> Column:
        a, b = ends(x)
        return F.when(~x.rlike(shape), "syntax").when((a < 1) | (b > page_count) | (a > b) | a.isNull() | b.isNull(), "bounds")

    error = F.when(F.size(parts) == 0, "empty").otherwise(F.get(F.filter(F.transform(parts, fault), lambda e: e.isNotNull()), F.lit(0)))
    groups = F.transform(parts, lambda x: F.sequence(ends(x)[0].cast("int") - 1, ends(x)[1].cast("int") - 1))
    return F.struct(F.when(error.isNull(), groups).alias("groups"), error.alias("error"))


def group_label(group: Column) -> Column:
    """X18"""
    first, last = F.element_at(group, 1) + 1, F.element_at(group, -1) + 1
    return F.when(F.size(group) == 1, F.concat(F.lit("p"), first.cast("string"))).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def split_pages(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """P4 (and P3 with one group): pages doc_id, page, ...; groups doc_id, groups -> part, place and the page's columns."""
    g = groups.select("doc_id", F.posexplode("groups").alias("part", "g")).select("doc_id", "part", "g", F.posexplode("g").alias("place", "page"))
    return g.withColumn("label", group_label(F.col("g"))).drop("g").join(pages, ["doc_id", "page"])


def each_page(page_count: Column) -> Column:
    """P6"""
    return F.when(page_count > 0, F.transform(F.sequence(F.lit(0), page_count.cast("int") - 1), lambda i: F.array(i))).otherwise(F.array().cast("array<array<int>>"))


def select_pages(selected: Column, anchor: Column, clicked: Column, shift: Column) -> Column:
    """A click toggles a page; with shift and an anchor it adds all between."""
    between = F.array_union(selected, F.sequence(F.least(anchor, clicked), F.greatest(anchor, clicked)))
    toggled = F.when(F.array_contains(selected, clicked), F.array_remove(selected, clicked)).otherwise(F.array_append(selected, clicked))
    return F.array_sort(F.when(shift & anchor.isNotNull(), between).otherwise(toggled))


def page_text(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items doc_id, page, item, str, has_eol.  Gives doc_id, text and doc_id, page, item, start, end."""
    piece = F.concat("str", F.when(F.col("has_eol"), "\n").otherwise(""))
    rows = items.withColumn("_piece", piece)
    pages = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "_piece"))), lambda x: x["_piece"]), "").alias("_body"))
    first = F.col("page") == F.min("page").over(W.partitionBy("doc_id"))
    pages = pages.withColumn("_body", F.when(F.col("_body").endswith("\n") | ((F.col("_body") == "") & ~first), F.col("_body")).otherwise(F.concat("_body", F.lit("\n"))))
    before = F.coalesce(F.sum(F.length("_body")).over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = pages.withColumn("_before", before)
    text = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_body"))), lambda x: x["_body"]), "").alias("text"))
    inside = F.coalesce(F.sum(F.length("_piece")).over(W.partitionBy("doc_id", "page").orderBy("item").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = rows.withColumn("_inside", inside).join(pages.select("doc_id", "page", "_before"), ["doc_id", "page"])
    start = (F.col("_before") + F.col("_inside")).cast("int")
    return text, spans.select("doc_id", "page", "item", start.alias("start"), (start + F.length("str")).alias("end"))


def boxes(ranges: DataFrame, items: DataFrame, spans: DataFrame, by_width: bool = False) -> DataFrame:
    """P10: rectangles over the parts of items that ranges (doc_id, start, end) reach.

    A part of a horizontal item lies where its characters do: all as wide as each other or, by_width, by the table of
    advances.
    """
    s = spans.select("doc_id", "page", "item", F.col("start").alias("s0"), F.col("end").alias("s1")).join(items, ["doc_id", "page", "item"])
    s = s.filter("s0 < s1").withColumn("_widths", prefix_widths("str") if by_width else F.lit(None))
    hit = overlapping(ranges.select("doc_id", "start", "end").filter("start < end"), s, "doc_id", "start", "end", "s0", "s1")
    part = (lambda x: range_width(F.col("_widths"), F.lit(0), (x - F.col("s0")).cast("int"))) if by_width else (lambda x: x - F.col("s0"))
    total = F.greatest(F.element_at("_widths", -1) if by_width else F.length("str"), F.lit(1))
    at = lambda x: F.col("left") + F.col("width") * part(x) / total
    x0 = F.when(F.col("horizontal"), at(F.greatest("start", "s0"))).otherwise(F.col("left"))
    x1 = F.when(F.col("horizontal"), at(F.least("end", "s1"))).otherwise(F.col("left") + F.col("width"))
    m = F.col("height") * MARGIN
    return hit.select("doc_id", "page", "start", "item", (x0 - m).alias("x"), (F.col("top") - m).alias("y"), (x1 - x0 + 2 * m).alias("width"), (F.col("height") + 2 * m).alias("height"))


def item_geometry(raw: DataFrame) -> DataFrame:
    """Text matrix a..f, advance width, page height -> left, top, width, height, horizontal (origin at the top left)."""
    h = lambda x, y: F.hypot(F.col(x), F.col(y))
    size = F.when(h("c", "d") != 0, h("c", "d")).when(h("a", "b") != 0, h("a", "b")).otherwise(1.0)
    run = F.when(h("a", "b") != 0, h("a", "b")).otherwise(1.0)
    ax, ay, up_x, up_y = F.col("a") / run, F.col("b") / run, F.col("c") / size, F.col("d") / size
    at = lambda n, rise: (F.col("e") + ax * n + up_x * rise * size, F.col("page_height") - (F.col("f") + ay * n + up_y * rise * size))
    w, zero = F.col("advance"), F.lit(0.0)
    corners = [at(n, F.lit(r)) for n in (zero, w) for r in (-DESCENT, ASCENT)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    (x0, y0), (x1, y1) = at(zero, zero), at(w, zero)
    flat = (F.abs(y1 - y0) < 0.5) & (x1 >= x0)
    return raw.withColumns({"horizontal": flat, "left": F.when(flat, x0).otherwise(F.least(*xs)), "top": F.least(*ys), "width": F.when(flat, x1 - x0).otherwise(F.greatest(*xs) - F.least(*xs)), "height": F.greatest(*ys) - F.least(*ys)})


def render_plan(box_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages to paint, with their number of boxes and scale."""
    hit = box_rows.groupBy("doc_id", "page").agg(F.count("*").alias("n_boxes")).join(pages, ["doc_id", "page"])
    return hit.withColumn("scale", F.least(F.lit(SCALE), MAX_SIDE / F.greatest("page_width", "page_height")))


def assemble(pages: DataFrame, painted: DataFrame) -> DataFrame:
    """Painted pages become images, the others are copied; `painted` has doc_id, page and further columns."""
    return pages.join(painted.withColumn("_image", F.lit(True)), ["doc_id", "page"], "left").withColumn("kind", F.when(F.col("_image"), "image").otherwise("copy")).drop("_image")
