"""Simple HTML to blocks: headings, paragraphs, list items and tables.

What is open around a token follows from running sums and last values over the tokens before it, so all of it
is windows over the tokens of a document, which one shuffle brings together:

* the last table, row or cell tag tells whether a cell is open, and which;
* the running sum of list tags, held above 0, is the depth of lists, and the last opener of a depth its list;
* the last item tag of that list tells whether an item is open, and its number;
* outside of both, the last paragraph or heading tag tells whether one is open.

A text belongs to the innermost of these, named by the place of its opening tag.  A block exists if a tag
closes it, and stands where that tag stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import decode_html

from .spans import span_rows

# The grammar of tags and texts, and of the images that are kept.
TAG = "<(/?)([a-zA-Z0-9]+)([^>]*?)(/?)>|([^<]+)"
IMAGE = '(?i)src="data:image/(png|jpeg|jpg);base64,([^"]+)"'
INLINES = "array<struct<kind:string,text:string,bold:boolean,italic:boolean>>"


def _tag(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, "^</?([a-zA-Z0-9]+)", 1))


def styles(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """H3: the texts of a page with the depth of bold and italic around them."""
    rows = span_rows(docs, TAG, id_col, text)
    tag = _tag(F.col("value"))
    step = lambda names: F.when(tag.isin(names), F.when(F.col("value").startswith("</"), -1).otherwise(1)).otherwise(0)
    w = W.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("bold", F.sum(step(["strong", "b", "th"])).over(w) > 0).withColumn("italic", F.sum(step(["em", "i"])).over(w) > 0)
    return rows.filter(~F.col("value").startswith("<")).withColumnRenamed("value", "token")


def opened(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every token with what is open after it (cell, item, para: the place of the opening tag, -1 or null: none) and
    before it (the same names with `was_`)."""
    t, opens = F.col("tag"), F.col("opens")
    w = W.partitionBy("doc_id").orderBy("pos")
    last = lambda c, over=w: F.last(c, ignorenulls=True).over(over)
    here = F.when(opens, F.col("pos")).otherwise(-1)
    step = lambda *names: F.when(t.isin(*names), F.when(opens, 1).otherwise(-1)).otherwise(0)
    rows = span_rows(docs, TAG, id_col, text).select(F.col(id_col).alias("doc_id"), "pos", "value")
    rows = rows.withColumn("tag", _tag(F.col("value"))).withColumn("opens", ~F.col("value").startswith("</"))
    # tables
    rows = rows.withColumns({"table": last(F.when(t == "table", here)), "row": last(F.when(t == "table", -1).when(t == "tr", here)), "lists": F.sum(step("ul", "ol")).over(w)})
    in_row = (F.col("row") >= 0) & (F.col("table") >= 0)
    is_cell = t.isin("td", "th") & F.coalesce(in_row, F.lit(False))
    rows = rows.withColumn("cell", last(F.when(t == "table", -1).when(is_cell, here))).withColumn("depth", F.col("lists") - F.least(F.lit(0), F.min("lists").over(w)))
    # lists; an opener knows its kind by the tag, and lists of one depth follow each other
    level = W.partitionBy("doc_id", "depth").orderBy("pos")
    begins = t.isin("ul", "ol") & opens
    rows = rows.withColumn("list", last(F.when(begins, F.struct("pos", (t == "ol").alias("ordered"))), level))
    own = W.partitionBy("doc_id", "depth", "list.pos").orderBy("pos")
    item = F.when(t == "li", here).when(t.isin("ul", "ol"), -1)
    inside = F.col("depth") > 0
    rows = rows.withColumns({"item": F.when(inside, last(item, own)), "number": F.sum(F.when((t == "li") & opens, 1).otherwise(0)).over(own)})
    boxed = F.coalesce(F.col("cell") >= 0, F.lit(False)) | F.coalesce(F.col("item") >= 0, F.lit(False))
    titled = t.rlike("^(?:p|h[1-6])\\z")
    free = titled & ~boxed
    rows = rows.withColumns({"boxed": boxed, "para": last(F.when(free, here)), "title": last(F.when(free & opens, t))})
    before = {f"was_{c}": F.lag(c).over(w) for c in ("cell", "row", "table", "item", "para", "title", "depth", "list", "number")}
    rows = rows.withColumns(before).withColumns({"is_cell": is_cell, "free": free, "titled": titled})
    head = (t == "th") & F.col("is_cell") & (opens | F.coalesce(F.col("was_cell") >= 0, F.lit(False)))
    by = F.when(opens, 1).otherwise(-1)
    return rows.withColumns({"bold": F.sum(F.when(t.isin("strong", "b") | head, by).otherwise(0)).over(w) > 0, "italic": F.sum(step("em", "i")).over(w) > 0})


def _inlines(rows: DataFrame) -> DataFrame:
    """doc_id, box (kind and place of what holds them), inlines; a paragraph in a box that holds something is a break."""
    t, value = F.col("tag"), F.col("value")
    box = F.when(F.col("cell") >= 0, F.struct(F.lit("cell").alias("kind"), F.col("cell").alias("at"))).when(F.col("item") >= 0, F.struct(F.lit("item").alias("kind"), F.col("item").alias("at"))).when(F.col("para") >= 0, F.struct(F.lit("para").alias("kind"), F.col("para").alias("at")))
    image = F.lower(F.regexp_extract("value", IMAGE, 1))
    kind = F.when(t == "", "text").when(t == "br", "break").when((t == "img") & (image != ""), F.when(image == "png", "png").otherwise("jpg"))
    between = F.col("titled") & F.col("boxed") & F.col("opens")
    rows = rows.select("doc_id", "pos", "value", "bold", "italic", box.alias("box"), kind.alias("kind"), between.alias("between")).filter("box is not null and (kind is not null or between)")
    earlier = F.count("kind").over(W.partitionBy("doc_id", "box.kind", "box.at").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("earlier", earlier).filter("kind is not null or earlier > 0").withColumn("kind", F.coalesce("kind", F.lit("break")))
    content = F.when(F.col("kind") == "text", decode_html(value)).when(F.col("kind") == "break", "\n").otherwise(F.regexp_extract("value", IMAGE, 2))
    plain = F.col("kind") == "text"
    one = F.struct("pos", "kind", content.alias("text"), (F.col("bold") & plain).alias("bold"), (F.col("italic") & plain).alias("italic"))
    held = rows.groupBy("doc_id", "box").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return held.select("doc_id", "box", F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic"))).alias("inlines"))


def _mark(kind: str, text: str) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))


def _tables(rows: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id, end, n_rows, inlines: every closed table's closed rows and cells, a mark after each."""
    t, opens = F.col("tag"), F.col("opens")
    cells = rows.filter(F.col("is_cell") & ~opens & (F.col("was_cell") >= 0)).select("doc_id", F.col("row").alias("of"), F.col("pos").alias("end"), F.struct(F.lit("cell").alias("kind"), F.col("was_cell").alias("at")).alias("box"))
    cells = cells.join(held, ["doc_id", "box"], "left").withColumn("inlines", F.concat(F.coalesce("inlines", F.array().cast(INLINES)), _mark("cell", "\t")))
    by_place = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("end", c))), lambda x: x[c]))
    cells = cells.groupBy("doc_id", "of").agg(by_place("inlines").alias("inlines"))
    ends = rows.filter((t == "tr") & ~opens & (F.col("was_row") >= 0) & (F.col("was_table") >= 0)).select("doc_id", F.col("was_row").alias("of"), F.col("was_table").alias("table"), F.col("pos").alias("end"))
    lines = ends.join(cells, ["doc_id", "of"], "left").withColumn("inlines", F.concat(F.coalesce("inlines", F.array().cast(INLINES)), _mark("row", "\n")))
    lines = lines.groupBy("doc_id", "table").agg(F.count("*").cast("int").alias("n_rows"), by_place("inlines").alias("inlines"))
    closed = rows.filter((t == "table") & ~opens & (F.col("was_table") >= 0)).select("doc_id", F.col("was_table").alias("table"), F.col("pos").alias("end"))
    return closed.join(lines, ["doc_id", "table"]).select("doc_id", "end", "n_rows", "inlines")


def blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """H2, H4, H5: doc_id, block_no, kind, level, ordered, number, inlines.

    Defined results: a null text has no blocks; what no tag closes is left out; text outside of all boxes, too.
    """
    rows = opened(docs, id_col, text)
    held = _inlines(rows)
    t, opens = F.col("tag"), F.col("opens")
    none = lambda kind: F.lit(None).cast(kind)
    box = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at")).alias("box")
    is_head = F.col("was_title") != "p"
    para = rows.filter(F.col("free") & ~opens & (F.col("was_para") >= 0)).select("doc_id", F.col("pos").alias("end"), box("para", "was_para"), F.when(is_head, "heading").otherwise("paragraph").alias("kind"), F.when(is_head, F.substr("was_title", F.lit(2)).cast("int")).otherwise(0).alias("level"), none("boolean").alias("ordered"), none("int").alias("number"))
    flushed = (t == "li") & ~opens | t.isin("ul", "ol")
    items = rows.filter(flushed & (F.col("was_item") >= 0)).select("doc_id", F.col("pos").alias("end"), box("item", "was_item"), F.lit("listItem").alias("kind"), (F.col("was_depth") - 1).cast("int").alias("level"), F.col("was_list.ordered").alias("ordered"), F.col("was_number").cast("int").alias("number"))
    out = para.unionByName(items).join(held, ["doc_id", "box"]).drop("box")
    tables = _tables(rows, held).select("doc_id", "end", F.lit("table").alias("kind"), F.col("n_rows").alias("level"), none("boolean").alias("ordered"), none("int").alias("number"), "inlines")
    out = out.unionByName(tables)
    number = (F.row_number().over(W.partitionBy("doc_id").orderBy("end")) - 1).cast("int")
    return out.select("doc_id", number.alias("block_no"), "kind", "level", "ordered", "number", "inlines")
