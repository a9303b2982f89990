"""Queries on files, page sets, layout and Word documents; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import docx, layout, metric, pages, redact, rules
from quillspan.sources import files, scratch

from .detection import contacts, quoted, re2, redact_sql, rule_sql, spans_sql, tables
from .sources import CONTACTS, ITEMS, pick

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NAMES = f"SELECT p_partkey AS id, {pick('p_partkey', ['', '.', 'a.', 'x.tar.'])} || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE replace(p_name, ' ', '_') END || {pick('p_partkey', ['.PDF', '', '.txt', '.docx', '.'])} AS name FROM part"
_DOT = "(length(name) - position('.' IN reverse(name)))"
_HAS = "position('.' IN name) > 0"


@query(
    "file_names",
    f"""SELECT id, name, CASE WHEN NOT {_HAS} OR {_DOT} <= 0 THEN CASE WHEN name = '' THEN 'texte' ELSE name END || '_prv.txt' ELSE substr(name, 1, {_DOT}) || '_prv' || substr(name, {_DOT} + 1) END AS filtered,
 CASE WHEN {_HAS} AND {_DOT} > 0 THEN substr(name, 1, {_DOT}) WHEN name = '' THEN 'document' ELSE name END AS base, lower(string_split(name, '.')[-1]) AS ext,
 CASE lower(string_split(name, '.')[-1]) WHEN 'txt' THEN 'txt' WHEN 'docx' THEN 'docx' WHEN 'pdf' THEN 'pdf' ELSE CASE WHEN id % 3 = 0 THEN 'pdf' END END AS route, 'p. {{x}} ' || name || ' of ' || id AS filled FROM ({_NAMES})""".replace("{{x}}", "{x}"),
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = tables(spark, sf_dir, _NAMES, "part"), F.col("name")
    head = F.when(F.col("id") % 3 == 0, F.encode(F.lit("junk %PDF-1.7"), "UTF-8"))
    filled = X.fill(F.lit("p. {x} {name} of {count}"), {"name": name, "count": F.col("id")})
    return n.select("id", "name", X.filtered_name(name).alias("filtered"), X.base_name(name).alias("base"), X.extension_of(name).alias("ext"), X.route(name, F.lit(None).cast("string"), head).alias("route"), filled.alias("filled"))


_BASE = f"CASE WHEN {_HAS} AND {_DOT} > 0 THEN substr(name, 1, {_DOT}) WHEN name = '' THEN 'document' ELSE name END"
_KINDS = {"merge": "_fusion.pdf", "pages": "_pages.pdf", "part": "_1-3.pdf", "parts": "_decoupe.zip", "docx": ".docx", "pdf": ".pdf"}


@query("output_names", f"SELECT id, kind, {_BASE} || tail AS file FROM ({_NAMES}) CROSS JOIN (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in _KINDS.items())}) AS t(kind, tail)")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables(spark, sf_dir, _NAMES, "part").withColumn("kind", F.explode(F.array(*(F.lit(k) for k in _KINDS))))
    return n.select("id", "kind", X.output_name(F.col("name"), F.col("kind"), F.lit("1-3")).alias("file"))


@query("blank_texts", "SELECT c_custkey AS id, regexp_full_match(repeat(' ', CAST(c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE chr(9) || chr(10) END, '\\s*') AS blank FROM customer")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.repeat(F.lit(" "), (F.col("c_custkey") % 3).cast("int")), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("\t\n"))
    return c.select(F.col("c_custkey").alias("id"), X.is_blank(text).alias("blank"))


@query("text_source", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("text_files", "SELECT 'doc' || doc_id % 700 || '_prv.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS digest FROM documents")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is written as a file, some under equal names, and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc"), (F.col("doc_id") % 700).cast("string"), F.lit(".txt")).alias("name"), "text")
    path = scratch.folder(spark)
    files.write_texts(docs, path, text="text")
    return files.read_whole(spark, path, columns="name string, size long, content binary").select("name", "size", F.md5("content").alias("digest"))


@query("xml_entities", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS encoded, html AS decoded FROM pages")
def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.encode_xml(F.col("html")).alias("encoded"))
    return p.select("page_id", "encoded", X.decode_xml(F.col("encoded")).alias("decoded"))


_NAMED = "replace(replace(replace(replace(html, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query("html_entities", f"SELECT page_id AS id, {_NAMED} AS text, 'é< &nope; &lt; ' || chr(160) || ' 😀 \"' || page_id AS numbered FROM pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages decoded as they are, and a line of references by name and number."""
    numbered = F.concat(F.lit("&#233;&LT; &nope; &amp;lt; &nbsp; &#x1F600; &quot;"), F.col("page_id").cast("string"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.col("page_id").alias("id"), X.decode_html(F.col("html")).alias("text"), X.decode_html(numbered).alias("numbered"))


# ---------------------------------------------------------------- page sets

_FILES = "SELECT o_custkey AS set_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS file_order, o_orderkey AS doc_id, CAST(o_orderkey % 6 + 1 AS INT) AS page_count FROM orders"
_PAGES = f"SELECT set_id, file_order, doc_id, unnest(range(page_count)) AS page FROM ({_FILES})"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, _FILES, "orders")


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("page", F.explode(F.expr("sequence(0, page_count - 1)")))


@query("merge_pages", f"SELECT set_id, doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY set_id ORDER BY file_order, page) - 1 AS INT) AS out_page FROM ({_PAGES})")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.merge_pages(_page_rows(spark, sf_dir)).select("set_id", "doc_id", "page", "out_page")


@query("reorder_files", f"SELECT set_id, doc_id, CAST(CASE WHEN n < 4 THEN file_order WHEN file_order = 3 THEN 1 WHEN file_order BETWEEN 1 AND 2 THEN file_order + 1 ELSE file_order END AS INT) AS file_order FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS n FROM ({_FILES}))")
def reorder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.move_file(_files(spark, sf_dir), F.lit(3), F.lit(1)).select("set_id", "doc_id", "file_order")


@query("remove_file", f"SELECT set_id, doc_id, CAST(CASE WHEN file_order > 1 THEN file_order - 1 ELSE file_order END AS INT) AS file_order FROM ({_FILES}) WHERE file_order <> 1")
def remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.remove_file(_files(spark, sf_dir), F.lit(1)).select("set_id", "doc_id", "file_order")


_TEXT = pick("doc_id", ["1-3, 5", "2", " ; ,", "1 – 2;4", "3-2", "x", "0-1", "1,,6", "9", "1-"])
_RANGED = f"SELECT doc_id, page_count, {_TEXT} AS input FROM ({_FILES})"
_PARSED = f"""SELECT doc_id, page_count, CASE WHEN len(parts) = 0 THEN 'empty' ELSE list_filter(list_transform(parts, lambda p: CASE WHEN NOT regexp_full_match(p, '[0-9]+(\\s*[-–]\\s*[0-9]+)?') THEN 'syntax' WHEN CAST(regexp_extract(p, '^[0-9]+') AS INT) < 1 OR CAST(regexp_extract(p, '[0-9]+$') AS INT) > page_count OR CAST(regexp_extract(p, '^[0-9]+') AS INT) > CAST(regexp_extract(p, '[0-9]+$') AS INT) THEN 'bounds' END), lambda e: e IS NOT NULL)[1] END AS error, parts
 FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(input, '[,;]'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM ({_RANGED}))"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, _RANGED, "orders").withColumn("r", pages.parse_ranges(F.col("input"), F.col("page_count")))


@query("parse_ranges", f"SELECT doc_id, error, CASE WHEN error IS NULL THEN CAST(len(parts) AS INT) END AS n_groups, CASE WHEN error IS NULL THEN CAST(list_sum(list_transform(parts, lambda p: CAST(regexp_extract(p, '[0-9]+$') AS INT) - CAST(regexp_extract(p, '^[0-9]+') AS INT) + 1)) AS INT) END AS n_pages FROM ({_PARSED})")
def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _parsed(spark, sf_dir)
    return r.select("doc_id", "r.error", F.when(F.col("r.error").isNull(), F.size("r.groups")).alias("n_groups"), F.when(F.col("r.error").isNull(), F.size(F.flatten("r.groups"))).alias("n_pages"))


_SPLIT = f"SELECT doc_id, part, f, l, unnest(range(f - 1, l)) AS page FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, CAST(i - 1 AS INT) AS part, CAST(regexp_extract(parts[i], '^[0-9]+') AS INT) AS f, CAST(regexp_extract(parts[i], '[0-9]+$') AS INT) AS l FROM ({_PARSED}) WHERE error IS NULL)"


@query("split_pages", f"SELECT doc_id, part, CAST(page - f + 1 AS INT) AS place, CAST(page AS INT) AS page, CASE WHEN f = l THEN 'p' || f ELSE f || '-' || l END AS label FROM ({_SPLIT})")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _parsed(spark, sf_dir).filter("r.error is null").select("doc_id", "r.groups")
    return pages.split_pages(_page_rows(spark, sf_dir).select("doc_id", "page"), g).select("doc_id", "part", "place", "page", "label")


@query("extract_pages", f"SELECT doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INT) AS place, 'doc' || doc_id || '_pages.pdf' AS file FROM ({_PAGES}) WHERE (page * 7 + doc_id) % 3 <> 0")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_rows(spark, sf_dir)
    chosen = p.filter("(page * 7 + doc_id) % 3 <> 0").groupBy("doc_id").agg(F.array(F.array_sort(F.collect_list("page"))).alias("groups"))
    return pages.split_pages(p.select("doc_id", "page"), chosen).select("doc_id", "page", "place", X.output_name(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("pages")).alias("file"))


@query("split_each_page", f"SELECT doc_id, CAST(page AS INT) AS part, 'doc_p' || (page + 1) || '.pdf' AS file FROM ({_PAGES})")
def split_each_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).select("doc_id", F.posexplode(pages.each_page(F.col("page_count"))).alias("part", "g"))
    return f.select("doc_id", "part", X.output_name(F.lit("doc"), F.lit("part"), pages.group_label(F.col("g"))).alias("file"))


@query("select_range", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_sort(list_distinct(list_concat([1, 4], range(least(2, k), greatest(2, k) + 1)))), ',') WHEN k IN (1, 4) THEN CASE k WHEN 1 THEN '4' ELSE '1' END ELSE array_to_string(list_sort([1, 4, k]), ',') END AS selected FROM (SELECT doc_id, doc_id % 6 AS k FROM ({_FILES}))")
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") % 6).cast("int")
    s = pages.select_pages(F.array(F.lit(1), F.lit(4)), F.lit(2), k, F.col("doc_id") % 2 == 0)
    return _files(spark, sf_dir).select("doc_id", F.array_join(F.transform(s, lambda x: x.cast("string")), ",").alias("selected"))


# ---------------------------------------------------------------- text items of pages

_BODY = f"SELECT doc_id, page, string_agg(str || CASE WHEN has_eol THEN chr(10) ELSE '' END, '' ORDER BY item) AS body FROM ({ITEMS}) GROUP BY doc_id, page"
_ENDED = f"SELECT *, CASE WHEN body LIKE '%' || chr(10) OR (body = '' AND page > min(page) OVER (PARTITION BY doc_id)) THEN body ELSE body || chr(10) END AS b FROM ({_BODY})"
_ITEM_SPANS = f"""SELECT i.*, CAST(p.before + coalesce(sum(length(str) + CASE WHEN has_eol THEN 1 ELSE 0 END) OVER (PARTITION BY i.doc_id, i.page ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s
 FROM ({ITEMS}) i JOIN (SELECT doc_id, page, coalesce(sum(length(b)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_ENDED})) p USING (doc_id, page)"""


@query("pdf_text", f"SELECT doc_id, string_agg(b, '' ORDER BY page) AS text FROM ({_ENDED}) GROUP BY doc_id")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_text(tables(spark, sf_dir, ITEMS, "lineitem"))[0]


_RANGE = "SELECT DISTINCT l_orderkey AS doc_id, CAST(3 AS INT) AS r0, CAST(3 + l_orderkey % 40 AS INT) AS r1 FROM lineitem"


@query(
    "boxes_for",
    f"""SELECT doc_id, page, item, round(CASE WHEN horizontal THEN left_ + width * (greatest(r0, s) - s) / greatest(length(str), 1) ELSE left_ END - 0.15 * height, 6) AS x, round(top_ - 0.15 * height, 6) AS y,
 round(CASE WHEN horizontal THEN width * (least(r1, s + length(str)) - greatest(r0, s)) / greatest(length(str), 1) ELSE width END + 0.3 * height, 6) AS width, round(height * 1.3, 6) AS height FROM ({_ITEM_SPANS}) JOIN ({_RANGE}) USING (doc_id) WHERE greatest(r0, s) < least(r1, s + length(str))""",
)
def boxes_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables(spark, sf_dir, ITEMS, "lineitem").withColumnsRenamed({"left_": "left", "top_": "top"})
    _, spans = pages.page_text(items)
    ranges = tables(spark, sf_dir, _RANGE, "lineitem").select("doc_id", F.col("r0").alias("start"), F.col("r1").alias("end"))
    return pages.boxes(ranges, items, spans).select("doc_id", "page", "item", *(F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")))


_ITEM_CHARS = f"SELECT doc_id, page, item, unnest(range(1, length(str) + 1)) AS i, unnest(string_split(str, '')) AS c FROM ({ITEMS})"


@query(
    "boxes_by_width",
    f"""WITH s AS ({_ITEM_SPANS}), h AS (SELECT s.*, greatest(r0, s) - s AS a, least(r1, s + length(str)) - s AS b FROM s JOIN ({_RANGE}) USING (doc_id) WHERE greatest(r0, s) < least(r1, s + length(str))),
 w AS (SELECT doc_id, page, item, any_value(a) AS a, sum({metric.sql_advance('c')}) AS total, coalesce(sum(CASE WHEN i <= a THEN {metric.sql_advance('c')} END), 0) AS x0, sum(CASE WHEN i <= b THEN {metric.sql_advance('c')} END) AS x1 FROM h JOIN ({_ITEM_CHARS}) USING (doc_id, page, item) GROUP BY ALL)
 SELECT doc_id, page, item, round(CASE WHEN horizontal THEN left_ + width * x0 / total ELSE left_ END - 0.15 * height, 6) AS x, round(CASE WHEN horizontal THEN width * (x1 - x0) / total ELSE width END + 0.3 * height, 6) AS width FROM h JOIN w USING (doc_id, page, item)""",
)
def boxes_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables(spark, sf_dir, ITEMS, "lineitem").withColumnsRenamed({"left_": "left", "top_": "top"})
    _, spans = pages.page_text(items)
    ranges = tables(spark, sf_dir, _RANGE, "lineitem").select("doc_id", F.col("r0").alias("start"), F.col("r1").alias("end"))
    return pages.boxes(ranges, items, spans, by_width=True).select("doc_id", "page", "item", *(F.round(c, 6).alias(c) for c in ("x", "width")))


@query("render_plan", f"SELECT doc_id, page, n_boxes, round(least(2.0, 4000.0 / greatest(600.0 + page * 900, 800.0 * (page + 1))), 6) AS scale FROM (SELECT doc_id, page, count(*) AS n_boxes FROM ({_ITEM_SPANS}) JOIN ({_RANGE}) USING (doc_id) WHERE greatest(r0, s) < least(r1, s + length(str)) GROUP BY doc_id, page)")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables(spark, sf_dir, ITEMS, "lineitem").withColumnsRenamed({"left_": "left", "top_": "top"})
    _, spans = pages.page_text(items)
    ranges = tables(spark, sf_dir, _RANGE, "lineitem").select("doc_id", F.col("r0").alias("start"), F.col("r1").alias("end"))
    sizes = items.select("doc_id", "page").distinct().withColumns({"page_width": 600.0 + F.col("page") * 900, "page_height": 800.0 * (F.col("page") + 1)})
    return pages.render_plan(pages.boxes(ranges, items, spans), sizes).select("doc_id", "page", "n_boxes", F.round("scale", 6).alias("scale"))


@query("assemble_pages", f"SELECT doc_id, CAST(page AS INT) AS page, CASE WHEN (doc_id + page) % 4 = 0 THEN 'image' ELSE 'copy' END AS kind FROM ({_PAGES})")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_rows(spark, sf_dir).select("doc_id", "page")
    return pages.assemble(p, p.filter("(doc_id + page) % 4 = 0"))


@query("item_geometry", "SELECT l_orderkey AS doc_id, l_linenumber AS item, CASE WHEN l_linenumber % 3 = 0 THEN false ELSE true END AS horizontal, round(CASE WHEN l_linenumber % 3 = 0 THEN 50 - 0.9 * q ELSE 50.0 END, 6) AS x, round(CASE WHEN l_linenumber % 3 = 0 THEN 700.0 - p ELSE 700 - 0.9 * q END, 6) AS y, round(CASE WHEN l_linenumber % 3 = 0 THEN 1.15 * q ELSE p END, 6) AS w, round(CASE WHEN l_linenumber % 3 = 0 THEN p ELSE 1.15 * q END, 6) AS h FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS q, CAST(l_partkey % 100 + 1 AS DOUBLE) AS p FROM lineitem)")
def item_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, turned = F.col("l_quantity").cast("double"), F.col("l_linenumber") % 3 == 0
    raw = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("item"), F.when(turned, 0.0).otherwise(q).alias("a"), F.when(turned, q).otherwise(0.0).alias("b"), F.when(turned, -q).otherwise(0.0).alias("c"), F.when(turned, 0.0).otherwise(q).alias("d"), F.lit(50.0).alias("e"), F.lit(100.0).alias("f"), F.lit(800.0).alias("page_height"), (F.col("l_partkey") % 100 + 1).cast("double").alias("advance"))
    return pages.item_geometry(raw).select("doc_id", "item", "horizontal", *(F.round(c, 6).alias(n) for c, n in (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h"))))


# ---------------------------------------------------------------- layout

#: Words of documents as styled items, line by line.
def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "n", F.posexplode(F.split("line", " ")).alias("k", "str"))
    rows = rows.withColumn("item", F.struct("n", "k"))
    size = F.when(F.col("n") % 9 == 0, 20.0).when(F.col("n") % 9 == 4, 15.0).otherwise(11.0)
    return rows.select("doc_id", F.floor(F.col("n") / 20).cast("int").alias("page"), "item", "str", (F.col("k") * 40.0).alias("x"), (F.col("n") % 20 * 18.0 + F.col("k") % 3).alias("y"), (F.length("str") * 5.0).alias("width"), size.alias("size"), (F.col("k") % 5 == 0).alias("bold"), (F.col("k") % 7 == 3).alias("italic"))


#: The same items; the fold over a page's items that the sweep replaces; lines, runs, spaces between items.
_PLACED = """SELECT doc_id, n // 20 AS page, n, k, str, k * 40.0 AS x, n % 20 * 18.0 + k % 3 AS y, length(str) * 5.0 AS width, CASE WHEN n % 9 = 0 THEN 20.0 WHEN n % 9 = 4 THEN 15.0 ELSE 11.0 END AS size, k % 5 = 0 AS bold, k % 7 = 3 AS italic
 FROM (SELECT doc_id, n, unnest(range(len(ws))) AS k, unnest(ws) AS str FROM (SELECT doc_id, n, string_split(line, ' ') AS ws FROM (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))) WHERE str <> ''"""
_NEAR = "list_position(list_transform(a.heads, lambda h: abs(h.y - i.y) < greatest(h.size, i.size) * 0.5), true)"
_S = re2(X.SPACE)
_LINES_SQL = f"""items AS MATERIALIZED ({_PLACED}),
 heads AS (SELECT doc_id, page, list_reduce(list_prepend(struct_pack(heads := CAST([] AS STRUCT(y DOUBLE, size DOUBLE)[]), lines := CAST([] AS BIGINT[]), y := CAST(0 AS DOUBLE), size := CAST(0 AS DOUBLE)), list(struct_pack(heads := CAST([] AS STRUCT(y DOUBLE, size DOUBLE)[]), lines := CAST([] AS BIGINT[]), y := CAST(y AS DOUBLE), size := CAST(size AS DOUBLE)) ORDER BY y, x, n, k)),
  lambda a, i: struct_pack(heads := CASE WHEN {_NEAR} > 0 THEN list_transform(a.heads, lambda h, j: CASE WHEN j = {_NEAR} THEN struct_pack(y := h.y, size := greatest(h.size, i.size)) ELSE h END) ELSE list_append(a.heads, struct_pack(y := i.y, size := i.size)) END, lines := list_append(a.lines, CASE WHEN {_NEAR} > 0 THEN {_NEAR} ELSE len(a.heads) + 1 END), y := i.y, size := i.size)) AS r FROM items GROUP BY doc_id, page),
 each AS (SELECT i.*, h.r.lines[row_number() OVER (PARTITION BY i.doc_id, i.page ORDER BY y, x, n, k)] AS line FROM items i JOIN heads h USING (doc_id, page)),
 spaced AS (SELECT *, str || CASE WHEN NOT regexp_matches(str, '[{_S}]$') AND NOT regexp_matches(lead(str) OVER o, '^[{_S}]') AND lead(x) OVER o - (x + width) > lead(size) OVER o * 0.15 THEN ' ' ELSE '' END AS piece, CASE WHEN bold = lag(bold) OVER o AND italic = lag(italic) OVER o THEN 0 ELSE 1 END AS turn FROM each WINDOW o AS (PARTITION BY doc_id, page, line ORDER BY x, y, n, k)),
 numbered AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, page, line ORDER BY x, y, n, k ROWS UNBOUNDED PRECEDING) AS run FROM spaced),
 runs AS (SELECT doc_id, page, line, run, string_agg(piece, '' ORDER BY x, y, n, k) AS t, any_value(bold) AS bold, any_value(italic) AS italic, min(y) AS y, max(size) AS size, min(x) AS x, max(run) OVER (PARTITION BY doc_id, page, line) AS last FROM numbered GROUP BY doc_id, page, line, run),
 trimmed AS (SELECT *, CASE WHEN run = 1 AND run = last THEN regexp_replace(regexp_replace(t, '^[{_S}]+', ''), '[{_S}]+$', '') WHEN run = 1 THEN regexp_replace(t, '^[{_S}]+', '') WHEN run = last THEN regexp_replace(t, '[{_S}]+$', '') ELSE t END AS text FROM runs),
 lines AS MATERIALIZED (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, line) - 1 AS line_no, y, x, size, texts, bolds, italics FROM (SELECT doc_id, page, line, min(y) AS y, min(x) AS x, max(size) AS size, list(text ORDER BY run) FILTER (text <> '') AS texts, list(bold ORDER BY run) FILTER (text <> '') AS bolds, list(italic ORDER BY run) FILTER (text <> '') AS italics FROM trimmed GROUP BY doc_id, page, line))"""


@query("layout_lines", f"WITH {_LINES_SQL} SELECT doc_id, CAST(page AS INT) AS page, CAST(line_no AS INT) AS line_no, y, x, size, array_to_string(texts, '') AS line_text, CAST(len(texts) AS INT) AS n_runs FROM lines WHERE len(texts) > 0")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.lines(_styled(spark, sf_dir))
    return rows.select("doc_id", "page", "line_no", "y", "x", "size", layout.text_of(F.col("runs")).alias("line_text"), F.size("runs").alias("n_runs"))


#: Lines of equal keys that are left in any order are of one size.
_LINE_SIZES = "SELECT l_orderkey AS doc_id, 0 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS line_no, CAST(8 + l_partkey % 4 + l_suppkey % 3 / 4.0 AS DOUBLE) AS size, repeat('a', CAST(l_quantity AS INT)) AS str FROM lineitem"


@query("body_size", f"SELECT doc_id, half AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) AS r FROM (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS half, sum(length(str)) AS n, min(line_no) AS met FROM ({_LINE_SIZES}) GROUP BY ALL)) WHERE r = 1")
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, _LINE_SIZES, "lineitem").withColumn("runs", F.array(F.struct(F.col("str").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))))
    return layout.body_size(rows)


@query("heading_level", "SELECT p_partkey AS id, CASE WHEN p_size / 20.0 >= 1.8 THEN 1 WHEN p_size / 20.0 >= 1.45 THEN 2 WHEN p_size / 20.0 >= 1.25 THEN 3 END AS level FROM part")
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), layout.heading_level(F.col("p_size").cast("double"), F.lit(20.0)).alias("level"))


@query(
    "layout_blocks",
    f"""WITH {_LINES_SQL},
 full_lines AS (SELECT *, array_to_string(texts, '') AS whole, floor(size * 2 + 0.5) / 2 AS half FROM lines WHERE len(texts) > 0),
 bodies AS (SELECT doc_id, half AS body FROM (SELECT doc_id, half, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(whole)) DESC, min(page * 1000000 + line_no)) AS r FROM full_lines GROUP BY doc_id, half) WHERE r = 1),
 levels AS (SELECT *, CASE WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.45 THEN 2 WHEN size / body >= 1.25 THEN 3 END AS level FROM full_lines JOIN bodies USING (doc_id)),
 ons AS (SELECT *, coalesce(y - lag(y) OVER o <= 1.6 * greatest(size, lag(size) OVER o) AND abs(size - lag(size) OVER o) <= 0.1 * lag(size) OVER o AND NOT regexp_matches(whole, '(?i)^[{_S}]*(?:[•◦▪‣–—-]|[0-9]+[.)]|[a-z][.)])[{_S}]') AND (level IS NULL) = lag(level IS NULL) OVER o, false) AS going FROM levels WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_no)),
 blocks AS (SELECT *, sum(CASE WHEN going THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block, coalesce(lead(going) OVER o, false) AS goes_on, regexp_matches(texts[-1], '[A-Za-zÀ-ÿ]-$') AND regexp_matches(lead(whole) OVER o, '^[a-zà-ÿ]') AS cut FROM ons WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_no)),
 own AS (SELECT doc_id, page, block, CASE WHEN arg_min(coalesce(level, 0), line_no) > 0 THEN 'heading' ELSE 'paragraph' END AS kind, nullif(arg_min(coalesce(level, 0), line_no), 0) AS level, string_agg(CASE WHEN goes_on AND cut THEN substr(whole, 1, length(whole) - 1) WHEN goes_on THEN whole || ' ' ELSE whole END, '' ORDER BY line_no) AS block_text FROM blocks GROUP BY doc_id, page, block),
 every AS (SELECT * FROM own UNION ALL SELECT doc_id, page, 0, 'pageBreak', NULL, '' FROM (SELECT DISTINCT doc_id, n // 20 AS page, min(n // 20) OVER (PARTITION BY doc_id) AS f FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)) WHERE page > f)
 SELECT doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block) - 1 AS INT) AS block_no, kind, CAST(level AS INT) AS level, block_text FROM every""",
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.blocks(_styled(spark, sf_dir))
    return b.select("doc_id", "page", "block_no", "kind", "level", layout.text_of(F.col("runs")).alias("block_text"))


# ---------------------------------------------------------------- HTML and Word

_TAG = "<(/?)([a-zA-Z0-9]+)([^>]*?)(/?)>|([^<]+)"


@query("html_tokens", f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, s AS span_start, v AS token FROM ({spans_sql('SELECT page_id AS doc_id, html AS text FROM pages', _TAG)})")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.operators.spans import span_rows

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return span_rows(p, _TAG).select("doc_id", "pos", F.col("start").alias("span_start"), F.col("value").alias("token"))


@query("html_styles", f"""SELECT doc_id, CAST(i - 1 AS INT) AS pos, v AS token, coalesce(b, 0) > 0 AS bold, coalesce(t, 0) > 0 AS italic FROM (SELECT *, sum(CASE WHEN regexp_matches(v, '(?i)^<(strong|b|th)[^a-z0-9]') THEN 1 WHEN regexp_matches(v, '(?i)^</(strong|b|th)[^a-z0-9]') THEN -1 ELSE 0 END) OVER w AS b,
 sum(CASE WHEN regexp_matches(v, '(?i)^<(em|i)[^a-z0-9]') THEN 1 WHEN regexp_matches(v, '(?i)^</(em|i)[^a-z0-9]') THEN -1 ELSE 0 END) OVER w AS t FROM ({spans_sql('SELECT page_id AS doc_id, html AS text FROM pages', _TAG)}) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE v[1] <> '<'""")
def html_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.operators.html import styles

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return styles(p).select("doc_id", "pos", "token", "bold", "italic")


def _html_machine() -> str:
    """SQL that reads the tokens of a page one by one and keeps what is open: the text being collected, lists and a table."""
    inl = "STRUCT(kind VARCHAR, text VARCHAR, bold BOOLEAN, italic BOOLEAN)[]"
    one = lambda kind, text, b="false", i="false": f"struct_pack(kind := '{kind}', text := {text}, bold := {b}, italic := {i})"
    entities = {"lt": "'<'", "gt": "'>'", "quot": "chr(34)", "apos": "chr(39)", "nbsp": "chr(160)", "amp": "'&'"}
    text = "v"
    for name, char in entities.items():
        text = f"regexp_replace({text}, '&{name};', {char}, 'gi')"
    image = "'(?i)src=\"data:image/(png|jpeg|jpg);base64,([^\"]+)\"'"
    tokens = f"""SELECT doc_id, i, v, v NOT LIKE '</%' AS o, CASE WHEN v[1] = '<' THEN lower(regexp_extract(v, '^</?([a-zA-Z0-9]+)', 1)) ELSE '' END AS t, {text} AS txt,
 lower(regexp_extract(v, {image}, 1)) AS img, regexp_extract(v, {image}, 2) AS data FROM ({spans_sql('SELECT page_id AS doc_id, html AS text FROM pages', _TAG)})"""
    boxed, titled = "(cell IS NOT NULL OR lists[-1].item IS NOT NULL)", "regexp_full_match(t, 'p|h[1-6]')"
    add = f"""CASE WHEN t = '' THEN {one('text', 'txt', 'b > 0', 'it > 0')} WHEN t = 'br' THEN {one('break', 'chr(10)')} WHEN t = 'img' AND img <> '' THEN struct_pack(kind := CASE WHEN img = 'png' THEN 'png' ELSE 'jpg' END, text := data, bold := false, italic := false)
 WHEN {titled} AND o AND {boxed} AND len(coalesce(cell, lists[-1].item)) > 0 THEN {one('break', 'chr(10)')} END"""
    held = lambda ordered, n, item: f"[struct_pack(ordered := {ordered}, n := {n}, item := {item})]"
    block = lambda kind, level, inlines, ordered="NULL", number="NULL": f"struct_pack(kind := {kind}, level := CAST({level} AS INT), ordered := CAST({ordered} AS BOOLEAN), number := CAST({number} AS INT), inlines := {inlines})"
    flush = "lists[-1].ordered, lists[-1].n"
    step = f"""SELECT doc_id, i,
 CASE WHEN t IN ('strong', 'b') OR t = 'th' AND row_ IS NOT NULL AND (o OR cell IS NOT NULL) THEN b + CASE WHEN o THEN 1 ELSE -1 END ELSE b END AS b,
 CASE WHEN t IN ('em', 'i') THEN it + CASE WHEN o THEN 1 ELSE -1 END ELSE it END AS it,
 CASE WHEN {titled} AND NOT {boxed} THEN CASE WHEN o THEN CAST([] AS {inl}) END WHEN added IS NOT NULL AND NOT {boxed} AND buf IS NOT NULL THEN list_append(buf, added) ELSE buf END AS buf,
 CASE WHEN {titled} AND NOT {boxed} THEN CASE WHEN o THEN t END ELSE tag END AS tag,
 CASE WHEN t IN ('ul', 'ol') AND o THEN list_concat(CASE WHEN len(lists) > 0 THEN list_concat(lists[:-2], {held('lists[-1].ordered', 'lists[-1].n', f'CAST(NULL AS {inl})')}) ELSE lists END, {held("t = 'ol'", '0', f'CAST(NULL AS {inl})')})
 WHEN t IN ('ul', 'ol') THEN lists[:-2] WHEN len(lists) = 0 THEN lists
 WHEN t = 'li' THEN list_concat(lists[:-2], {held('lists[-1].ordered', 'lists[-1].n + CASE WHEN o THEN 1 ELSE 0 END', f'CASE WHEN o THEN CAST([] AS {inl}) END')})
 WHEN added IS NOT NULL AND cell IS NULL AND lists[-1].item IS NOT NULL THEN list_concat(lists[:-2], {held('lists[-1].ordered', 'lists[-1].n', 'list_append(lists[-1].item, added)')}) ELSE lists END AS lists,
 CASE WHEN t = 'table' THEN CASE WHEN o THEN 0 END WHEN t = 'tr' AND NOT o AND row_ IS NOT NULL THEN rows_ + 1 ELSE rows_ END AS rows_,
 CASE WHEN t = 'table' THEN CASE WHEN o THEN CAST([] AS {inl}) END WHEN t = 'tr' AND NOT o AND row_ IS NOT NULL THEN list_append(list_concat(tab, row_), {one('row', 'chr(10)')}) ELSE tab END AS tab,
 CASE WHEN t = 'table' THEN NULL WHEN t = 'tr' AND rows_ IS NOT NULL THEN CASE WHEN o THEN CAST([] AS {inl}) END WHEN t IN ('td', 'th') AND NOT o AND row_ IS NOT NULL AND cell IS NOT NULL THEN list_append(list_concat(row_, cell), {one('cell', 'chr(9)')}) ELSE row_ END AS row_,
 CASE WHEN t = 'table' THEN NULL WHEN t IN ('td', 'th') AND row_ IS NOT NULL THEN CASE WHEN o THEN CAST([] AS {inl}) END WHEN added IS NOT NULL AND cell IS NOT NULL THEN list_append(cell, added) ELSE cell END AS cell,
 CASE WHEN {titled} AND NOT o AND NOT {boxed} AND len(buf) > 0 THEN {block("CASE WHEN tag = 'p' THEN 'paragraph' ELSE 'heading' END", "CASE WHEN tag = 'p' THEN '0' ELSE tag[2] END", 'buf')}
 WHEN (t IN ('ul', 'ol') OR t = 'li' AND NOT o) AND len(lists[-1].item) > 0 THEN {block("'listItem'", 'len(lists) - 1', 'lists[-1].item', *flush.split(', '))}
 WHEN t = 'table' AND NOT o AND rows_ > 0 THEN {block("'table'", 'rows_', 'tab')} END AS done
 FROM (SELECT w.* EXCLUDE (i, done), k.i, k.t, k.o, {add} AS added FROM walk w JOIN tok k ON k.doc_id = w.doc_id AND k.i = w.i + 1)"""
    start = f"SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, 0 AS b, 0 AS it, CAST(NULL AS {inl}) AS buf, CAST(NULL AS VARCHAR) AS tag, CAST([] AS STRUCT(ordered BOOLEAN, n INTEGER, item {inl})[]) AS lists, CAST(NULL AS INT) AS rows_, CAST(NULL AS {inl}) AS tab, CAST(NULL AS {inl}) AS row_, CAST(NULL AS {inl}) AS cell, CAST(NULL AS STRUCT(kind VARCHAR, level INT, ordered BOOLEAN, number INT, inlines {inl})) AS done FROM tok"
    shown = "array_to_string(list_transform(done.inlines, lambda x: x.kind || CASE WHEN x.bold THEN '*' ELSE '' END || CASE WHEN x.italic THEN '/' ELSE '' END || ':' || x.text), '|')"
    return f"""WITH RECURSIVE tok AS MATERIALIZED ({tokens}), walk AS ({start} UNION ALL {step})
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_no, done.kind AS kind, done.level AS level, done.ordered AS ordered, done.number AS number, {shown} AS inlines FROM walk WHERE done IS NOT NULL"""


def rendered_blocks(docs: DataFrame) -> DataFrame:
    """Blocks with their inlines as one string: kind, marks of style and text of each."""
    from quillspan.operators.html import blocks

    one = lambda x: F.concat(x["kind"], F.when(x["bold"], "*").otherwise(""), F.when(x["italic"], "/").otherwise(""), F.lit(":"), x["text"])
    return blocks(docs).withColumn("inlines", F.array_join(F.transform("inlines", one), "|"))


@query("html_blocks", _html_machine())
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


def _part_sql(text: str) -> str:
    """A Word part: a paragraph for each line, a tracked change in the first."""
    return f"""'<w:p><w:ins w:author="A b"><w:r><w:t xml:space="preserve">' || replace({text}, chr(10), '</w:t></w:r></w:p><w:p><w:r><w:tab/><w:t>') || '</w:t></w:r></w:ins><w:del w:id="1"><w:t>gone</w:t></w:del></w:p>'"""


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contacts(spark, sf_dir)
    make = lambda name, sql: docs.select("doc_id", F.lit(name).alias("name"), F.expr(sql).alias("xml"))
    body = make("word/document.xml", _part_sql(_ESCAPED))
    head = make("word/header1.xml", "concat('<w:p><w:t>Head </w:t><w:t/><w:br/><w:t>', doc_id, '</w:t></w:p>')")
    core = make("docProps/core.xml", "'<a><dc:creator>Someone</dc:creator><dc:title x=\"1\">T</dc:title><z>kept</z></a>'")
    return body.unionByName(head).unionByName(core)


@query("docx_accept_changes", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(xml, '<w:del\\b[^>]*>.*?</w:del>', '', 'gs'), '<w:moveFrom\\b[^>]*>.*?</w:moveFrom>', '', 'gs'), '</?w:(?:ins|moveTo)\\b[^>]*>', '', 'g') AS xml FROM (SELECT doc_id, {_part_sql(_ESCAPED)} AS xml FROM (SELECT c_custkey AS doc_id, c_name || chr(10) || c_mktsegment AS text FROM customer))")
def docx_accept_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "SELECT c_custkey AS doc_id, c_name || chr(10) || c_mktsegment AS text FROM customer", "customer")
    return docs.select("doc_id", docx.accept_changes(F.expr(_part_sql(_ESCAPED))).alias("xml"))


@query("docx_text", "SELECT c_custkey AS doc_id, c_name || chr(10) || chr(9) || c_mktsegment || chr(10) || 'Head ' || chr(10) || c_custkey || chr(10) AS text FROM customer")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages are zipped, read back and turned into text."""
    docs = tables(spark, sf_dir, "SELECT c_custkey AS doc_id, c_name || chr(10) || c_mktsegment AS text FROM customer", "customer")
    body = docs.select("doc_id", F.lit("word/document.xml").alias("name"), F.expr(_part_sql(_ESCAPED)).alias("xml"))
    head = docs.select("doc_id", F.lit("word/header1.xml").alias("name"), F.expr("concat('<w:p><w:t>Head </w:t><w:t/><w:br/><w:t>', doc_id, '</w:t></w:p>')").alias("xml"))
    files = docx.unzip(docx.zip_parts(body.unionByName(head))).filter("error is null")
    return docx.parts(files)[1]


@query("package_errors", "SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'damaged' WHEN 1 THEN 'password' END AS error FROM customer")
def package_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the packages are cut off, a third have the mark of an encrypted entry; none fails the job."""
    docs = tables(spark, sf_dir, "SELECT c_custkey AS doc_id, c_name AS text FROM customer", "customer")
    whole = docx.zip_parts(docs.select("doc_id", F.lit("word/document.xml").alias("name"), F.expr(_part_sql(_ESCAPED)).alias("xml")))
    locked = F.unhex(F.regexp_replace(F.hex("content"), "(504B0102[0-9A-F]{8})0000", "$10100"))
    content = F.when(F.col("doc_id") % 3 == 0, F.expr("substring(content, 1, 40)")).when(F.col("doc_id") % 3 == 1, locked).otherwise(F.col("content"))
    return docx.unzip(whole.select("doc_id", content.alias("content"))).select("doc_id", "error").distinct()


#: The text of these packages, and each of its lines before and after the redaction.
_PACKAGE_TEXT = f"SELECT doc_id, replace(text, chr(10), chr(10) || chr(9)) || chr(10) || 'Head ' || chr(10) || doc_id || chr(10) AS text FROM ({CONTACTS})"
_PACKAGE_FOUND = " UNION ALL ".join(f"SELECT r.*, '{rules.BY_NAME[n].type}' AS type, t.text FROM ({rule_sql(n, _PACKAGE_TEXT)}) r JOIN ({_PACKAGE_TEXT}) t USING (doc_id)" for n in ("email", "ip", "date_fr"))
_PACKAGE_LINES = f"SELECT doc_id, unnest(range(len(a))) AS i, len(a) AS n, unnest(a) AS old, unnest(b) AS new FROM (SELECT doc_id, string_split(t.text, chr(10)) AS a, string_split(r.redacted, chr(10)) AS b FROM ({_PACKAGE_TEXT}) t JOIN ({redact_sql(_PACKAGE_FOUND, _PACKAGE_TEXT)}) r USING (doc_id))"
_ENCODED = "replace(replace(replace(ltrim(new, chr(9)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "docx_redact",
    f"""SELECT doc_id, 'word/document.xml' AS name, string_agg('<w:p><w:r>' || CASE WHEN i > 0 THEN '<w:tab/>' ELSE '' END || CASE WHEN i = 0 OR old <> new THEN '<w:t xml:space="preserve">' ELSE '<w:t>' END || {_ENCODED} || '</w:t></w:r></w:p>', '' ORDER BY i) AS xml FROM ({_PACKAGE_LINES}) WHERE i < n - 3 GROUP BY doc_id
 UNION ALL SELECT c_custkey, 'word/header1.xml', '<w:p><w:t>Head </w:t><w:t/><w:br/><w:t>' || c_custkey || '</w:t></w:p>' FROM customer
 UNION ALL SELECT c_custkey, 'docProps/core.xml', '<a><dc:creator></dc:creator><dc:title x="1"></dc:title><z>kept</z></a>' FROM customer""",
)
def docx_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _packages(spark, sf_dir)
    _, text = docx.parts(files)
    plan = redact.plan(rules.candidates(text, [rules.BY_NAME[n] for n in ("email", "ip", "date_fr")]))
    return docx.redact(files, plan)


@query("docx_clear_metadata", "SELECT c_custkey AS doc_id, '<w:c w:author=\"\" w:initials=\"\" w15:author=\"\" w:id=\"' || c_custkey || '\"/>' AS xml, '<a><dc:creator></dc:creator><dc:title x=\"1\"></dc:title><z>kept</z></a>' AS core, '<p><Company></Company><Manager></Manager><App>x</App></p>' AS app FROM customer")
def docx_clear_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    xml = F.concat(F.lit('<w:c w:author="'), F.col("c_name"), F.lit('" w:initials="x" w15:author="'), F.col("c_mktsegment"), F.lit('" w:id="'), F.col("c_custkey").cast("string"), F.lit('"/>'))
    core = F.concat(F.lit("<a><dc:creator>"), F.col("c_name"), F.lit('</dc:creator><dc:title x="1">T\nU</dc:title><z>kept</z></a>'))
    app = F.concat(F.lit("<p><Company>"), F.col("c_name"), F.lit("</Company><Manager>M</Manager><App>x</App></p>"))
    return c.select(F.col("c_custkey").alias("doc_id"), docx.clear_authors(xml).alias("xml"), docx.clear_core(core).alias("core"), docx.clear_app(app).alias("app"))
