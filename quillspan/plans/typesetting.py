"""Queries of typesetting; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import metric, typeset

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))


def measure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("widths", metric.prefix_widths("text"))
    first, last = F.least(F.length("text"), F.lit(3)), F.least(F.length("text"), (F.col("doc_id") % 40 + 3).cast("int"))
    return docs.select("doc_id", F.element_at("widths", -1).alias("width"), metric.range_width(F.col("widths"), first, last).alias("part_width"))


#: Width of a line between the margins, in thousandths of the body's size.
LINE_WIDTH = int((typeset.PAGE_WIDTH - 2 * typeset.MARGIN) / typeset.BODY * 1000)


def break_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "block_no", F.posexplode(typeset.break_lines(F.col("line"), F.lit(90))).alias("line_no", "line"))


def break_lines_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "block_no", F.posexplode(typeset.break_lines(F.col("line"), F.lit(LINE_WIDTH), by_width=True)).alias("line_no", "line"))


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("kind", F.when(F.col("block_no") % 7 == 0, "heading").otherwise("paragraph")).withColumn("level", (F.col("block_no") % 3 + 1).cast("int"))
    return typeset.paginate(rows.withColumn("n_lines", F.ceil(F.length("line") / 90).cast("int")))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("row_no"), (F.col("l_partkey") % 4).alias("col_no"), (F.col("l_suppkey") % 5).cast("int").alias("n_lines"))
    return typeset.table_rows(cells).select("doc_id", "row_no", F.col("n_columns").cast("long").alias("n_columns"), F.round("column_width", 6).alias("column_width"), F.round("height", 6).alias("height"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), typeset.marker(F.col("p_size") % 2 == 0, F.col("p_size"), (F.col("p_partkey") % 5).cast("int")).alias("marker"))


QUERIES |= {"measure_text": measure_text, "break_lines": break_lines, "break_lines_by_width": break_lines_by_width, "paginate": paginate, "table_rows": table_rows, "list_markers": list_markers}
SQL["table_rows"] = """SELECT doc_id, row_no, n_columns, round((595.28 - 2 * 56.69) / n_columns, 6) AS column_width, round(height, 6) AS height FROM (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS row_no, greatest(1, max(l_suppkey % 5)) * 13.5 + 8 AS height FROM lineitem GROUP BY ALL)
 JOIN (SELECT l_orderkey AS doc_id, max(l_partkey % 4) + 1 AS n_columns FROM lineitem GROUP BY ALL) USING (doc_id)"""
SQL["list_markers"] = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size || '.' ELSE CASE (p_partkey % 5) % 3 WHEN 0 THEN '•' WHEN 1 THEN '◦' ELSE '▪' END END AS marker FROM part"

_CHARS = f"SELECT doc_id, i, {metric.sql_advance('c')} AS a FROM (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')"
SQL["measure_text"] = f"""SELECT doc_id, CAST(coalesce(w, 0) AS BIGINT) AS width, CAST(coalesce(p, 0) AS BIGINT) AS part_width
 FROM documents LEFT JOIN (SELECT doc_id, sum(a) AS w, sum(CASE WHEN i BETWEEN 4 AND doc_id % 40 + 3 THEN a END) AS p FROM ({_CHARS}) GROUP BY doc_id) USING (doc_id)"""

_BLOCKS = "SELECT doc_id, unnest(range(len(ls))) AS block_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
#: Words, those wider than a line cut from one jump to the next; then lines, likewise.
_BROKEN = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, block_no, unnest(range(len(ws))) AS k, unnest(ws) AS word FROM (SELECT doc_id, block_no, regexp_extract_all(replace(line, chr(9), ' '), '[^ ]+') AS ws FROM ({_BLOCKS}))),
 c AS (SELECT word, i, sum($ADVANCE) OVER (PARTITION BY word ORDER BY i) AS run FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i, unnest(string_split(word, '')) AS c FROM (SELECT DISTINCT word FROM w))),
 v AS MATERIALIZED (SELECT word, max(run) AS width FROM c GROUP BY word),
 e AS MATERIALIZED (SELECT word, run, max(i) AS i FROM (SELECT * FROM c UNION ALL SELECT word, 0, 0 FROM v) WHERE word IN (SELECT word FROM v WHERE width > $WIDTH) GROUP BY word, run),
 j AS MATERIALIZED (SELECT a.word, a.i, least(length(a.word), greatest(a.i + 1, b.i)) AS n FROM (SELECT word, i, run FROM c UNION ALL SELECT word, 0, 0 FROM v) a ASOF JOIN e b ON a.word = b.word AND a.run + $WIDTH >= b.run),
 q(word, seq, i, n) AS (SELECT word, 0, i, n FROM j WHERE i = 0 UNION ALL SELECT q.word, q.seq + 1, j.i, j.n FROM q JOIN j ON q.word = j.word AND q.n = j.i AND j.i < length(j.word)),
 x AS (SELECT word, seq, substr(word, CAST(i + 1 AS BIGINT), CAST(n - i AS BIGINT)) AS part, (SELECT run FROM c WHERE c.word = q.word AND c.i = q.n) - coalesce((SELECT run FROM c WHERE c.word = q.word AND c.i = q.i), 0) AS width FROM q UNION ALL SELECT word, 0, word, width FROM v WHERE width <= $WIDTH),
 p AS (SELECT doc_id, block_no, row_number() OVER o - 1 AS i, part, k > 0 AND seq = 0 AS gap, width, sum(width + CASE WHEN k > 0 AND seq = 0 THEN $SPACE ELSE 0 END) OVER o AS y FROM w JOIN x USING (word) WINDOW o AS (PARTITION BY doc_id, block_no ORDER BY k, seq)),
 m AS MATERIALIZED (SELECT *, y - width AS x FROM p),
 s AS MATERIALIZED (SELECT a.doc_id, a.block_no, a.i, greatest(a.i, coalesce(b.i, a.i)) + 1 AS n FROM m a ASOF LEFT JOIN (SELECT doc_id, block_no, y, max(i) AS i FROM m GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.block_no = b.block_no AND a.x + $WIDTH >= b.y),
 r(doc_id, block_no, i, n, line_no) AS (SELECT doc_id, block_no, i, n, 0 FROM s WHERE i = 0 UNION ALL SELECT s.doc_id, s.block_no, s.i, s.n, line_no + 1 FROM r JOIN s ON r.doc_id = s.doc_id AND r.block_no = s.block_no AND r.n = s.i)
 SELECT m.doc_id, CAST(m.block_no AS INT) AS block_no, CAST(line_no AS INT) AS line_no, string_agg(CASE WHEN gap AND m.i > r.i THEN ' ' ELSE '' END || part, '' ORDER BY m.i) AS line FROM m ASOF JOIN r ON m.doc_id = r.doc_id AND m.block_no = r.block_no AND m.i >= r.i GROUP BY m.doc_id, m.block_no, line_no"""
SQL["break_lines"] = _BROKEN.replace("$ADVANCE", "1").replace("$WIDTH", "90").replace("$SPACE", "1")
SQL["break_lines_by_width"] = _BROKEN.replace("$ADVANCE", metric.sql_advance("c")).replace("$WIDTH", str(LINE_WIDTH)).replace("$SPACE", str(metric.SPACE))

_SIZE = "CASE WHEN block_no % 7 = 0 THEN [20000, 16000, 13500][block_no % 3 + 1] ELSE 11000 END"
#: Line by line: the page and the place after each; a heading asks for room before its first line.
SQL["paginate"] = f"""WITH RECURSIVE b AS (SELECT doc_id, block_no, CAST(ceil(length(line) / 90.0) AS INT) AS n, {_SIZE} AS size, block_no % 7 = 0 AS heading FROM ({_BLOCKS}) WHERE line <> ''),
 l AS MATERIALIZED (SELECT *, CAST(round(size * 1.35) AS BIGINT) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, line_no) AS k FROM (SELECT *, unnest(range(n)) AS line_no FROM b)),
 t AS MATERIALIZED (SELECT *, CASE WHEN heading AND line_no = 0 THEN CAST(round(size * 2.7) AS BIGINT) + 10000 END AS room, CASE WHEN heading AND line_no = 0 THEN 10000 ELSE 0 END AS space, CASE WHEN line_no = n - 1 THEN CASE WHEN heading THEN 4000 ELSE 6000 END ELSE 0 END AS tail FROM l),
 r(doc_id, k, page, y, tail) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(785200 AS BIGINT), CAST(0 AS BIGINT) FROM t WHERE k = 1
  UNION ALL SELECT doc_id, k, page + CAST(late AS INT), CASE WHEN late THEN 785200 ELSE y END - h, tail FROM (SELECT *, y - h < 56690 AND y < 785200 AS late FROM (SELECT doc_id, k, page + CAST(early AS INT) AS page, CASE WHEN early THEN 785200 ELSE y END - space AS y, h, tail
   FROM (SELECT r.doc_id, t.k, r.page, r.y - r.tail AS y, t.h, t.space, t.tail, coalesce(r.y - r.tail - t.room < 56690 AND r.y - r.tail < 785200, false) AS early FROM r JOIN t ON t.doc_id = r.doc_id AND t.k = r.k + 1))))
 SELECT doc_id, CAST(block_no AS INT) AS block_no, CAST(line_no AS INT) AS line_no, CAST(page AS INT) AS page, y / 1000 AS y FROM r JOIN t USING (doc_id, k)"""
