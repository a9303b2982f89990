"""Queries of threads of messages; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources import scratch
from quillspan.streaming import threads

from .detection import candidates_sql, merged_sql, plan_sql
from .sources import MESSAGES

QUERIES: dict = {}
SQL: dict[str, str] = {}

_DOCS = f"SELECT seq AS doc_id, text FROM ({MESSAGES})"
#: Spans of every message with the thread in the place of the document, numbered over it.
_SPANS = f"SELECT m.thread AS doc_id, m.seq * 100000 + d.s AS s, m.seq, d.s AS s0, d.e AS e, d.type, d.v, d.text FROM ({merged_sql(candidates_sql(_DOCS), _DOCS)}) d JOIN ({MESSAGES}) m ON m.seq = d.doc_id"
_LABELS = plan_sql(_SPANS).replace("SELECT doc_id, s, e,", "SELECT seq, s0, e,", 1)
_REDACTED = f"""WITH p AS ({_LABELS}), w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY seq ORDER BY s0), 0) AS b FROM p),
 j AS (SELECT seq, string_agg(substr(text, b + 1, s0 - b) || label, '' ORDER BY s0) AS head, string_agg(label, ' ' ORDER BY s0) AS labels, max(e) AS e FROM w GROUP BY seq)
 SELECT t.thread, t.seq, coalesce(j.head, '') || substr(t.text, coalesce(j.e, 0) + 1) AS redacted, coalesce(j.labels, '') AS labels FROM ({MESSAGES}) t LEFT JOIN j USING (seq)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by order, so that a small or badly cut file keeps all cores busy."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate").repartition(parts, "o_orderkey").createOrReplaceTempView("orders")
    return spark.sql(MESSAGES)


def _shown(out: DataFrame) -> DataFrame:
    return out.withColumn("labels", F.array_join("labels", " "))


def redact_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's messages, with labels that stay the same through all of them."""
    return _shown(threads.redact_threads(_messages(spark, sf_dir)))


def redact_threads_stream(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """The same as a stream that comes in three parts, earlier messages first, each read by a query of its own that takes
    up the state of the one before."""
    messages = _messages(spark, sf_dir)
    low, high = messages.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return _shown(threads.redact_threads(messages))
    base = scratch.folder(spark)
    inbox = f"{base}/inbox"
    step = (high - low) // parts + 1
    for part in range(parts):
        messages.filter(F.floor((F.col("seq") - low) / step) == part).write.mode("append").parquet(inbox)
        threads.redact_stream(spark.readStream.schema(messages.schema).parquet(inbox), f"{base}/out", f"{base}/state")
    return _shown(spark.read.parquet(f"{base}/out"))


for _name, _run in (("redact_threads", redact_threads), ("redact_threads_stream", redact_threads_stream)):
    QUERIES[_name] = _run
    SQL[_name] = _REDACTED
