"""Labels and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import label_key

from .resolve import _islands


def plan(detections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """L1: id, start, end, label.  Labels are numbered per type by first appearance; equal values share one; a
    span that begins inside the one before is taken in by it."""
    rows = _islands(detections, id_col, [F.col("start"), F.col("end").desc()])
    first = F.struct("start", -F.col("end"))
    spans = rows.groupBy(id_col, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("type", first).alias("type"), F.min_by("value", first).alias("value"))
    spans = spans.withColumn("key", label_key(F.col("type"), F.col("value")))
    spans = spans.withColumn("seen", F.min("start").over(W.partitionBy(id_col, "type", "key")))
    number = F.dense_rank().over(W.partitionBy(id_col, "type").orderBy("seen"))
    return spans.select(id_col, "start", "end", F.format_string("[%s_%d]", "type", number).alias("label"))


def apply(docs: DataFrame, replacements: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """L2: docs with `redacted`; documents without replacements keep their text."""
    spans = replacements.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("_plan"))
    both = docs.join(spans, id_col, "left")
    before = F.concat(F.array(F.lit(0)), F.transform("_plan", lambda r: r["end"]))
    parts = F.transform("_plan", lambda r, i: F.concat(F.substr(text, F.get(before, i) + 1, r["start"] - F.get(before, i)), r["label"]))
    tail = F.substr(text, F.element_at(before, -1) + 1)
    return both.withColumn("redacted", F.when(F.col("_plan").isNull(), F.col(text)).otherwise(F.concat(F.array_join(parts, ""), tail))).drop("_plan")


def leaks(redacted: DataFrame, detections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """L3: detected values that the redacted text still shows."""
    return detections.join(redacted.select(id_col, "redacted"), id_col).filter(F.instr(F.col("redacted"), F.col("value")) > 0)
