"""Resolution of overlapping candidates, manual masks and the overlay of a review."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def span_id(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", kind, start.cast("string"), end.cast("string"))


def greedy(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Longest first, then priority, then start; kept if it overlaps nothing kept (touching is no overlap).

    A sweep over each document's candidates in that order.  What is kept is disjoint, so its starts and ends are sorted
    alike, and the one kept span that a candidate could meet is found by bisection.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, starts, ends, first = None, [], [], True
        for b in batches:
            keep = []
            for key, s, e in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (id_col, "start", "end"))):
                if first or key != doc:
                    doc, starts, ends, first = key, [], [], False
                at = bisect_right(ends, s)
                free = at == len(starts) or starts[at] >= e
                keep.append(free)
                if free:
                    starts.insert(at, s)
                    ends.insert(at, e)
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = candidates.select(id_col, "type", "start", "end", "value", "priority", "source").repartition(id_col)
    rows = rows.sortWithinPartitions(id_col, F.desc(F.col("end") - F.col("start")), F.desc("priority"), "start", "source", "end", "type", "value")
    out = rows.mapInArrow(sweep, rows.schema).drop("priority", "source")
    return out.withColumn("id", span_id(F.col("type"), F.col("start"), F.col("end")))


def _islands(rows: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """rows with `island`: a new one where the start is not before the end of all earlier rows."""
    w = W.partitionBy(id_col).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merge(candidates: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """R2: overlapping candidates become one span over all of them, with the type of the strongest: the longest,
    then the highest priority, then the first."""
    rows = _islands(candidates, id_col, [F.col("start"), F.col("end").desc(), F.col("source"), F.col("priority")])
    best = F.max_by("type", F.struct(F.col("end") - F.col("start"), F.col("priority"), -F.col("start"), -F.col("source")))
    spans = rows.groupBy(id_col, "island").agg(best.alias("type"), F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    spans = spans.join(docs.select(id_col, F.col(text).alias("_text")), id_col)
    out = spans.withColumn("value", F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_text")
    return out.withColumn("id", span_id(F.col("type"), F.col("start"), F.col("end")))


def add_manual(detections: DataFrame, masks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The masks of a document (from, to in either order; empty ones are ignored) take in what they overlap, other
    masks as well.

    detections are disjoint, so what a mask takes in never reaches further ones and the order of masks does not matter:
    an island of overlapping spans with a mask is one mask, and any other island is one detection.
    """
    own = [F.col(id_col), F.col("type"), F.col("start"), F.col("end"), F.col("value")]
    m = masks.select(id_col, F.lit("MASQUE").alias("type"), F.least("from", "to").alias("start"), F.greatest("from", "to").alias("end"), F.lit(None).cast("string").alias("value")).filter("start < end")
    rows = detections.select(*own, F.lit(False).alias("_mask")).unionByName(m.select("*", F.lit(True).alias("_mask")))
    rows = _islands(rows, id_col, [F.col("start"), F.col("end").desc(), F.col("_mask"), F.col("type")])
    spans = rows.groupBy(id_col, "island").agg(F.bool_or("_mask").alias("_mask"), F.max("type").alias("_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("value").alias("_value"))
    spans = spans.join(docs.select(id_col, F.col(text).alias("_t"), F.lit(True).alias("_known")), id_col, "left").filter("not _mask or _known")
    value = F.when(F.col("_mask"), F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("_value"))
    out = spans.select(id_col, F.when(F.col("_mask"), "MASQUE").otherwise(F.col("_type")).alias("type"), "start", "end", value.alias("value"))
    return out.withColumn("id", span_id(F.col("type"), F.col("start"), F.col("end")))


def active(detections: DataFrame, disabled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Without those that the reader has switched off."""
    return detections.join(disabled.select(id_col, "id"), [id_col, "id"], "left_anti")


def segments(detections: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain and marked pieces of each text in order; a span that begins inside an earlier one is passed over."""
    w = W.partitionBy(id_col).orderBy("start", F.col("end").desc())
    ahead = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    shown = detections.withColumn("_before", F.coalesce(ahead, F.lit(0))).filter("start >= _before")
    marked = shown.select(id_col, "start", "end", "type")
    gaps = shown.select(id_col, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("start"), F.col("start").alias("end"))
    last = docs.select(id_col, F.length(text).alias("_n")).join(shown.groupBy(id_col).agg(F.max("end").alias("_e")), id_col, "left").select(id_col, F.coalesce("_e", F.lit(0)).alias("start"), F.col("_n").alias("end"))
    plain = gaps.unionByName(last).filter("start < end").withColumn("type", F.lit(None).cast("string"))
    out = marked.unionByName(plain).join(docs.select(id_col, F.col(text).alias("_t")), id_col)
    return out.withColumn("piece", F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_t")
