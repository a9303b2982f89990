"""Matches of a pattern with their places, without a UDF.

Spark has no function for the offsets of all matches.  Each match is put between two marks, in one pass of the
pattern, and the text split at them, so that gaps and matches alternate; their running length gives the offsets
(code points, half-open).  Where a text has the mark itself, matches and gaps come from two passes instead.
The pattern must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: A code point for private use.
MARK = "\uf8fd"


def pieces(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn, beginning and ending with a gap."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.when(hit.isNull(), F.array(gap)).otherwise(F.array(gap, hit))))
    return F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)


def spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start,end,value>>."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("value")))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def walk(all_pieces: Column) -> Column:
        none = F.array().cast(SPAN)
        return F.when(F.size(all_pieces) > 1, F.aggregate(all_pieces, begin, step)["out"]).otherwise(none)

    # bound by a one-element array, so that the pattern runs once
    return F.get(F.transform(F.array(pieces(text, pattern)), walk), F.lit(0))


def span_rows(docs: DataFrame, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, pos, start, end, value, gap (the text since the previous match): for texts with thousands of matches,
    where offsets come from a running sum over the rows of a document."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("gap"))
    rows = docs.select(id_col, F.posexplode(pairs).alias("pos", "m")).filter("m.value is not null").select(id_col, "pos", "m.value", "m.gap")
    w = W.partitionBy(id_col).orderBy("pos")
    end = F.sum(F.length("gap") + F.length("value")).over(w).cast("int")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
