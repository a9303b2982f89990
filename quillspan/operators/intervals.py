"""Joins of intervals by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a bucket.
BUCKET = 1024


def overlapping(left: DataFrame, right: DataFrame, key: str, l0: str, l1: str, r0: str, r1: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs of equal key whose half-open intervals [l0, l1) and [r0, r1) overlap; an empty interval overlaps what it lies
    strictly inside of.  Other columns of the two sides must have different names.

    Both sides stand in every bucket of positions that they reach, and meet by (key, bucket): a row for each bucket
    instead of all pairs of a key, and a long document is spread over many tasks.  A pair is kept in the bucket in
    which the later of the two begins, so it comes once.
    """
    at = lambda c: F.floor(F.col(c) / bucket).cast("long")
    reached = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), F.floor((F.col(b) - 1) / bucket).cast("long"))))
    pairs = left.withColumn("_bucket", reached(l0, l1)).join(right.withColumn("_bucket", reached(r0, r1)), [key, "_bucket"])
    meet = (F.col(l0) < F.col(r1)) & (F.col(r0) < F.col(l1))
    return pairs.filter(meet & (F.col("_bucket") == F.greatest(at(l0), at(r0)))).drop("_bucket")
