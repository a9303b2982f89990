"""Mixing sources to target weights by entropy balancing.

The rates r solve  min sum_i size_i (r_i log r_i - r_i)  subject to one token constraint per source,
sum_{i in s} size_i r_i = target_s.  The dual is convex and separates by source: r_i = exp(lambda_s), where
lambda_s is found by damped Newton steps whose gradient and curvature are sums over all documents.  Rates
are rounded into whole copies by systematic rounding along the documents of a source ordered by size, so
the words taken differ from the target by about one document.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; an
empty table gives an empty result; repeated rows each count; documents of one source with equal size and
id are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Parts into which equal (source, size) groups are dealt.
SALTS = 64


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `_rank` from 0, by code point and null last, without bringing all of them into one task."""
    parts = partitions(sources.sparkSession)
    s = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    s = stored(s.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() % F.lit(1 << 33)))
    before = s.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    return s.join(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before")), "_part").withColumn("_rank", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes: key, source, source_size.  Adds target: shares by weight, water-filled under cap * source_size."""
    s = stored(_ranked(sizes).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))))
    total, level = s.agg(F.sum("source_size")).first()[0] or 0, None
    capped = -1
    while True:
        full = F.lit(False) if level is None else F.col("_w") * level > cap * F.col("source_size")
        held, weight, n = s.agg(F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))), F.count_if(full)).first()
        if n == capped or not weight:
            break
        level, capped = (total - held) / weight, n
    target = F.least(F.col("_w") * F.lit(level or 0.0), cap * F.col("source_size"))
    return s.select("key", "source", "source_size", target.alias("target"))


def solve(hist: DataFrame, goal: DataFrame, cap: float = CAP, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Newton on the dual.  hist: key, size, n of all documents; goal: key, target.  Gives key, lam."""
    state = stored(goal.select("key", "target", F.lit(0.0).alias("lam")))
    for _ in range(rounds):
        rate = F.least(F.exp("lam"), F.lit(cap))
        mass = hist.join(state.select("key", "lam"), "key").groupBy("key").agg(F.sum(F.col("n") * F.col("size") * rate).alias("_g"))
        step = F.when(F.col("_g") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - F.col("_g")) / F.col("_g")))).otherwise(0.0)
        state = stored(state.join(mass, "key", "left").select("key", "target", (F.col("lam") + step).alias("lam"), F.abs(step).alias("_step")))
        if (state.agg(F.max("_step")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("_step")
    return state.select("key", "lam")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, rate, copies, and the columns of keep; one row per row of docs."""
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(SALTS)).alias("salt"), *keep)
    base = stored(base.withColumn("key", key))
    hist = base.groupBy("key", "source", "size", "salt").agg(F.count("*").alias("n"))
    hist = stored(hist)
    by_size = stored(hist.groupBy("key", "source", "size").agg(F.sum("n").alias("n")))
    goal = stored(targets(by_size.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap))
    lam = solve(by_size, goal, cap)
    plan = goal.join(lam, "key").withColumn("rate", F.least(F.exp("lam"), F.lit(cap)))
    plan = plan.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-8, F.round("rate")).otherwise(F.col("rate")))
    past = (W.unboundedPreceding, -1)
    smaller = by_size.select("key", "size", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("size").rowsBetween(*past)), F.lit(0)).alias("_smaller"))
    salted = hist.select("key", "size", "salt", F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("salt").rowsBetween(*past)), F.lit(0)).alias("_salted"))
    ahead = salted.join(smaller, ["key", "size"]).join(plan.select("key", "source_size", "target", "rate"), "key")
    out = base.withColumn("_row", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("doc_id", *keep))).join(ahead, ["key", "size", "salt"])
    at, whole = F.col("_smaller") + F.col("_salted") + F.col("_row"), F.floor("rate")
    part = F.col("rate") - whole
    copies = whole + F.floor(at * part + 0.5) - F.floor((at - 1) * part + 0.5)
    out = out.withColumn("copies", F.least(copies, F.lit(int(cap))).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies", *keep)
