"""Divergence between the sources of each language, by Gustavson's row accumulation.

The groups of a language (its sources) and its kept terms form a sparse matrix of counts.  Its term-major
index has a row for each term: the groups that use it.  Each group, a row, goes through its terms, and for each
adds what the term's row holds into a dense accumulator with one entry for each peer, so that pairs of postings
are summed where they meet and never emitted.

A count of zero is no zero here: every kept term has a smoothed share p of each group, z where the group
lacks it.  With all terms absent, two groups differ by V * |z - z'|; the accumulator starts from there, each
group's own terms correct it by |p - z'| - |z - z'|, and terms that both have by what is then still wrong.

The index is dealt by blocks of terms, so a language, a common term or a large source is spread over tasks; a
block's result has at most about as many entries as the block has postings, and is summed over blocks.  Where a
language has very many sources, a block is answered for a range of rows at a time.

Null text, language or source count as empty text; empty tables give no rows; repeated documents and ids count as
often as they come; extra columns are not read.  Groups without terms, and languages without kept terms, take
part with the baseline alone.  All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Documents that a kept term stands in; ranks of terms that are reported.
LEAST, TOP = 30, 50
#: Distinct terms and groups that a task holds before it hands them on.
HELD = 400_000
#: Postings of a block at least, and entries of a dense accumulator at most.
BLOCK, DENSE = 1 << 15, 1 << 23
#: Groups up to which their figures are broadcast (about 100 bytes each).
FEW_GROUPS = 100_000

#: ASCII letters, lower-cased, and everything beyond ASCII stay; the rest ends a term.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); a row with an empty term for every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
        documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for (la, so), found in occurrences.items():
                terms, df = list(found), documents[la, so]
                for lo in range(0, len(terms), 1 << 16):
                    part = terms[lo : lo + (1 << 16)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([la] * n, pa.string()), pa.array([so] * n, pa.string()), pa.array([t.decode() for t in part], pa.string()), pa.array([found[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "df"])
            occurrences.clear()
            documents.clear()

        for b in batches:
            for la, so, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = (x.as_py() or "").encode().translate(_TERM_BYTES).split()
                found = occurrences[la, so]
                found[b""] += 0
                found.update(words)
                documents[la, so].update(set(words))
            if sum(map(len, occurrences.values())) > HELD:
                yield from emit()
        yield from emit()

    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def term_index(docs: DataFrame, least: int = LEAST, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The term-major index: lang, term, lang_n, postings (source, n) of each kept term; the empty term lists all sources."""
    terms = _counts(docs, lang, source, text).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.filter((F.col("df") >= least) | (F.col("term") == "")).drop("df")


def _share(count: str, total: str, terms: str):  # noqa: ANN202
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), in integers."""
    return F.expr(f"1 + (cast({count} as decimal(19,0)) + 5) * 1000000000 div (cast({total} as decimal(19,0)) + 5 * cast({terms} as decimal(19,0)))")


def groups_of(index: DataFrame) -> DataFrame:
    """lang, source, no (among the language's sources), peers, terms (kept), z (share of a count of 0), n (sum of counts), lang_total, lang_postings."""
    kept = index.filter("term <> ''")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum(F.size("postings")).alias("lang_postings"))
    sums = kept.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("n"))
    names = index.filter("term = ''").select("lang", F.array_sort(F.col("postings.source")).alias("names"))
    rows = names.select("lang", F.size("names").alias("peers"), F.posexplode("names").alias("no", "source"))
    rows = rows.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "lang_postings", "n"])
    return rows.withColumn("z", F.when(F.col("terms") > 0, _share("0", "n", "terms")).otherwise(F.lit(0).cast("long")))


def _absolute_sums(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each of z, the sum of |p - z|."""
    p = np.sort(p)
    run = np.concatenate([[0], np.cumsum(p)])
    at = np.searchsorted(p, z)
    return z * at - run[at] + (run[-1] - run[at]) - z * (len(p) - at)


def accumulate(term: np.ndarray, peer: np.ndarray, p: np.ndarray, z: np.ndarray, rows: range) -> tuple[np.ndarray, np.ndarray]:
    """What one block of terms adds to the baseline of each (row, peer), by the row's own terms and by terms of both.

    term, peer, p: the block's postings in any order.  The second result counts each pair of groups from both rows.
    """
    order = np.argsort(term, kind="stable")
    term, peer, p = term[order], peer[order], p[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(term)))
    of = np.repeat(np.arange(len(first)), length)
    by_row = np.argsort(peer, kind="stable")
    edges = np.searchsorted(peer[by_row], np.arange(rows.start, rows.stop + 1))
    own, both = np.zeros((len(rows), len(z)), np.int64), np.zeros((len(rows), len(z)), np.int64)
    for i, row in enumerate(rows):
        mine = by_row[edges[i] : edges[i + 1]]
        if not len(mine):
            continue
        gap = np.abs(z[row] - z)
        own[i] = _absolute_sums(p[mine], z) - len(mine) * gap
        n = length[of[mine]]
        at = np.repeat(first[of[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b, other = np.repeat(p[mine], n), p[at], peer[at]
        add = np.abs(a - b) - np.abs(a - z[other]) - np.abs(z[row] - b) + gap[other]
        # a share is at most 10^9 + 1 and those of a group sum up to that and its terms, so float64 sums are exact here
        both[i] = np.rint(np.bincount(other, add, len(z))).astype(np.int64)
    return own, both


def _pairs(index: DataFrame, groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b (numbers of groups, a < b), value."""
    square = F.col("peers").cast("long") * F.col("peers")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("lang_postings") / F.greatest(F.lit(BLOCK), square))).cast("int")
    span = F.greatest(F.lit(1), F.floor(F.lit(DENSE) / F.col("peers"))).cast("int")
    ranges = F.ceil(F.col("peers") / span).cast("int")
    sizes = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("no", "z"))).alias("g"), F.first("peers").alias("peers"), F.first("terms").alias("terms"), F.first("lang_postings").alias("lang_postings"))
    heads = sizes.select("lang", F.col("g.z").alias("z"), "terms", span.alias("span"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), ranges.alias("ranges"))
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))).drop("ranges")
    cells = postings.select("lang", F.pmod(F.xxhash64("term"), blocks.cast("long")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), ranges - 1)).alias("part"), "term", "no", "p")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            raise ValueError("postings of a language without groups")
        lang, block, part, span = (right[c][0].as_py() for c in ("lang", "block", "part", "span"))
        z = right["z"][0].values.to_numpy()
        rows = range(part * span, min(len(z), (part + 1) * span))
        term = left["term"].combine_chunks().dictionary_encode().indices.to_numpy() if left.num_rows else np.zeros(0, np.int64)
        own, both = accumulate(term, left["no"].to_numpy().astype(np.int64), left["p"].to_numpy(), z, rows)
        number, peers = np.arange(rows.start, rows.stop)[:, None], np.arange(len(z))[None, :]
        value = own + np.where(peers > number, both, 0)
        if block == 0:
            value += np.where(peers > number, right["terms"][0].as_py() * np.abs(z[number] - z[peers]), 0)
        if len(rows) == len(z):
            # all rows are here: one entry for each pair
            value, keep = np.triu(value) + np.tril(value, -1).T, peers > number
        else:
            keep = peers != number
        a, b = np.broadcast_to(number, value.shape)[keep], np.broadcast_to(peers, value.shape)[keep]
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": np.minimum(a, b).astype(np.int32), "b": np.maximum(a, b).astype(np.int32), "value": value[keep]})

    keys = ("lang", "block", "part")
    found = cells.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(run, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank: what sets each group apart from its peers and its language."""
    index = stored(term_index(docs, least, lang, source, text))
    groups = stored(groups_of(index))
    hint = F.broadcast if groups.count() <= FEW_GROUPS else lambda df: df
    lists = index.filter("term <> ''").select("lang", "term", "lang_n", F.explode("postings").alias("p")).select("lang", "term", "lang_n", "p.source", F.col("p.n").alias("count"))
    postings = lists.join(hint(groups), ["lang", "source"]).withColumn("p", _share("count", "n", "terms"))

    pairs = _pairs(index, groups, postings)
    ends = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("peer")), F.struct(F.col("b").alias("no"), F.col("a").alias("peer")))).alias("e"), "value").select("lang", "e.no", "e.peer", "value")
    name = groups.select("lang", "no", "source")
    named = ends.join(hint(name), ["lang", "no"]).join(hint(name.select("lang", F.col("no").alias("peer"), F.col("source").alias("item"))), ["lang", "peer"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    over = postings.withColumn("value", F.col("p") - _share("lang_n", "lang_total", "terms")).filter("count > 0 and value > 0")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")).alias("rank"))
    return named.unionByName(over.filter(F.col("rank") <= top))
