"""Benchmark decontamination over a distributed positional inverted index.

The index is a table in the shared folder.  Documents are packed into shards (some MB of text); for each shard
and each bucket of terms (an equal range of their 64-bit hashes) it has a row with the terms there, how often
each stands in the shard, and the ascending positions of each.  A further row of a shard has its documents and
where their words begin.

The benchmark is tokenised by tasks, into windows that are sequences of terms.  Its terms are joined to the
index by bucket, which leaves their postings; with the terms' totals each window knows its rarest term, and is
sent to the shards that have it, and to no other.  There its lists of positions are intersected, adjusted by
their offsets in the window, from the shard's rarest term on, and what crosses from one document to the next
is left out.  Nothing is collected or broadcast by hand.

Defined results: null or wordless text has no words, no hits and is clean; wordless items have no windows;
a null item_id takes part in hits but is not listed (SQL's sort of ids has no null); repeated rows each
get their row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, bucket_cuts, from_planes, pack_sorted, partitions, planes, slices, stored, tidy, unpack_sorted, utf8, word_hashes, word_spans

WINDOW = 13


def _pack(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return pack_sorted(terms), planes(counts.astype(np.uint32)), planes(np.diff(positions.astype(np.uint32), prepend=np.uint32(0)))


def _unpack(terms: bytes, counts: bytes, positions: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack_sorted(terms), from_planes(counts, "u4").astype(np.int64), np.cumsum(from_planes(positions, "u4"), dtype=np.uint32)


def taken(counts: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Where the postings of some terms stand, one list after the other."""
    n = counts[pick]
    return np.repeat(np.cumsum(counts)[pick] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())


def build(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The stored index of whole texts; the columns of keep stay with each document."""
    parts = partitions(docs.sparkSession)
    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names = ["shard", "bucket", "terms", "counts", "positions", "words", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for no, t in enumerate(slices(batches, "_text")):
            starts, ends, words = word_spans(*(both := utf8(t["_text"])), ALNUM_WORD)
            h = word_hashes(both[0], starts, ends, True)
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            terms, stop = h[first], np.append(first, len(h))
            cut = bucket_cuts(terms, parts)
            full = np.flatnonzero(np.diff(cut))
            blobs = [_pack(terms[cut[b] : cut[b + 1]], np.diff(stop[cut[b] : cut[b + 1] + 1]), order[stop[cut[b]] : stop[cut[b + 1]]]) for b in full]
            rows = pa.StructArray.from_arrays([t[c].combine_chunks() for c in keep], keep)
            rows = pa.StructArray.from_arrays([rows, pa.array(np.diff(words))], ["kept", "n_words"])
            of_docs = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), rows)
            none = pa.nulls(len(full), pa.binary())
            cols = [pa.array([f"{part}-{no}"] * len(full), pa.string()), pa.array(full.astype(np.int32)), *(pa.array([x[i] for x in blobs], pa.binary()) for i in range(3)), none, pa.nulls(len(full), of_docs.type)]
            yield pa.RecordBatch.from_arrays(cols, names)
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{no}"]), pa.array([-1], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([planes(words.astype(np.int64))], pa.binary()), of_docs], names)
        tidy()

    schema = f"shard string, bucket int, terms binary, counts binary, positions binary, words binary, docs array<struct<kept: struct<{kept}>, n_words: bigint>>"
    return stored(docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema))


def windows_of(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """window (its terms' hashes, as bytes), items: each distinct window and the items that have it."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, "text"):
            data, offsets = utf8(t["text"])
            starts, ends, words = word_spans(data, offsets, ALNUM_WORD)
            h = word_hashes(data, starts, ends, True)
            at, out = [], []
            for i, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist())):
                if a < b:
                    found = np.unique(np.lib.stride_tricks.sliding_window_view(h[a:b], min(window, b - a)), axis=0)
                    at += [i] * len(found)
                    out += [w.tobytes() for w in found]
            yield pa.RecordBatch.from_arrays([t["item"].combine_chunks().take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], ["item", "window"])

    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, window binary")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def _each_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """window: the distinct terms of each."""
    for b in batches:
        terms = [np.unique(np.frombuffer(w, np.uint64)) for w in b.column(0).to_pylist()]
        if terms:
            of = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(np.concatenate(terms).view(np.int64))], ["window", "term"])


def _postings(index: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """asked: term.  shard, terms, counts, positions: what the index has of these terms."""
    width = (1 << 64) // parts + 1

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([b * width for b in range(1, parts)], np.uint64)
        for b in batches:
            term = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(edges, term.view(np.uint64), "right").astype(np.int32))], ["term", "bucket"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                terms, counts, positions = _unpack(*(b.column(c)[i].as_py() for c in (1, 2, 3)))
                want = np.sort(b.column(4)[i].values.to_numpy().view(np.uint64))
                at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
                at = at[terms[at] == want]
                if len(at):
                    out.append((b.column(0)[i].as_py(), *_pack(terms[at], counts[at], positions[taken(counts, at)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), *[pa.binary()] * 3))], ["shard", "terms", "counts", "positions"])
        tidy()

    lists = asked.mapInArrow(bucket, "term long, bucket int").groupBy("bucket").agg(F.collect_set("term").alias("want"))
    both = index.filter("bucket >= 0").join(lists, "bucket").select("shard", "terms", "counts", "positions", "want")
    return stored(both.mapInArrow(pick, "shard string, terms binary, counts binary, positions binary"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, term, n for every list of postings."""
    for b in batches:
        for i in range(b.num_rows):
            terms, n = unpack_sorted(b.column(1)[i].as_py()), from_planes(b.column(2)[i].as_py(), "u4")
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(terms), pa.string()), pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["shard", "term", "n"])


class Shard:
    """The chosen postings of one shard, and where its documents' words begin."""

    def __init__(self, table: pa.Table) -> None:
        self.words = np.zeros(1, np.int64)
        parts = []
        for words, *blobs in zip(*(table[c].to_pylist() for c in ("words", "terms", "counts", "positions"))):
            if words is not None:
                self.words = from_planes(words, "i8")
            else:
                parts.append(_unpack(*blobs))
        parts.sort(key=lambda p: int(p[0][0]))
        self.terms, counts, positions = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        self.positions, self.first = positions.astype(np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def lists(self, terms: np.ndarray) -> list[np.ndarray] | None:
        """The positions of each term; none if one does not stand here."""
        if not len(self.terms):
            return None
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        if (self.terms[at] != terms).any():
            return None
        return [self.positions[self.first[i] : self.first[i + 1]] for i in at.tolist()]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, at, "right") - 1

    def phrase(self, lists: list[np.ndarray]) -> np.ndarray:
        """Where the phrase begins whose j-th term stands at lists[j], from the rarest terms on, within one document."""
        order = np.argsort([len(x) for x in lists], kind="stable").tolist()
        at = lists[order[0]] - order[0]
        at = at[at >= 0]
        for j in order[1:]:
            if not len(at):
                return at
            other, want = lists[j], at + j
            i = np.minimum(np.searchsorted(other, want), len(other) - 1)
            at = at[other[i] == want]
        return at[at + len(lists) <= self.words[self.document(at) + 1]] if len(at) else at

    def near(self, lists: list[np.ndarray], slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within `slop` words of the same document."""
        order = np.argsort([len(x) for x in lists], kind="stable").tolist()
        at = lists[order[0]]
        for j in order[1:]:
            d = self.document(at)
            low, high = np.maximum(at - slop, self.words[d]), np.minimum(at + slop, self.words[d + 1] - 1)
            at = at[np.searchsorted(lists[j], high, "right") > np.searchsorted(lists[j], low)]
        return at


def search(index: DataFrame, windows: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """fn(shard, rows of windows) for every shard and the windows (window, ...) whose rarest term stands there."""
    parts = partitions(index.sparkSession)
    terms = windows.select("window").mapInArrow(_each_term, "window binary, term long")
    chosen = _postings(index, terms.select("term").distinct(), parts)
    places = chosen.mapInArrow(_places, "shard string, term long, n long")
    totals = places.groupBy("term").agg(F.sum("n").alias("n"))
    rarest = terms.join(totals, "term", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"))
    rarest = rarest.filter("r.n > 0").select("window", F.col("r.term").alias("term"))
    sent = windows.join(rarest, "window").join(places.select("shard", "term"), "term").drop("term")
    postings = chosen.withColumn("words", F.lit(None).cast("binary"))
    heads = index.filter("bucket = -1").select("shard", *(F.lit(None).cast("binary").alias(c) for c in ("terms", "counts", "positions")), "words")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(Shard(left), right)
        tidy()
        return out

    return postings.unionByName(heads).groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, n_words, n_hit, n_items, items_sha256, contaminated, hits (numbers of the words hit), items."""
    index = build(docs, list(keep), text)
    windows = stored(windows_of(benchmark, window))
    kind = windows.schema["items"].dataType.simpleString()

    def match(shard: Shard, asked: pa.Table) -> pa.Table:
        n = int(shard.words[-1])
        edge, items = np.zeros(n + 1, np.int64), {}
        for w, own in zip(asked["window"].to_pylist() if asked.num_rows else [], asked["items"].to_pylist() if asked.num_rows else []):
            lists = shard.lists(np.frombuffer(w, np.uint64))
            at = shard.phrase(lists) if lists else []
            if len(at):
                edge[at] += 1
                edge[at + len(lists)] -= 1
                for d in np.unique(shard.document(at)).tolist():
                    items.setdefault(d, set()).update(own)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        which = sorted(items)
        cut = [0, *(int(x) for x in np.searchsorted(hit, shard.words[np.array(which, np.int64) + 1]))]
        local = hit - shard.words[shard.document(hit)] if len(hit) else hit
        name = asked["shard"][0].as_py() if asked.num_rows else None
        of = [list(items[d]) for d in which]
        return pa.table({"shard": pa.array([name] * len(which), pa.string()), "d": pa.array(which, pa.int32()), "hits": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(local.astype(np.int64))), "items": pa.array(of, asked.schema.field("items").type)})

    found = search(index, windows, match, f"shard string, d int, hits array<bigint>, items {kind}")
    rows = index.filter("bucket = -1").select("shard", F.posexplode("docs").alias("d", "doc")).select("shard", "d", "doc.kept.*", "doc.n_words")
    hits, items = F.coalesce("hits", F.array().cast("array<bigint>")), F.coalesce("items", F.array().cast(kind))
    out = rows.join(found, ["shard", "d"], "left").select(*(f"`{c}`" for c in keep), "n_words", hits.alias("hits"), F.array_sort(items).alias("items"))
    n_hit = F.size("hits").cast("long")
    texts = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(texts, 256), "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words"))})


def phrase_matches(docs: DataFrame, phrases: list[str], slop: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, phrase_no, word: exact occurrences of each phrase, or with slop, places of its rarest term with all others near."""
    index = build(docs, [doc_id], text)
    asked = docs.sparkSession.createDataFrame(list(enumerate(phrases)), "item_id int, text string")
    windows = stored(windows_of(asked, 1 << 30))

    def match(shard: Shard, right: pa.Table) -> pa.Table:
        out = []
        for i in range(right.num_rows):
            lists = shard.lists(np.frombuffer(right["window"][i].as_py(), np.uint64))
            if lists:
                at = shard.phrase(lists) if slop is None else shard.near(lists, slop)
                d = shard.document(at)
                out += [(right["shard"][i].as_py(), *x, no) for x in zip(d.tolist(), (at - shard.words[d]).tolist()) for no in right["items"][i].as_py()]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], ["shard", "d", "word", "phrase_no"])

    found = search(index, windows, match, "shard string, d int, word long, phrase_no long")
    rows = index.filter("bucket = -1").select("shard", F.posexplode("docs").alias("d", "doc")).select("shard", "d", F.col(f"doc.kept.`{doc_id}`").alias("doc_id"))
    return found.join(rows, ["shard", "d"]).select("doc_id", "phrase_no", "word")
