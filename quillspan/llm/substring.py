"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the whole collection, indexed by runs of `window` words: each index block (an equal range
of the 64-bit hash space) keeps the earliest place, by doc_id and then word, of every run that can occur in
two documents.  Every document is factored greedily, left to right, against all blocks: a factor goes on
while the next run's earliest place is the next word of the same reference document, so that the runs that
lie across the border between two factors are looked up by themselves and none is missed.  The words of each
factor with a smaller doc_id are then compared, in the chunk where the reference document lies, with the
words that it points to, by 128-bit digests of the text itself.  Hashes only propose: equal runs always have
equal hashes, so nothing is missed, and if any factor differs from its reference, all is done again with other hashes.

To keep the index small, a first exchange finds the runs that can occur twice at all: each run of 50 words
contains a least-hash run of 25 words (its minimizer), equal runs have equal minimizers, and only runs whose
minimizer stands in two documents go on.  This loses nothing, whatever the data are.

Defined results: null text has no words; documents of fewer words than a window lose nothing; rows with
equal ids do not remove each other's words; a null id counts as the largest and stays null; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Chunk, answers, bucket_rows, buckets, buckets_schema, chunked, dropped, each_answered, each_chunk, exchange, keys_of_documents, several_documents, sliding_min, stored, tidy, window_ok, windows, word_hashes, word_spans

WINDOW = 50
_CHECK = 0xA0761D6478BD642F
#: Factors that one task compares with one chunk of references.
COMPARED = 200_000
#: Other hashes that are tried before giving up.
TRIES = 4

WordHash = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def plain_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hashes(data, starts, ends, False)


def keyed_hash(seed: int) -> WordHash:
    """A digest of each word; slower, and only used after a factor differed from its reference."""

    def of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        return np.fromiter((int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=bytes([seed])).digest(), "little") for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))

    return of


def homes(c: Chunk) -> np.ndarray:
    """Where each document of a chunk lies: partition, chunk of it, and row, in 27, 16 and 20 bits."""
    part, no = map(int, c.name.split("-"))
    if part >= 1 << 27 or no >= 1 << 16 or len(c.ids) > 1 << 20:
        raise ValueError(f"chunk {c.name} of {len(c.ids)} documents is beyond the numbers of places")
    return np.arange(len(c.ids), dtype=np.int64) + ((part << 36) + (no << 20))


def word_digest(raw: bytes, start: int, end: int) -> bytes:
    """Of the words of a stretch of text, whatever separates them (split() parts words at the same bytes)."""
    return hashlib.blake2b(b" ".join(raw[start:end].split()), digest_size=16).digest()


class Runs:
    """Words of a chunk, the runs that lie in one document, and the minimizer of each."""

    def __init__(self, c: Chunk, window: int, word_hash: WordHash = plain_hash) -> None:
        self.starts, self.ends, self.words = word_spans(c.data, c.offsets)
        self.h = word_hash(c.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(c.ids)), np.diff(self.words))
        self.at = np.flatnonzero(window_ok(self.words, window))
        k = (window + 1) // 2
        least = sliding_min(windows(self.h, k), window - k + 1)
        self.minimizer = least[self.at]
        self.run_doc = self.doc[self.at]


def _candidates(c: Chunk, r: Runs, window: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of runs that may occur twice, their hashes, and the further bits."""
    keys, _ = keys_of_documents(r.minimizer, r.run_doc)
    at = r.at[flags[np.searchsorted(keys, r.minimizer)] > 0] if len(r.at) else r.at
    return at, windows(r.h, window)[at], (windows(r.h, window, _CHECK)[at] >> np.uint64(32)).astype(np.uint32)


def _earliest(c: Chunk, r: Runs, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of the candidates by hash, document and place; the first of each hash is the chunk's earliest."""
    return np.lexsort((at, c.order[r.doc[at]], h))


def factors(reference: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors over candidate runs: first index and number of runs of each.

    at: word of each run; reference, place: document (where it lies) and word of its earliest occurrence.  A factor takes in
    the next run while the text and the reference both move on by one word.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (reference[1:] != reference[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def deduplicate(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", word_hash: WordHash = plain_hash) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (word, n_words, reference doc_id, reference word)."""
    store = chunked(docs, doc_id, text)
    for seed in range(TRIES):
        found = _parsed(store, window, keyed_hash(seed) if seed else word_hash)
        if not _differing(store, found):
            dropped(store)
            plain = F.transform("factors", lambda f: F.struct(*(f[x].alias(x) for x in ("word", "n_words", "reference", "reference_word"))))
            return found.withColumn("factors", plain)
        dropped(found)
    raise RuntimeError("factors differ from their references under every hash")


def _differing(store: DataFrame, found: DataFrame) -> int:
    """How many distinct factors do not have the words of their reference.

    Equal questions are asked once; a chunk that is asked very often is dealt to several tasks.
    """
    f = found.select(F.explode("factors").alias("f")).select("f.home", "f.reference_word", "f.n_words", "f.digest").distinct()
    chunk = F.concat_ws("-", F.shiftright("home", 36).cast("string"), F.shiftright("home", 20).bitwiseAND(F.lit((1 << 16) - 1)).cast("string"))
    asked = stored(f.withColumn("chunk", chunk))
    tasks = asked.groupBy("chunk").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias("parts"))
    left = store.join(tasks, "chunk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = asked.join(tasks, "chunk").withColumn("part", F.pmod(F.xxhash64("home", "reference_word", "n_words"), F.col("parts")).cast("int")).drop("parts")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        bad = 0
        if right.num_rows:
            c = Chunk(left)
            starts, ends, words = word_spans(c.data, c.offsets)
            raw = c.data.tobytes()
            first = words[right["home"].to_numpy() & ((1 << 20) - 1)] + right["reference_word"].to_numpy()
            begin, end = starts[first], ends[first + right["n_words"].to_numpy() - 1]
            for a, b, want in zip(begin.tolist(), end.tolist(), right["digest"].to_pylist()):
                bad += word_digest(raw, a, b) != want
        tidy()
        return pa.table({"differing": pa.array([bad], pa.int64())})

    n = left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(compare, "differing long").agg(F.sum("differing")).first()[0]
    dropped(asked)
    return n or 0


def _parsed(store: DataFrame, window: int, word_hash: WordHash) -> DataFrame:
    """What deduplicate() returns, stored, with the place and the digest of each factor."""
    parts = buckets(store, CHUNK_BYTES)

    def minimizers(c: Chunk) -> Iterator[pa.RecordBatch]:
        r = Runs(c, window, word_hash)
        keys, multi = keys_of_documents(r.minimizer, r.run_doc)
        yield bucket_rows(c.name, keys, [multi], parts)

    def shared(inverse: np.ndarray, values: list[np.ndarray], chunk_no: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        return [several_documents(values[0], chunk_no, inverse, starts)[inverse].astype(np.uint8)]

    flags = stored(exchange(each_chunk(store, minimizers, buckets_schema(1)), parts, ["u1"], shared, 1))

    def candidates(c: Chunk, back: dict[str, pa.Table]) -> pa.Table:
        r = Runs(c, window, word_hash)
        at, h, check = _candidates(c, r, window, answers(back["flags"], 0, "u1"))
        order = _earliest(c, r, at, h)
        one = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])] if len(order) else order
        doc = r.doc[at[one]]
        b = bucket_rows(c.name, h[one], [check[one], c.order[doc], (at[one] - r.words[doc]).astype(np.uint32), homes(c)[doc]], parts)
        return pa.Table.from_batches([b])

    def earliest(inverse: np.ndarray, values: list[np.ndarray], chunk_no: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        check, doc, place, home = values
        order = np.lexsort((place, home, doc, check, inverse))
        new = np.ones(len(order), bool)
        new[1:] = (inverse[order][1:] != inverse[order][:-1]) | (check[order][1:] != check[order][:-1])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        out = [np.empty_like(x) for x in (doc, place, home)]
        for x, y in zip(out, (doc, place, home)):
            x[order] = y[first]
        return out

    sent = each_answered(store, {"flags": flags}, candidates, buckets_schema(4))
    index = stored(exchange(sent, parts, ["u4", "i8", "u4", "i8"], earliest, 3))

    def parse(c: Chunk, back: dict[str, pa.Table]) -> pa.Table:
        r = Runs(c, window, word_hash)
        at, h, _ = _candidates(c, r, window, answers(back["flags"], 0, "u1"))
        keys = np.unique(h)
        reference, place = answers(back["index"], 0, "i8"), answers(back["index"], 1, "u4")
        home = answers(back["index"], 2, "i8")
        which = np.searchsorted(keys, h)
        reference, place, home = reference[which], place[which].astype(np.int64), home[which]
        dup = reference < c.order[r.doc[at]]
        at, reference, place, home = at[dup], reference[dup], place[dup], home[dup]
        first, n = factors(home, place, at)
        # a factor's words are those from its first run's begin to its last run's end
        edge = np.zeros(len(r.h) + 1, np.int64)
        np.add.at(edge, at[first], 1)
        np.add.at(edge, at[first] + n + window - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        # kept words, one space between, for all documents of the chunk at once
        kept = np.flatnonzero(~gone)
        n_kept = np.diff(np.searchsorted(kept, r.words))
        last = np.zeros(len(kept), bool)
        last[np.cumsum(n_kept)[n_kept > 0] - 1] = True
        step = np.zeros(len(c.data) + 1, np.int8)
        step[r.starts[kept]] += 1
        step[r.ends[kept]] -= 1
        take = np.cumsum(step[:-1], dtype=np.int8) > 0
        space = r.ends[kept[~last]]
        take[space] = True
        text = c.data.copy()
        text[space] = 0x20
        size = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(take, False).astype(np.int64), c.offsets[:-1]) * (np.diff(c.offsets) > 0))]) if len(take) else np.zeros(len(c.offsets), np.int64)
        joined = memoryview(text[take].tobytes())
        sha = [hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(size[:-1].tolist(), size[1:].tolist())]
        doc = r.doc[at[first]]
        cut = np.searchsorted(doc, np.arange(len(c.ids) + 1))
        raw = c.data.tobytes()
        digests = [word_digest(raw, a, b) for a, b in zip(r.starts[at[first]].tolist(), r.ends[at[first] + n + window - 2].tolist())]
        columns = [at[first] - r.words[doc], n + window - 1, reference[first], place[first], home[first]]
        spans = pa.StructArray.from_arrays([*map(pa.array, columns), pa.array(digests, pa.binary())], ["word", "n_words", "reference", "reference_word", "home", "digest"])
        n_words = np.diff(r.words)
        return pa.Table.from_arrays([c.ids, pa.array(n_words), pa.array(n_words - n_kept), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<word: long, n_words: long, reference: long, reference_word: long, home: long, digest: binary>>"
    found = stored(each_answered(store, {"flags": flags, "index": index}, parse, schema))
    dropped(flags, index)
    return found
