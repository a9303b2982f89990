"""Language-model scoring by deleted interpolation.

P(w | history) is a mixture of the uniform distribution over the vocabulary and one unknown, and of maximum-
likelihood n-gram estimates of orders 1 to `order`.  The weights depend on the bucket of the context: the
longest context seen in training and the power of two of its frequency.  They are learned by expectation-
maximisation on held-out counts: one training fold is deleted from the counts, and its tokens, binned by
bucket and by the logarithms of their estimates, are the events.  The final counts take in every training
fold.

Counts cover all training documents.  Each chunk of documents sends its distinct n-grams with their counts
once to the bucket of their hash and gets the totals back; the binned events have a bounded number.

Tokens: words between ASCII spaces, A-Z in lower case, then one end token a document, which is also what
stands before its first word.  Defined results: null text is empty and is its end token alone; without
training documents every token has probability 1 of the uniform part; repeated rows count each time; a null
id counts as empty text in the fold's checksum; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, answers, bucket_rows, buckets, buckets_schema, chunked, cleaned, each_answered, each_chunk, exchange, from_planes, in_group, mix, stored, word_hashes, word_spans

END = np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0xD6E8FEB86659FD93)
ORDER = 3
HELD_OUT, TUNE = 1, 0
#: Bytes of text in a chunk: the larger, the fewer n-grams are sent twice.
CHUNK = 12 << 20
#: Hashes of longer n-grams keep 56 bits; what collides there is one in millions and shifts an estimate, no more.
_KEEP = np.uint64(0xFFFFFFFFFFFFFF00)
#: Bins for each doubling of an estimate.
BINS = 4


class Tokens:
    """Tokens of a chunk with their ends, and where documents begin."""

    def __init__(self, c: Chunk) -> None:
        starts, ends, words = word_spans(c.data, c.offsets)
        self.first = words + np.arange(len(words))
        self.t = np.insert(word_hashes(c.data, starts, ends, True), words[1:], END)
        n = np.diff(self.first)
        self.fold = np.repeat(c.folds, n)
        self.head = self.first[:-1]

    def grams(self, order: int) -> np.ndarray:
        """Hash of the n-gram that ends at each token; before a document stand end tokens."""
        if order == 1:
            return self.t
        before = np.empty_like(self.t)
        shorter = self.grams(order - 1)
        before[1:] = shorter[:-1]
        before[self.head] = END * np.uint64(order)
        return mix(before * _STEP + self.t) & _KEEP


def _sorted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first places in it, and distinct keys."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return order, first, g[first]


def _counts(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, and how often each is in the estimation folds and in the tuning fold."""
    order, first, keys = _sorted(tokens.grams(n))
    fold = tokens.fold[order]
    tune, est = fold == TUNE, (fold != TUNE) & (fold != HELD_OUT)
    if not len(first):
        return keys, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return keys, np.add.reduceat(est, first, dtype=np.uint32), np.add.reduceat(tune, first, dtype=np.uint32)


def _back(tokens: Tokens, n: int, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each token the corpus counts of its n-gram: estimation folds, all training folds."""
    order, first, _ = _sorted(tokens.grams(n))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    est, tune = answers(back, 0, "u4").astype(np.int64), answers(back, 1, "u4").astype(np.int64)
    return est[which], (est + tune)[which]


class Totals(NamedTuple):
    tokens: int
    types: int
    documents: int


def _buckets(counts: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
    """32 * (longest seen order) + power of two of its context's count."""
    out = np.zeros(len(counts[0]), np.int64)
    for n in range(2, len(counts) + 1):
        c = context[n - 1]
        seen = c > 0
        out[seen] = 32 * n + np.minimum(np.log2(c[seen]).astype(np.int64), 31)
    return out


def _estimates(tokens: Tokens, counts: list[np.ndarray], total: Totals) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates of each order, and the bucket, of each token."""
    context = [np.zeros(0)]
    ml = [counts[0] / max(total.tokens, 1)]
    for n in range(2, len(counts) + 1):
        c = np.empty(len(tokens.t), np.int64)
        c[1:] = counts[n - 2][:-1]
        c[tokens.head] = total.documents
        context.append(c)
        ml.append(counts[n - 1] / np.maximum(c, 1))
    return ml, _buckets(counts, context)


def learn(events: np.ndarray, order: int, uniform: float, rounds: int = 40) -> dict[int, np.ndarray]:
    """Expectation-maximisation for each bucket.  events: rows of bucket, bins of order 1.., count."""
    out = {}
    for b in np.unique(events[:, 0]).tolist():
        e = events[events[:, 0] == b]
        p = np.column_stack([np.full(len(e), uniform), np.where(e[:, 1 : order + 1] > 0, 0.0, np.exp2(np.minimum(e[:, 1 : order + 1], 0) / BINS))])
        n, w = e[:, -1].astype(float), np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            part = p * w
            w = (n[:, None] * part / np.maximum(part.sum(1, keepdims=True), 1e-300)).sum(0) + np.where(p.any(0), 0.01, 0)
            w /= w.sum()
        out[b] = w
    return out


def weight_of(weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """Weights of every bucket; one without events has those of the next lower one that has some."""
    table = np.empty((32 * (order + 1), order + 1))
    last = np.array([0.5, 0.5, *[0.0] * (order - 1)])
    for b in range(len(table)):
        last = weights.get(b, last)
        table[b] = last
    return np.maximum(table, 1e-9)


def score(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    store = chunked(docs, doc_id, text, CHUNK, TUNE)
    parts = buckets(store, CHUNK)

    def totals(inverse: np.ndarray, values: list[np.ndarray], chunk_no: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        both = [in_group(inverse, starts, v, np.add) for v in values]
        first = np.zeros(len(inverse), np.uint8)
        at = np.unique(inverse, return_index=True)[1]
        first[at] = both[0] + (both[1] > 0) > 0
        first[at] |= (both[0] > 0).astype(np.uint8) * 2
        return [both[0][inverse], both[1][inverse], first]

    def summed(inverse: np.ndarray, values: list[np.ndarray], chunk_no: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        return [in_group(inverse, starts, v, np.add)[inverse] for v in values]

    def send(n: int):  # noqa: ANN202
        def one(c: Chunk) -> Iterator[pa.RecordBatch]:
            keys, est, tune = _counts(Tokens(c), n)
            yield bucket_rows(c.name, keys, [est, tune], parts)

        return each_chunk(store, one, buckets_schema(2))

    back = {"1": stored(exchange(send(1), parts, ["u4", "u4"], totals, 3))}
    for n in range(2, order + 1):
        cleaned(spark)
        back[str(n)] = stored(exchange(send(n), parts, ["u4", "u4"], summed, 2))
    cleaned(spark)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(4, np.int64)
        for b in batches:
            for e, t, f in zip(*(b.column(i).to_pylist() for i in range(3))):
                e, t, f = from_planes(e, "u4").astype(np.int64), from_planes(t, "u4").astype(np.int64), from_planes(f, "u1")
                got += [e[f > 0].sum(), (e + t)[f > 0].sum(), (f & 2 > 0).sum(), (f > 0).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], list("abcd"))

    a, b, c, d = (x or 0 for x in back["1"].select("a0", "a1", "a2").mapInArrow(sizes, "a long, b long, c long, d long").agg(*(F.sum(x) for x in "abcd")).first())

    def train_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = t = 0
        for x in batches:
            for f in x.column(0).to_pylist():
                f = np.frombuffer(f, np.uint8)
                e, t = e + int(((f != TUNE) & (f != HELD_OUT)).sum()), t + int((f != HELD_OUT).sum())
        yield pa.RecordBatch.from_arrays([pa.array([e]), pa.array([t])], ["e", "t"])

    docs_est, docs_all = (x or 0 for x in store.select("folds").mapInArrow(train_docs, "e long, t long").agg(F.sum("e"), F.sum("t")).first())
    est, full = Totals(a, c, docs_est), Totals(b, d, docs_all)

    def events(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        tokens = Tokens(c)
        counts = [_back(tokens, n, got[str(n)])[0] for n in range(1, order + 1)]
        ml, bucket = _estimates(tokens, counts, est)
        at = np.flatnonzero(tokens.fold == TUNE)
        cols = [bucket[at]]
        for p in ml:
            p = p[at]
            cols.append(np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1)) * BINS), 1).astype(np.int64))
        key = np.column_stack(cols)
        key, n = np.unique(key, axis=0, return_counts=True)
        return pa.Table.from_arrays([*(pa.array(key[:, i]) for i in range(order + 1)), pa.array(n)], ["b", *(f"q{i}" for i in range(1, order + 1)), "n"])

    by = ["b", *(f"q{i}" for i in range(1, order + 1))]
    tuned = {n: t.filter(F.col("chunk").endswith("t")) for n, t in back.items()}
    found = each_answered(store.filter(F.col("chunk").endswith("t")), tuned, events, ", ".join(f"{x} long" for x in by) + ", n long").groupBy(*by).agg(F.sum("n").alias("n"))
    uniform = 1 / (est.types + 1)

    def fit(t: pa.Table) -> pa.Table:
        e = np.column_stack([t[x].to_numpy() for x in (*by, "n")])
        w = learn(e[np.lexsort(e.T[::-1])], order, uniform)
        return pa.table({"b": list(w), "w": [x.tolist() for x in w.values()]})

    # a bucket has a bounded number of bins, and there are 32 buckets an order
    weights = {r.b: np.array(r.w) for r in found.groupBy("b").applyInArrow(fit, "b long, w array<double>").collect()}
    mixture = weight_of(weights, order)
    del found
    cleaned(spark)

    def scores(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        tokens = Tokens(c)
        counts = [_back(tokens, n, got[str(n)])[1] for n in range(1, order + 1)]
        ml, bucket = _estimates(tokens, counts, full)
        w = mixture[bucket]
        p = w[:, 0] / (full.types + 1)
        for n in range(1, order + 1):
            p = p + w[:, n] * ml[n - 1]
        base = np.log10((counts[0] + 0.5) / (full.tokens + 0.5 * (full.types + 1)))
        add = lambda x: np.add.reduceat(x, tokens.head) if len(x) else x
        cols = [c.ids, pa.array(c.folds == HELD_OUT), pa.array(np.diff(tokens.first)), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(c.ids), full.tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.Table.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return each_answered(store, back, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
