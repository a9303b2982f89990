"""Toxicity by weak supervision.

1. Voters.  Lexicon entries (whole words) and patterns (word beginnings of 4, 5 and 6 bytes) that are over-
   represented in labelled toxic training documents are mined with a likelihood-ratio test; entries of a kind
   and of like strength make up a voter, so that each has an accuracy of its own.  A small fixed list, the
   absence of every entry and the loudness of a text vote as well.  A voter says toxic, clean or nothing.
2. Label model.  A generative model of all votes: the class, and given the class a forest in which each vote
   depends on at most one other, the one that it is most correlated with (conditional mutual information).  It
   is fitted by expectation-maximisation; the given labels only start it, after that it has the votes alone.
   A voter that repeats another adds no evidence, as its vote is then certain given the other's.
3. A linear (logistic) classifier is trained on the posterior labels of the training sample, and on nothing else.

Labels come from the training folds only, at most about `sample` labelled documents of them (chosen by the hash
of their id); mining, fitting and the size of the model have that bound and no other.  Scoring covers every document and whole texts.
language, source and ids are never inputs of a score.

Defined results: null and empty texts score by the bias alone; without labelled documents of both classes the score is
(toxic + 0.5) / (labelled + 2) for every document; repeated label rows of one document count as toxic if any
does, null labels are ignored; repeated documents each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, dropped, fold, slices, stored, utf8, word_hashes, word_spans

SAMPLE = 20_000
#: An entry stands in so many toxic documents, has this likelihood ratio, and is so many times as usual in them.
OFTEN, SURE, LIFT = 3, 12.0, 5.0
PREFIXES = (4, 5, 6)
#: Common English insults, one voter.
BASE = ("idiot", "moron", "stupid", "scum", "pathetic", "loser", "disgusting", "trash", "worthless", "imbecile", "retard", "bastard")
GROUPS = 6


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of words and of their beginnings (0 where a word is no longer than it), and words before each document."""
    starts, ends, words = word_spans(data, offsets, ALNUM_WORD)
    out = [word_hashes(data, starts, ends, True)]
    for n in PREFIXES:
        h = word_hashes(data, starts, np.minimum(ends, starts + n), True) ^ np.uint64(n * 0x9E3779B9)
        h[ends - starts <= n] = 0
        out.append(h)
    return out, words


def _g2(a: Column, b: Column, t: int, n: int) -> Column:
    """Likelihood ratio of document frequencies a of t toxic and b of n clean documents."""
    p = (a + b) / F.lit(float(t + n))

    def part(k: Column, m: int) -> Column:
        some = F.when(k > 0, k * F.ln(k / F.lit(float(m)) / p)).otherwise(0.0)
        return some + F.when(k < m, (F.lit(m) - k) * F.ln((F.lit(m) - k) / F.lit(float(m)) / (1 - p))).otherwise(0.0)

    return 2 * (part(a, t) + part(b, n))


class Lexicon(NamedTuple):
    keys: np.ndarray  # sorted hashes
    voter: np.ndarray  # voter of each
    n_voters: int


def counts(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x (voters + 2): hits of each voter, then words and share of capitals and exclamation marks."""
    kinds, words = features(data, offsets)
    n = len(offsets) - 1
    hits = np.zeros((n, lexicon.n_voters))
    if len(lexicon.keys):
        quick = np.zeros(1 << 16, bool)
        quick[(lexicon.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for h in kinds:
            at = np.flatnonzero(quick[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(lexicon.keys, h[at]), len(lexicon.keys) - 1)
            ok = lexicon.keys[place] == h[at]
            np.add.at(hits, (np.searchsorted(words, at[ok], "right") - 1, lexicon.voter[place[ok]]), 1)
    loud = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 0x21) | ((data >= 0x41) & (data <= 0x5A)), out=loud[1:])
    size = np.maximum(np.diff(offsets), 1)
    return np.column_stack([hits, np.diff(words), np.diff(loud[offsets]) / size])


def votes(x: np.ndarray) -> np.ndarray:
    """documents x (voters + 2) of -1, 0, 1: each lexicon voter; no hit at all; loudness."""
    hits, words, loud = x[:, :-2], x[:, -2], x[:, -1]
    v = (hits > 0).astype(np.int8)
    none = np.where((hits.sum(1) == 0) & (words > 0), -1, 0)
    return np.column_stack([v, none, np.where(loud > 0.3, 1, np.where(loud < 0.08, -1, 0))]).astype(np.int8)


class LabelModel(NamedTuple):
    prior: float
    parent: np.ndarray  # of each voter, itself for roots
    rates: np.ndarray  # voters x {clean, toxic} x vote of the parent x vote; of roots the same for each vote of the parent

    def posterior(self, v: np.ndarray) -> np.ndarray:
        j = np.arange(v.shape[1])
        ratio = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + ratio[j, v[:, self.parent] + 1, v + 1].sum(1), -50, 50)))


def joint(v: np.ndarray, q: np.ndarray, a: int, b: int) -> np.ndarray:
    """{clean, toxic} x vote of a x vote of b: how often, with half a document spread over all."""
    cell = (v[:, a] + 1).astype(np.int64) * 3 + v[:, b] + 1
    return np.stack([np.bincount(cell, weights=w, minlength=9).reshape(3, 3) for w in (1 - q, q)]) + 0.5 / 9


def forest(v: np.ndarray, q: np.ndarray, least: float = 0.01) -> np.ndarray:
    """The parent of each voter in a heaviest spanning forest by mutual information given the class (`least` or more)."""
    m = v.shape[1]
    edges = []
    for a in range(m):
        for b in range(a):
            n = joint(v, q, a, b)
            given = n.sum((1, 2), keepdims=True)
            info = float((n * np.log(n * given / n.sum(2, keepdims=True) / n.sum(1, keepdims=True))).sum() / n.sum())
            if info >= least:
                edges.append((info, a, b))
    near: list[list[int]] = [[] for _ in range(m)]
    tree = list(range(m))
    for _, a, b in sorted(edges, reverse=True):
        if tree[a] != tree[b]:
            was, now = tree[a], tree[b]
            tree = [now if x == was else x for x in tree]
            near[a].append(b)
            near[b].append(a)
    parent = np.arange(m)
    for root in sorted(set(tree)):
        todo, seen = [root], {root}
        while todo:
            x = todo.pop()
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    parent[y] = x
                    todo.append(y)
    return parent


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 15) -> LabelModel:
    """Expectation-maximisation from the labels `start` on, which no later round sees."""
    q = np.clip(start.astype(float), 0.02, 0.98)
    m = v.shape[1]
    for r in range(rounds):
        if r % 5 == 0:
            parent = forest(v, q)
        rates = np.empty((m, 2, 3, 3))
        for j in range(m):
            n = joint(v, q, int(parent[j]), j)
            if parent[j] == j:
                n = np.repeat(n.sum(1, keepdims=True), 3, axis=1)
            rates[j] = n / n.sum(2, keepdims=True)
        model = LabelModel(float(np.clip(q.mean(), 1e-3, 1 - 1e-3)), parent, rates)
        q = model.posterior(v)
    return model


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method for soft labels; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - q) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def inputs(x: np.ndarray) -> np.ndarray:
    hits, words = x[:, :-2], x[:, -2]
    total = hits.sum(1)
    return np.column_stack([np.log1p(hits), total > 0, np.log1p(total), np.log1p(100 * total / np.maximum(words, 1)), x[:, -1]])


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    base: float | None = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(offsets) - 1, self.base)
        z = inputs(counts(self.lexicon, data, offsets))
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40)))


def base_entries() -> np.ndarray:
    data, offsets = utf8(pa.array(list(BASE)))
    starts, ends, _ = word_spans(data, offsets, ALNUM_WORD)
    return word_hashes(data, starts, ends, True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train=None) -> Model:  # noqa: ANN001
    """docs: doc_id, text; labels: doc_id, toxic.  train: condition on doc_id of the rows to learn from."""
    train = fold() != 0 if train is None else train
    own = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, positive = own.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not 0 < positive < n:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1), np.zeros(0), (positive + 0.5) / (n + 2))
    share = min(1.0, sample / n)
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about `sample` ids, so this side has a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, "text"):
            kinds, words = features(*utf8(t["text"]))
            doc = np.repeat(np.arange(t.num_rows), np.diff(words))
            toxic = t["toxic"].to_numpy()
            for k, h in enumerate(kinds):
                keep = h != 0
                order = np.lexsort((doc[keep], h[keep]))
                hs, ds = h[keep][order], doc[keep][order]
                if not len(hs):
                    continue
                one = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
                hs, ds = hs[one], ds[one]
                first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                a = np.add.reduceat(toxic[ds].astype(np.int64), first)
                all_ = np.diff(np.append(first, len(hs)))
                yield pa.RecordBatch.from_arrays([pa.array(hs[first].view(np.int64)), pa.array(np.full(len(first), k, np.int32)), pa.array(a), pa.array(all_ - a)], ["h", "kind", "a", "b"])
            size = toxic.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([-1], pa.int32()), pa.array([int(size.sum())]), pa.array([int(len(size) - size.sum())])], ["h", "kind", "a", "b"])

    mined = rows.mapInArrow(mine, "h long, kind int, a long, b long").groupBy("h", "kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    mined = stored(mined)
    size = mined.filter("kind = -1").first()
    entries = mined.filter(F.lit(False)).toPandas()
    if size and size.a and size.b:
        a, b, often = F.col("a"), F.col("b"), float(OFTEN)
        rates = (a + 0.5) / (size.a + 1) / ((b + 0.5) / (size.b + 1))
        found = mined.filter((F.col("kind") >= 0) & (a >= often)).withColumns({"g": _g2(a, b, size.a, size.b), "lift": rates})
        # of the sample's words only, whose number its size bounds
        entries = found.filter((F.col("g") >= SURE) & (F.col("lift") >= LIFT)).toPandas().sort_values(["kind", "lift", "h"], ascending=[True, False, True], ignore_index=True)
    dropped(mined)
    keys = entries.h.to_numpy().astype(np.int64).view(np.uint64)
    kinds = entries.kind.to_numpy().astype(np.int64)
    # those of a kind in equal parts, by how many times as usual they are
    place = entries.groupby("kind").cumcount().to_numpy() if len(entries) else np.zeros(0, np.int64)
    n_kind = np.bincount(kinds, minlength=1 + len(PREFIXES))
    voter = kinds * GROUPS + place * GROUPS // np.maximum(n_kind[kinds], 1) + 1
    base = base_entries()
    keep = ~np.isin(base, keys)
    keys, voter = np.concatenate([keys, base[keep]]), np.concatenate([voter, np.zeros(int(keep.sum()), np.int64)])
    order = np.argsort(keys)
    lexicon = Lexicon(keys[order], voter[order], 1 + GROUPS * (1 + len(PREFIXES)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, "text"):
            x = counts(lexicon, *utf8(t["text"]))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), t["toxic"].combine_chunks()], ["x", "toxic"])

    got = rows.mapInArrow(apply, "x binary, toxic int").toPandas()  # at most `sample` rows of a few hundred bytes
    if got.toxic.nunique() < 2:
        return Model(lexicon, np.zeros(0), (int(got.toxic.sum()) + 0.5) / (len(got) + 2))
    x = np.stack([np.frombuffer(r) for r in got.x])
    y = got.toxic.to_numpy().astype(float)
    v = votes(x)
    posterior = label_model(v, y).posterior(v)
    return Model(lexicon, logistic(inputs(x), posterior))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """keep columns and the score of every row."""
    fields = docs.select(*keep).schema.fields
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, text):
            s = sent.value.score(*utf8(t[text]))
            yield from pa.Table.from_arrays([*(t[c].combine_chunks() for c in keep), pa.array(s)], [*keep, name]).to_batches()

    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = score(docs, fit(docs, labels, sample))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
