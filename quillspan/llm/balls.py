"""Compression of vectors to short codes: one codebook for each of eight parts, fitted over metric trees.

Vectors are cut into parts, and each part position gets a codebook by rounds of assignment to the nearest entry
and replacement by the mean, all in integers.  The parts of a chunk of vectors stand in an anchors hierarchy:
about the square root of their number of anchors is chosen, each new one the point farthest from the anchor
that it lies with, and takes what is nearer to it; anchors are merged upwards, the pair with the smallest
common ball first, and divided downwards in the same way (middle-out).  Every ball keeps the sum and the number
of its points.  In a round a ball inherits the list of entries that its parent could not rule out and drops each
entry that another beats everywhere within the ball; once one is left, the ball is wholly owned and its cached
sum is added as a whole.  Only points in leaves that more than one entry reaches are compared one by one.

Trees are built once and stored with their vectors; a round reads them, and each task hands on one sum for each
entry.  Only codebooks (16 x the length of a vector) and these sums reach the driver.

Rows whose vector is null or holds null or non-finite components are dropped.  Shorter vectors, and a length that
eight does not divide, count as if zeros followed.  With fewer than 16 kept rows there are as many entries.  Rows
with equal ids are rows of their own, null ids come after all others, ties among the first 16 go by the vector.
Null labels are one label.  A part whose squared distances might pass 2^63 is an error.  An empty table gives none.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, from_planes, planes, small_batches, stored, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk at most, and bytes of its integers.
CHUNK, CHUNK_BYTES = 4096, 8 << 20
#: Points of a ball that is not divided further.
LEAF = 12
#: Labels up to which their sums are broadcast (some 50 bytes each); beyond, labels are joined by salted keys.
FEW_LABELS, SALTS = 100_000, 64


# ---------------------------------------------------------------- the tree


def _anchors(x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Up to k anchors over the points ids: pivot, points, radius of each."""
    mine = x[ids]
    pivots = [mine[0]]
    far = np.sqrt(((mine - mine[0]) ** 2).sum(1))
    owner = np.zeros(len(ids), np.int64)
    radius = [float(far.max())]
    while len(pivots) < k:
        worst = int(np.argmax(radius))
        if radius[worst] == 0:
            break
        at = np.flatnonzero(owner == worst)
        pivot = mine[at[np.argmax(far[at])]]
        between = np.sqrt(((np.asarray(pivots) - pivot) ** 2).sum(1))
        # a point nearer to its anchor than half way to the new one cannot change
        near = np.flatnonzero(far * 2 >= between[owner])
        d = np.sqrt(((mine[near] - pivot) ** 2).sum(1))
        won = d < far[near]
        taken = near[won]
        touched = np.unique(owner[taken])
        owner[taken], far[taken] = len(pivots), d[won]
        pivots.append(pivot)
        radius.append(float(d[won].max()) if len(taken) else 0.0)
        for j in touched:
            left = far[owner == j]
            radius[j] = float(left.max()) if len(left) else 0.0
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(pivots) + 1))
    return [(p, ids[order[cut[j] : cut[j + 1]]], radius[j]) for j, p in enumerate(pivots) if cut[j] < cut[j + 1]]


def _middle_out(x: np.ndarray, ids: np.ndarray) -> tuple:
    """A leaf as (points,), or a ball as its two children."""
    if len(ids) <= LEAF:
        return (ids,)
    balls = _anchors(x, ids, max(2, int(np.sqrt(len(ids)))))
    if len(balls) == 1:
        return (ids,)
    nodes = [_middle_out(x, i) for _, i, _ in balls]
    centre, size = np.array([p for p, _, _ in balls]), np.array([len(i) for _, i, _ in balls], float)
    radius = np.array([r for _, _, r in balls])
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    cost = (gap + radius[:, None] + radius[None]) / 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(nodes) - 1):
        i, j = sorted(divmod(int(np.argmin(cost)), len(nodes)))
        weight = size[i] + size[j]
        middle = (centre[i] * size[i] + centre[j] * size[j]) / weight
        radius[i] = max(np.sqrt(((centre[k] - middle) ** 2).sum()) + radius[k] for k in (i, j))
        nodes[i], centre[i], size[i] = (nodes[i], nodes[j]), middle, weight
        size[j] = 0
        cost[j] = cost[:, j] = np.inf
        live = np.flatnonzero(size)
        live = live[live != i]
        cost[i, live] = cost[live, i] = (np.sqrt(((centre[live] - middle) ** 2).sum(1)) + radius[live] + radius[i]) / 2
    return nodes[int(np.flatnonzero(size)[0])]


class Tree:
    """Balls over the points of one part of a chunk: `points` in the tree's order, and by ball, level after level,
    its parent, its range of points, whether it is a leaf, its centre, its radius, and its sum."""

    def __init__(self, x: np.ndarray) -> None:
        real = x.astype(np.float64)
        points, at = [], 0
        stack = [(_middle_out(real, np.arange(len(x))), 0, -1)]
        starts, ends, parents, depths, leaf = [], [], [], [], []
        while stack:
            node, depth, parent = stack.pop()
            if node is None:
                ends[parent] = at
                continue
            me = len(starts)
            starts.append(at)
            ends.append(at)
            parents.append(parent)
            depths.append(depth)
            leaf.append(len(node) == 1)
            if len(node) == 1:
                points.append(node[0])
                at += len(node[0])
                ends[me] = at
            else:
                stack += [(None, 0, me), (node[1], depth + 1, me), (node[0], depth + 1, me)]
        flat = np.concatenate(points)
        order = np.argsort(depths, kind="stable")
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        parents = np.asarray(parents)[order]
        self.points, self.start, self.end, self.leaf = flat.astype(np.int32), np.asarray(starts, np.int32)[order], np.asarray(ends, np.int32)[order], np.asarray(leaf)[order]
        self.parent = np.where(parents < 0, -1, new[parents]).astype(np.int32)
        self.levels = np.searchsorted(np.asarray(depths)[order], np.arange(max(depths) + 2)).astype(np.int32)
        run = np.zeros((len(x) + 1, x.shape[1]), np.int64)
        np.cumsum(x[flat], axis=0, out=run[1:])
        self.sum = run[self.end] - run[self.start]
        self.centre = self.sum / (self.end - self.start)[:, None]
        placed = real[flat]
        self.radius = np.array([np.sqrt(((placed[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(self.start, self.end, self.centre)]) * (1 + 1e-9)

    def assign(self, x: np.ndarray, entries: np.ndarray, points: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Counts and sums by entry and, if wanted, the entry of every point (ties to the smaller number)."""
        n = len(entries)
        real = entries.astype(np.float64)
        apart = np.sqrt(((real[:, None] - real[None]) ** 2).sum(2))
        first = np.zeros(n, bool)  # equal entries: the first has all
        first[np.unique(entries, axis=0, return_index=True)[1]] = True
        counts, sums = np.zeros(n, np.int64), np.zeros(entries.shape, np.int64)
        label = np.full(len(x), -1, np.int16) if points else None
        lists = np.zeros((len(self.start), n), bool)
        divided = np.zeros(len(self.start), bool)
        rest = []
        for lo, hi in zip(self.levels[:-1], self.levels[1:]):
            at = np.arange(lo, hi)
            if lo:
                at = at[divided[self.parent[at]]]
            if not len(at):
                break
            have = lists[self.parent[at]] if lo else np.repeat(first[None], len(at), 0)
            far = ((self.centre[at][:, None] - real[None]) ** 2).sum(2)
            best = np.where(have, far, np.inf).argmin(1)
            least = far[np.arange(len(at)), best]
            # beaten everywhere in the ball: all of it lies beyond the plane between the two entries
            lead = far - least[:, None]
            have &= lead <= 2 * self.radius[at][:, None] * apart[best] + 1e-9 * (far + least[:, None]) + 1e-9
            owned = have.sum(1) == 1
            mine = at[owned]
            np.add.at(sums, best[owned], self.sum[mine])
            np.add.at(counts, best[owned], (self.end - self.start)[mine])
            if points:
                for a, b, e in zip(self.start[mine], self.end[mine], best[owned]):
                    label[self.points[a:b]] = e
            lists[at] = have
            divided[at] = ~owned
            rest.append(at[~owned & self.leaf[at]])
        at = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        if len(at):
            size = (self.end - self.start)[at]
            place = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            who = self.points[place]
            p, e = np.nonzero(np.repeat(lists[at], size, 0))
            d = ((x[who[p]] - entries[e]) ** 2).sum(1)
            edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            hit = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, edge), np.diff(np.append(edge, len(p)))))
            hit = hit[np.unique(p[hit], return_index=True)[1]]
            np.add.at(sums, e[hit], x[who])
            counts += np.bincount(e[hit], minlength=n)
            if points:
                label[who] = e[hit]
        return counts, sums, label


# ---------------------------------------------------------------- chunks


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    """floor(4096 * component) of each vector, zeros behind, as rows of `length` entries."""
    size = np.asarray(vectors.value_lengths())
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and float(np.abs(flat).max()) ** 2 * 4 * max(1, length // PARTS) >= 2**62:
        raise ValueError("components are too large: squared distances might pass 2^63")
    out = np.zeros((len(size), length), np.int64)
    out[np.arange(length)[None] < size[:, None]] = flat.astype(np.int64)
    return out


def _pack(rows: DataFrame, length: int) -> DataFrame:
    """Chunks: ids and labels, integers, trees of all parts."""
    limit = max(1, min(CHUNK, CHUNK_BYTES // max(1, 8 * length)))
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = integers(t["v"].combine_chunks(), length)
            trees = [Tree(part) for part in np.split(x, PARTS, axis=1)]
            kind = "i4" if not x.size or np.abs(x).max() < 1 << 31 else "i8"
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([t.num_rows], pa.int32()), pa.array([kind]), pa.array([planes(x.reshape(-1).astype(kind))], pa.binary()), pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "n", "kind", "x", "trees"])

        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, limit - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == limit:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)
        tidy()

    return stored(rows.mapInArrow(pack, f"ids array<{ids}>, labels array<{labels}>, n int, kind string, x binary, trees binary"))


def _each(b: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, list[Tree]]]:
    for i in range(b.num_rows):
        n, kind, x, trees = (b.column(b.schema.get_field_index(c))[i].as_py() for c in ("n", "kind", "x", "trees"))
        yield i, from_planes(x, kind).astype(np.int64).reshape(n, length), pickle.loads(trees)


def _round(chunks: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """Each part's entries replaced by the means of what they own."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for _, x, trees in _each(b, length):
                for k, part in enumerate(np.split(x, PARTS, axis=1)):
                    c, s, _ = trees[k].assign(part, books[k], False)
                    counts[k] += c
                    total[k] += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
        tidy()

    rows = chunks.select("n", "kind", "x", "trees").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    rows = rows.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "v"))
    rows = rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    new = books.copy()
    for r in rows.collect():  # one for each component of the codebooks
        if r.at is not None:
            new[r.part, r.entry, r.at] = int(r.v) // r.n
    return new


def fit(chunks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after some rounds; first: the vectors they start from."""
    books = np.stack(np.split(first, PARTS, axis=1))
    for _ in range(rounds):
        books = _round(chunks, books, first.shape[1])
    return books


def _codes(chunks: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    ids, labels = (chunks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x, trees in _each(b, length):
                error, code = np.zeros(len(x), np.int64), np.zeros((len(x), PARTS), np.uint8)
                for k, part in enumerate(np.split(x, PARTS, axis=1)):
                    _, _, label = trees[k].assign(part, books[k], True)
                    code[:, k] = label
                    error += ((part - books[k][label]) ** 2).sum(1)
                text = code.tobytes().hex()
                step = 2 * PARTS
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array([text[j : j + step] for j in range(0, len(text), step)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
        tidy()

    return chunks.select("ids", "labels", "n", "kind", "x", "trees").mapInArrow(codes, f"vec_id {ids}, label {labels}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of error over equal labels, nulls together."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        other = F.broadcast(totals.withColumnRenamed("label", "same"))
        return coded.join(other, F.col("label").eqNullSafe(F.col("same"))).drop("same")
    salted = totals.select(F.col("label").alias("same"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt") == F.col("s"))).drop("same", "s", "salt")


def compress(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & sound)
    longest = rows.agg(F.max(F.size("v"))).head()[0]
    length = max(1, -(-(longest or 0) // PARTS)) * PARTS
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    chunks = _pack(rows, length)
    with small_batches(spark, 1):
        if not seeds:
            books = np.zeros((PARTS, 0, length // PARTS), np.int64)
        else:
            books = fit(chunks, integers(pa.array([r.v for r in seeds], pa.list_(pa.float64())), length))
        coded = stored(_codes(chunks, books, length))
    dropped(chunks)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
