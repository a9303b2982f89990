"""Exact Jaccard join of n-gram sets with PartEnum signatures.

Equal sets are one vertex from the start, and only one document of each stands for them from there on.

Sets are grouped by size bands, each reaching from l to l/0.8, so that similar sets lie in one band or in
neighbouring ones.  For a band and the one below, similar sets differ in at most k elements.  The hashed
domain is cut into n1 partitions of n2 parts, and for each partition every choice of n2-k2 of its parts gives
a signature, a hash of the set's elements there.  With n1 > k/(k2+1)+s, similar sets agree on a signature in
more than s partitions.  Sets of up to 13 elements enumerate the subsets with a fifth of the elements left
out instead.

Signatures of fewer than `WEAK` elements are not sent, as they say little: a set with at most s partitions
that have one cannot lose a partner by it.  A set with more of them sends a second series that is complete.
The first series leaves out shingles that stand in `FREQUENT` vertices or more, counted over all of them;
leaving elements out of both sets never makes them differ more, so this only saves work and decides nothing.

Vertices that share a signature form a group, whose large ones are dealt into tiles.  Within a tile all
pairs are held against each other by sketches, which rule out pairs without loss, and what is left is
reduced to a spanning forest; small groups give all their pairs.  The forests' edges are judged by the whole
sets, and the linked ones joined to components.  In a tile of a large group that still has a pair that the
sketches let pass across two components, the vertices of such pairs are then held against each other by
their whole sets.  Every linked pair shares a group and passes its sketches, so after that both its ends lie
in one component.

Similar sets lie in one component, so links are counted over all pairs of different sets of each component,
exactly.  A component is cut into blocks by hash, and each pair of blocks is a group of its own.

Defined results: null text and texts without words have 0 shingles, link with nothing and are their own
component; texts of fewer words than a shingle are one shingle; a null id counts as the largest and its
component is null if no other id is in it; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNKS, Chunk, answers, bucket_rows, buckets_schema, chunked, cleaned, dropped, each_answered, each_chunk, exchange, from_planes, mix, pack_sorted, packed, partitions, small_batches, stored, tidy, unpack_sorted, window_ok, windows, word_hashes, word_spans
from .graph import components

WORDS, SIMILAR = 5, 80
WEAK = 2
#: Sets up to this size enumerate subsets with elements left out.
SMALL = 13
#: A shingle of so many vertices is frequent.
FREQUENT = 64
#: A group up to this size gives all its pairs; vertices of a tile, about.
FEW, TILE = 8, 4096
#: Bytes of text in a chunk.
CHUNK = 2 << 20
#: Sets and shingles of a block in which links are counted, about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18
_NULL = (1 << 63) - 1
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def bands(n_max: int) -> np.ndarray:
    """Upper ends of the size bands."""
    ends, low = [], 1
    while low <= n_max * 2:
        ends.append(low * 100 // SIMILAR)
        low = ends[-1] + 1
    return np.array(ends)


def scheme(r: int) -> tuple[int, int, int]:
    """n1, k2, n2 for sets of up to r elements."""
    k = 2 * r * (100 - SIMILAR) // (100 + SIMILAR)
    if k <= 4:
        return 1, k, k + 4
    if k <= 13:
        return k // 3 + 2, 2, 6
    n1 = k // 2 + 1
    return n1 + max(2, n1 // 6), 1, 3


class Sets:
    """Shingle sets of the documents of a chunk: distinct hashes in order of document and hash."""

    def __init__(self, c: Chunk, k: int = WORDS) -> None:
        starts, ends, words = word_spans(c.data, c.offsets)
        h = word_hashes(c.data, starts, ends, True)
        n = np.diff(words)
        doc = np.repeat(np.arange(len(n)), n)
        ok = np.flatnonzero(window_ok(words, k))
        s, d = windows(h, k)[ok], doc[ok]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):  # the whole sequence is one shingle; its length keeps it apart from longer ones
            whole = np.array([int(mix(np.array([np.add.reduce(h[words[i] : words[i + 1]] * np.uint64(0x9FB21C651E98DF25) ** np.arange(n[i], dtype=np.uint64))], np.uint64))[0]) ^ int(n[i]) for i in short.tolist()], np.uint64)
            s, d = np.concatenate([s, whole]), np.concatenate([d, short])
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        self.s, self.d = s[new], d[new]
        self.n = np.bincount(self.d, minlength=len(c.ids))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        full = np.flatnonzero(self.n)
        self.id1, self.id2 = np.zeros(len(c.ids), np.uint64), np.zeros(len(c.ids), np.uint64)
        if len(full):
            at = self.first[:-1][full]
            self.id1[full], self.id2[full] = np.add.reduceat(mix(self.s * _A), at), np.add.reduceat(mix(self.s ^ _D), at)
        # one member for equal sets of the chunk
        key = np.lexsort((np.arange(len(c.ids)), self.id2, self.id1))
        same = np.zeros(len(key), bool)
        same[1:] = (self.id1[key][1:] == self.id1[key][:-1]) & (self.id2[key][1:] == self.id2[key][:-1])
        self.member = np.empty(len(key), np.int64)
        self.member[key] = key[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
        self.own = np.flatnonzero((self.member == np.arange(len(key))) & (self.n > 0))


def _small(sets: Sets) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys, who = [], []
    for i in sets.own[sets.n[sets.own] <= SMALL].tolist():
        x = mix(sets.s[sets.first[i] : sets.first[i + 1]] * _B)
        n = len(x)
        total = np.add.reduce(x)
        for gone in range(n * (100 - SIMILAR) // 100 + 1):
            out = np.array(list(combinations(range(n), gone)), np.int64)
            left = np.full(len(out), total) - x[out].sum(1, dtype=np.uint64) if gone else np.full(1, total)
            keys.append(mix(left + np.array([n - gone], np.uint64) * _C))
            who.append(np.full(len(left), i))
    return keys, who


def _series(s: np.ndarray, d: np.ndarray, docs: np.ndarray, n: np.ndarray, band: np.ndarray, ends: np.ndarray, whole: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Signatures of `docs` for their tags `band`; s, d: elements and their documents (sorted by document).

    Gives keys, documents, and which documents have more weak partitions than the bound allows (their weak
    signatures are sent only if `whole`).
    """
    keys, who, short = [], [], []
    first = np.searchsorted(d, docs)
    size = np.searchsorted(d, docs, "right") - first
    plans = np.array([scheme(int(r)) for r in ends])
    for k2, n2 in {(int(a), int(b)) for a, b in plans[np.unique(band), 1:]} if len(docs) else ():
        mine = np.flatnonzero((plans[band, 1] == k2) & (plans[band, 2] == n2))
        n1 = plans[band[mine], 0]
        cells = np.concatenate([[0], np.cumsum(n1 * n2)])
        slot = np.repeat(np.arange(len(mine)), size[mine])
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(size[mine])[:-1]]), size[mine]) + np.arange(len(slot))
        h = mix(s[at] ^ (band[mine].astype(np.uint64) * _D)[slot])
        cell = cells[slot] + ((h >> np.uint64(32)) % n1[slot].astype(np.uint64)).astype(np.int64) * n2 + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n2)).astype(np.int64)
        total, count = np.zeros(cells[-1], np.uint64), np.bincount(cell, minlength=cells[-1])
        order = np.argsort(cell, kind="stable")
        sc = cell[order]
        start = np.flatnonzero(np.concatenate([[True], sc[1:] != sc[:-1]])) if len(sc) else np.zeros(0, np.int64)
        if len(start):
            total[sc[start]] = np.add.reduceat(mix(h * _B)[order], start)
        total, count = total.reshape(-1, n2), count.reshape(-1, n2)
        of = np.repeat(np.arange(len(mine)), n1)
        p = np.arange(len(of)) - np.repeat(np.cumsum(n1) - n1, n1)
        weak = np.sort(count, axis=1)[:, : n2 - k2].sum(1) < WEAK
        bad = np.bincount(of, weights=weak, minlength=len(mine))
        # the most by which this set and a partner of the tag can differ
        t, x = band[mine], n[mine]
        partner = np.minimum(ends[t], x * 100 // SIMILAR)
        differ = (x + partner) * (100 - SIMILAR) // (100 + SIMILAR)
        over = bad > n1 - differ // (k2 + 1) - 1
        short.append(mine[over])
        tag = mix(t.astype(np.uint64) * _C + np.uint64(1 + whole))
        for j, c in enumerate(combinations(range(n2), n2 - k2)):
            c = list(c)
            m = count[:, c].sum(1)
            take = (m >= WEAK) | (over[of] if whole else False)
            sig = mix(total[:, c].sum(1, dtype=np.uint64) + tag[of] + mix(p.astype(np.uint64) * _A + np.uint64(j)))
            keys.append(sig[take])
            who.append(docs[mine[of[take]]])
    return keys, who, np.concatenate(short) if short else np.zeros(0, np.int64)


def signatures(sets: Sets, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted signature keys and their documents; rare: which elements the first series takes."""
    keys, who = _small(sets)
    ends = bands(int(sets.n.max(initial=1)))
    own = np.searchsorted(ends, sets.n[sets.own])
    docs, band = np.concatenate([sets.own, sets.own]), np.concatenate([own, own + 1])
    use = ends[band] > SMALL
    docs, band = docs[use], band[use]
    k, w, short = _series(sets.s[rare], sets.d[rare], docs, sets.n[docs], band, ends, False)
    k2, w2, _ = _series(sets.s, sets.d, docs[short], sets.n[docs[short]], band[short], ends, True)
    keys, who = np.concatenate([*keys, *k, *k2, np.zeros(0, np.uint64)]), np.concatenate([*who, *w, *w2, np.zeros(0, np.int64)]).astype(np.uint32)
    order = np.argsort(keys, kind="stable")
    return keys[order], who[order]


def sketches(sets: Sets) -> list[bytes | None]:
    """For each set the parities of its elements' numbers in 64 or more cells (a power of two, at least the size).

    Two sets differ in at least as many elements as their sketches do in bits; a longer sketch is folded.
    """
    bits = np.where(sets.n > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sets.n, 1))).astype(np.int64)), 0)
    at = np.concatenate([[0], np.cumsum(bits)])
    cell = at[:-1][sets.d] + (mix(sets.s ^ _A) & (bits[sets.d] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(cell, minlength=at[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [odd[a // 8 : b // 8] if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Sketches:
    """Sketches of a batch, and which pairs they let pass."""

    def __init__(self, column: pa.Array, n: np.ndarray) -> None:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.words = np.frombuffer(bytes(column.buffers()[2])[offsets[0] : offsets[-1]], np.uint64)
        self.at, self.size, self.n = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8, n

    def rows(self, who: np.ndarray, size: int, to: int) -> np.ndarray:
        """Sketches of one size, folded."""
        x = self.words[self.at[who][:, None] + np.arange(size)]
        while size > to:
            size //= 2
            x = x[:, :size] ^ x[:, size:]
        return x

    def matrix(self, who: np.ndarray) -> np.ndarray:
        """Sketches folded to the least size among them."""
        to = int(self.size[who].min())
        out = np.empty((len(who), to), np.uint64)
        for size in np.unique(self.size[who]).tolist():
            mine = self.size[who] == size
            out[mine] = self.rows(who[mine], size, to)
        return out

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Could the pairs (a, b) be similar?"""
        out = sizes_alike(self.n[a], self.n[b])
        left = np.flatnonzero(out)
        kind = self.size[a[left]] * (1 << 32) + self.size[b[left]]
        for k in np.unique(kind).tolist():
            p, q = k >> 32, k & 0xFFFFFFFF
            mine = left[kind == k]
            for lo in range(0, len(mine), max(1, (1 << 20) // max(p, q))):
                i = mine[lo : lo + max(1, (1 << 20) // max(p, q))]
                differ = np.bitwise_count(self.rows(a[i], p, min(p, q)) ^ self.rows(b[i], q, min(p, q))).sum(1, dtype=np.int64)
                out[i] = differ * (100 + SIMILAR) <= (self.n[a[i]] + self.n[b[i]]) * (100 - SIMILAR)
        return out


def sizes_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(x, y) >= SIMILAR * np.maximum(x, y)


def forest(m: int, near, side: np.ndarray | None) -> tuple[list[int], list[int]]:  # noqa: ANN001
    """Edges of a spanning forest of the pairs that near(i, others) lets pass; with sides, only across them."""
    new, out_a, out_b = np.ones(m, bool), [], []
    for root in range(m):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(new if side is None else new & (side != side[i]))
            if len(rest):
                found = rest[near(i, rest)]
                new[found] = False
                out_a += [i] * len(found)
                out_b += found.tolist()
                queue += found.tolist()
    return out_a, out_b


def in_tiles(found: DataFrame) -> DataFrame:
    """found: g, m, v and further columns, m being the size of g.  Adds tile x, y of g and whether v is on its left side."""
    of = F.ceil(F.col("m") / TILE).cast("int")
    block = F.pmod(F.xxhash64("v"), of.cast("long")).cast("int")
    rows = found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    return rows.select("g", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.expr("block <= other").alias("left"), *[c for c in found.columns if c != "g"])


def each_tile(tiles: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """fn(batch, bounds) for runs of whole tiles; bounds: where each begins, and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(i).to_numpy() for i in range(3)]
            new = np.ones(b.num_rows, bool)
            new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            new[0] = last is None or last != tuple(k[0] for k in key)
            last = tuple(k[-1] for k in key)
            start = np.flatnonzero(new)
            if len(start) and (held or start[-1] > 0):
                yield from whole(pa.concat_batches([*held, b.slice(0, int(start[-1]))]))
                held = []
            held.append(b.slice(int(start[-1]) if len(start) else 0))
        if held:
            yield from whole(pa.concat_batches(held))
        tidy()

    def whole(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows:
            key = [b.column(i).to_numpy() for i in range(3)]
            new = np.ones(b.num_rows, bool)
            new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            # the same group comes once from each bucket that has a signature of its members
            v = b.column(b.schema.get_field_index("v")).to_numpy()
            keep = new.copy()
            keep[1:] |= v[1:] != v[:-1]
            if not keep.all():
                b, new = b.filter(pa.array(keep)), new[keep]
            yield from fn(b, np.append(np.flatnonzero(new), b.num_rows))

    keys = ["g", "x", "y"]
    spread = tiles.repartition(partitions(tiles.sparkSession), *keys).sortWithinPartitions(*keys, "v")
    return spread.mapInArrow(run, schema)


def candidates(b: pa.RecordBatch, bounds: np.ndarray, few: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each tile that are to be judged: all that pass in small groups, a spanning forest in others."""
    get = lambda c: b.column(b.schema.get_field_index(c))
    v, left = get("v").to_numpy(), get("left").to_numpy(zero_copy_only=False)
    sk = Sketches(get("sketch"), get("n").to_numpy())
    size, out = np.diff(bounds), []
    for k in range(2, few + 1):
        first = bounds[:-1][size == k]
        if len(first):
            i, j = (np.array(x) for x in zip(*combinations(range(k), 2)))
            i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            ok = sk.alike(i, j)
            out.append((i[ok], j[ok]))
    x, y = get("x").to_numpy(), get("y").to_numpy()
    for lo, k in zip(bounds[:-1][size > few].tolist(), size[size > few].tolist()):
        who = np.arange(lo, lo + k)
        m, n = sk.matrix(who), sk.n[who]

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            differ = np.bitwise_count(m[rest] ^ m[i]).sum(1, dtype=np.int64)  # noqa: B023
            return (differ * (100 + SIMILAR) <= (n[rest] + n[i]) * (100 - SIMILAR)) & sizes_alike(n[rest], n[i])  # noqa: B023

        i, j = forest(k, near, None if x[lo] == y[lo] else left[who])
        out.append((lo + np.array(i, np.int64), lo + np.array(j, np.int64)))
    if out:
        i, j = (np.concatenate(z) for z in zip(*out))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v[i], v[j])), pa.array(np.maximum(v[i], v[j]))], ["a", "b"])


def still_open(b: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vertices of each tile that have a pair that passes with a vertex of another component."""
    get = lambda c: b.column(b.schema.get_field_index(c))
    label, left = get("label").to_numpy(), get("left").to_numpy(zero_copy_only=False)
    x, y = get("x").to_numpy(), get("y").to_numpy()
    sk = Sketches(get("sketch"), get("n").to_numpy())
    hit = np.zeros(b.num_rows, bool)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = label[lo:hi]
        if (own == own[0]).all():
            continue
        m, n = sk.matrix(np.arange(lo, hi)), sk.n[lo:hi]
        for i in range(hi - lo):
            rest = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
            if x[lo] != y[lo]:
                rest = rest[left[lo + rest] != left[lo + i]]
            if len(rest):
                differ = np.bitwise_count(m[rest] ^ m[i]).sum(1, dtype=np.int64)
                found = rest[(differ * (100 + SIMILAR) <= (n[rest] + n[i]) * (100 - SIMILAR)) & sizes_alike(n[rest], n[i])]
                if len(found):
                    hit[lo + i] = hit[lo + found] = True
    if hit.any():
        yield b.filter(pa.array(hit)).select(["g", "x", "y", "left", "v"])


def linked_forest(b: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each tile, a spanning forest of its similar pairs, judged by the whole sets."""
    get = lambda c: b.column(b.schema.get_field_index(c))
    v, left, grams = get("v").to_numpy(), get("left").to_numpy(zero_copy_only=False), get("grams")
    x, y = get("x").to_numpy(), get("y").to_numpy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo < 2:
            continue
        sets = [unpack_sorted(grams[i].as_py()) for i in range(lo, hi)]
        n = np.array([len(s) for s in sets])
        _, el = np.unique(np.concatenate(sets), return_inverse=True)
        of = np.repeat(np.arange(len(n)), n)
        first = np.concatenate([[0], np.cumsum(n)])
        by = np.argsort(el, kind="stable")
        owner, start = of[by], np.searchsorted(el[by], np.arange(int(el.max()) + 2))

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            mine = el[first[i] : first[i + 1]]  # noqa: B023
            at, m = start[mine], start[mine + 1] - start[mine]  # noqa: B023
            both = np.bincount(owner[np.repeat(at - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(n))[rest]  # noqa: B023
            return 100 * both >= SIMILAR * (n[i] + n[rest] - both)  # noqa: B023

        i, j = forest(hi - lo, near, None if x[lo] == y[lo] else left[lo:hi])
        if i:
            i, j = v[lo + np.array(i)], v[lo + np.array(j)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])


def number(chunk: str) -> int:
    """Chunk 'part-no' as the upper bits of its members' numbers."""
    part, no = map(int, chunk.split("-"))
    return part << 44 | no << 24


def sets_of(store: DataFrame, need: DataFrame) -> DataFrame:
    """need: v, chunk (distinct).  v, grams: the whole set of each."""

    def fetch(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        v = np.sort(got["need"]["v"].to_numpy())
        sets = Sets(c.subset(np.searchsorted(c.order, v)))
        return pa.table({"v": v, "grams": pa.array([pack_sorted(sets.s[sets.first[i] : sets.first[i + 1]]) for i in range(len(v))], pa.binary())})

    touched = store.join(need.select("chunk").distinct(), "chunk", "left_semi")
    return each_answered(touched, {"need": need}, fetch, "v long, grams binary")


def compare(edges: DataFrame, store: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges: a, b (vertices).  Those with 100 * intersection >= 80 * union, over the whole sets."""
    need = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().join(vertices.select("v", "chunk"), "v")
    grams = stored(sets_of(store, need))
    pairs = edges.join(grams.select(F.col("v").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("v").alias("b"), F.col("grams").alias("gb")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last, x = [], None, None
            for ga, gb in zip(b.column(2), b.column(3)):
                ga, gb = ga.as_py(), gb.as_py()
                if ga != last:
                    x, last = unpack_sorted(ga), ga
                y = unpack_sorted(gb)
                both = len(x) + len(y) - len(np.union1d(x, y))
                out.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            if out:
                ok = pa.array(out)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])
        tidy()

    with small_batches(edges.sparkSession, 256):
        linked = stored(pairs.select("a", "b", "ga", "gb").mapInArrow(judge, "a long, b long"))
    dropped(grams)
    return linked


def linked_in(grams: list[np.ndarray], left: np.ndarray, one_side: bool) -> np.ndarray:
    """For each set, the number of similar ones on the other side (`left` tells the sides), or of all others if `one_side`.

    Sets are held as differences from the majority's set, which keeps those of near copies short.
    """
    n = np.array([len(x) for x in grams])
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    of = np.repeat(np.arange(len(n)), n)
    often = np.bincount(at)
    most = 2 * often > len(n)
    usual = np.flatnonzero(most)
    rank = np.cumsum(most) - 1
    has = np.zeros(len(usual), bool)
    first = np.concatenate([[0], np.cumsum(n)])
    odd = []
    for i in range(len(n)):
        mine = at[first[i] : first[i + 1]]
        plain = most[mine]
        has[:] = False
        has[rank[mine[plain]]] = True
        odd.append(np.concatenate([mine[~plain], usual[~has]]))
    size = np.array([len(x) for x in odd])
    el, of = np.concatenate(odd), np.repeat(np.arange(len(n)), size)
    posted = np.flatnonzero(np.ones(len(of), bool) if one_side else ~left[of])
    posted = posted[np.argsort(el[posted], kind="stable")]
    start = np.searchsorted(el[posted], np.arange(len(often) + 1))
    owner, others = of[posted], np.arange(len(n)) if one_side else np.flatnonzero(~left)
    links = np.zeros(len(n), np.int64)
    for i in np.flatnonzero(left).tolist():
        lo, m = start[odd[i]], start[odd[i] + 1] - start[odd[i]]
        hits = owner[np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())]
        differ = size[i] + size[others] - 2 * np.bincount(hits, minlength=len(n))[others]
        alike = others[differ * (100 + SIMILAR) <= (n[i] + n[others]) * (100 - SIMILAR)]
        alike = alike[alike != i]
        links[i] += len(alike)
        if not one_side:
            links[alike] += 1
    return links


def count_links(labels: DataFrame, store: DataFrame, classes: DataFrame) -> DataFrame:
    """labels: v, label.  v, n_links: the other vertices of its component that are similar, each pair judged once, by the whole sets."""
    member = labels.join(classes.select("v", "chunk", "n"), "v")
    blocks = member.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("of"))
    need = stored(member.join(blocks, "label").select("v", "chunk", "label", F.expr("cast(pmod(xxhash64(v), of) as int)").alias("block"), "of"))
    grams = sets_of(store, need.select("v", "chunk")).join(need.drop("chunk"), "v")
    tiles = grams.select("v", "label", "block", "grams", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    tiles = tiles.select("v", "label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.expr("block <= other").alias("left"), "grams")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            links = linked_in([unpack_sorted(x[2]) for x in held], np.array([x[1] for x in held]), key[1] == key[2])
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array(links)], ["v", "k"])

        for b in batches:
            v, label, x, y, left, blobs = (c.to_pylist() for c in b.columns)
            for i in range(b.num_rows):
                if (label[i], x[i], y[i]) != key:
                    if held:
                        yield done()
                    key, held = (label[i], x[i], y[i]), []
                held.append((v[i], left[i], blobs[i]))
        if held:
            yield done()
        tidy()

    with small_batches(labels.sparkSession, 256):
        spread = tiles.repartition(partitions(labels.sparkSession), "label", "x", "y").sortWithinPartitions("label", "x", "y")
        counted = stored(spread.mapInArrow(count, "v long, k long").groupBy("v").agg(F.sum("k").alias("n_links")))
    dropped(need)
    return counted


def grouped(store: DataFrame, parts: int, total: int) -> DataFrame:
    """store: one document for each vertex, with the vertex as its id.  g, m, v: groups of vertices that share signatures.

    Keys of shingles and signatures are sent with as many bits as their number (about `total`) asks for and 12 or
    more besides.  Keys that fall together make one in some thousands of groups larger, or a shingle frequent, in the
    same way for all who have it: that costs a little and decides nothing.
    """
    bits = min(64, -(-(int(total).bit_length() + 12) // 8) * 8)
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))

    def shingles(c: Chunk) -> Iterator[pa.RecordBatch]:
        s, n = np.unique(Sets(c).s & mask, return_counts=True)
        yield bucket_rows(c.name, s, [n.astype(np.uint32)], parts)

    def often(inverse: np.ndarray, values: list[np.ndarray], chunk_no: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        return [(np.bincount(inverse, weights=values[0], minlength=len(starts)) >= FREQUENT)[inverse].astype(np.uint8)]

    flags = stored(exchange(each_chunk(store, shingles, buckets_schema(1)), parts, ["u4"], often, 1))
    cleaned(store.sparkSession)

    def send(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        sets = Sets(c)
        frequent = answers(got["flags"], 0, "u1") > 0
        rare = ~frequent[np.unique(sets.s & mask, return_inverse=True)[1]] if len(sets.s) else np.zeros(0, bool)
        keys, who = signatures(sets, rare)
        return pa.Table.from_batches([bucket_rows(c.name, keys & mask, [(c.order[who] - number(c.name)).astype(np.uint32)], parts)])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        keys = np.concatenate([unpack_sorted(x) for x in t["keys"].to_pylist()])
        who = np.concatenate([from_planes(x, "u4").astype(np.int64) + number(c) for x, c in zip(t["v0"].to_pylist(), t["chunk"].to_pylist())])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        lone = new & np.concatenate([new[1:], [True]])
        keys, who = keys[~lone], who[order[~lone]]
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
        keys, who = keys[new], who[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return
        size = np.diff(np.append(first, len(keys)))
        # signatures of the same vertices are one group
        marks = np.add.reduceat(mix(who.view(np.uint64)), first)
        _, one = np.unique(marks, return_index=True)
        one = one[size[one] > 1]
        for lo in range(0, len(one), 4096):
            pick = one[lo : lo + 4096]
            n = size[pick]
            at = np.repeat(first[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(marks[pick].view(np.int64), n)), pa.array(np.repeat(n, n)), pa.array(who[at])], ["g", "m", "v"])
        del t, keys, who, order, new
        tidy()

    sent = each_answered(store, {"flags": flags}, send, buckets_schema(1))
    found = stored(sent.repartitionById(parts, F.col("bucket")).mapInArrow(groups, "g long, m long, v long"))
    dropped(flags)
    return found


def linked_components(store: DataFrame, vertices: DataFrame, parts: int) -> DataFrame:
    """v, label: the least vertex of each component of similar sets, for all vertices that have a link."""
    tiles = in_tiles(found := grouped(store, parts, vertices.agg(F.sum("n")).first()[0] or 0)).join(vertices.select("v", "n", "sketch"), "v").select("g", "x", "y", "left", "m", "v", "n", "sketch")
    few = FEW
    edges = stored(each_tile(tiles, lambda b, bounds: candidates(b, bounds, few), "a long, b long").distinct())
    links = compare(edges, store, vertices)
    dropped(edges)
    labels = components(links)
    # large groups gave a forest only; what passes across components is judged by the whole sets
    label = F.coalesce("label", "v").alias("label")
    rest = tiles.filter(F.col("m") > few).join(labels, "v", "left").select("g", "x", "y", "left", "v", "n", "sketch", label)
    rest = stored(each_tile(rest, still_open, "g long, x int, y int, left boolean, v long"))
    if not rest.isEmpty():
        grams = stored(sets_of(store, rest.select("v").distinct().join(vertices.select("v", "chunk"), "v")))
        with small_batches(store.sparkSession, 256):
            more = stored(each_tile(rest.join(grams, "v").select("g", "x", "y", "left", "v", "grams"), linked_forest, "a long, b long").distinct())
        links, before = stored(links.unionByName(more)), links
        dropped(before, more, grams, labels)
        labels = components(links)
    dropped(rest, links, found)
    return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, if `links`, n_links (how many other sets are similar to the document's)."""
    parts = partitions(docs.sparkSession)
    whole = chunked(docs, doc_id, text, CHUNK)

    def describe(c: Chunk) -> Iterator[pa.RecordBatch]:
        sets, base = Sets(c), number(c.name)
        cols = [c.ids, pa.array(c.order), pa.array(sets.n), pa.array(sets.id1.view(np.int64)), pa.array(sets.id2.view(np.int64)), pa.array(base + sets.member), pa.array([c.name] * len(c.ids)), pa.array(sketches(sets), pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ord", "n", "id1", "id2", "member", "chunk", "sketch"])

    rows = stored(each_chunk(whole, describe, "doc_id long, ord long, n long, id1 long, id2 long, member long, chunk string, sketch binary"))
    # one vertex for equal sets: the smallest member number
    classes = rows.filter("n > 0").groupBy("id1", "id2").agg(F.min(F.struct("member", "chunk")).alias("m"), F.min("ord").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select("id1", "id2", F.col("m.member").alias("v"), F.col("m.chunk").alias("chunk"), "least", "n", "sketch"))
    vertices = classes.select("v", "chunk", "n", "sketch")

    def one_each(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        v = np.sort(got["own"]["v"].to_numpy())
        return packed(c.subset(v - number(c.name)), pa.array(v))

    store = stored(each_answered(whole, {"own": vertices.select("v", "chunk")}, one_each, CHUNKS))
    dropped(whole)
    labels = linked_components(store, vertices, parts)
    label = classes.drop("sketch").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = label.groupBy("label").agg(F.min("least").alias("component"))
    done = label.join(least, "label").select("id1", "id2", "component", "v")
    if links:
        done = done.join(counted := count_links(labels, store, classes), "v", "left")
    done = stored(done.drop("v"))
    dropped(store, classes, labels, *([counted] if links else []))
    out = rows.select("doc_id", "ord", "n", "id1", "id2").join(done, ["id1", "id2"], "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("ord"))
    counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component != _NULL, component).alias("component_id"), *counts)
