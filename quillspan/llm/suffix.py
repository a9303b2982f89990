"""Suffix-array deduplication with the difference-cover algorithm.

The question is which strings of `window` bytes occur in two documents.  Each window has a least-hash gram
(its minimizer), and equal windows have equal ones; windows whose minimizer stands in one document only are set
aside first, without loss.  Neighbouring windows with the same minimizer are one piece of text, some 80 bytes.
A chunk sends each distinct piece once, with its smallest document, to the bucket of its minimizer, so that all
windows which might be equal meet in one bucket.  Hashes only choose the bucket: what is equal is decided there, by
sorting all suffixes of the bucket's text that begin a window.  Minimizers that stand in very many pieces have their
windows dealt to the buckets one by one, by the window's own hash.

A bucket's text is sorted by difference cover (`sorted_windows`).  A symbol is a third of the window (17 bytes).
Suffixes are split by the number of their first symbol modulo 3.  Those at 1 and 2 are the sample: their triples of
symbols are sorted and named; the triples reach over the window, so there is no recursion.  Those at 0 are merged in,
compared by (symbol, rank) with those at 1 and by (symbol, symbol, rank) with those at 2.  In the resulting order,
neighbours whose first `window` bytes are equal, symbol by symbol, form a group, and a window of the group is a
duplicate if the group has a smaller document.  One bit for each window goes back to its chunk.

`suffix_ranks` sorts the suffixes of any pieces over the whole cluster instead, with symbols of WIDTH bytes and one
recursion: by ranges of the first symbol or name, where each chunk sends each distinct triple once.

Defined results: null text has 0 bytes; texts shorter than a window lose nothing; rows with equal ids do not
remove each other's bytes; a null id counts as the largest and stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, answers, bucket_rows, buckets_schema, chunked, cleaned, covered, each_answered, each_chunk, exchange, from_planes, mix, partitions, planes, several_documents, sliding_min, stored, tidy, window_ok

WINDOW, GRAM, WIDTH = 50, 16, 6
CHUNK = 4 << 20
#: Bytes of documents for each bucket.
BUCKET = 4 << 20
#: Pieces with one minimizer beyond which its windows are dealt one by one.
HOT = 1 << 15
#: Windows of one piece, about, where its minimizer is repeated.
MOST = 512
#: Places whose minimizers are found at once.
BLOCK = 1 << 15
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64((1 << 32) - 1)


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _grams(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Hash of each gram, of its first and last eight bytes."""
    x = head * _A
    x ^= x >> np.uint64(29)
    x += tail
    x *= _B
    x ^= x >> np.uint64(32)
    x *= _A
    return x


class Pieces:
    """Runs of neighbouring windows of a chunk that have their minimizer in common: first place, number of windows, text
    (number in the chunk), and hash of the minimizer, of each."""

    def __init__(self, c: Chunk, window: int) -> None:
        n = len(c.data) - window + 1
        ok = np.zeros(max(n, 0), bool)
        for i, j in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist()):
            if j - i >= window:
                ok[i : j - window + 1] = True
        place = np.empty(len(ok), np.int32)
        for at in range(0, len(ok), BLOCK):  # what is at hand stays in the processor's cache
            stop = min(at + BLOCK, len(ok))
            block = np.ascontiguousarray(_blocks(c.data[at : stop + window - 1]))
            x = _grams(block[: 8 - GRAM], block[GRAM - 8 :])
            # the first of equal grams counts
            x &= ~_LOW
            x |= np.arange(at, at + len(x), dtype=np.uint64)
            place[at:stop] = sliding_min(x, window - GRAM + 1) & _LOW
        new, end = ok.copy(), ok.copy()
        same = place[1:] == place[:-1]
        new[1:] &= ~(same & ok[:-1])
        end[:-1] &= ~(same & ok[1:])
        self.start = np.flatnonzero(new)
        self.size = np.flatnonzero(end) - self.start + 1
        first = place[self.start].astype(np.int64)
        self.key = np.zeros(0, np.uint64)
        if len(first):
            block = _blocks(c.data)
            self.key = mix(_grams(block[first], block[first + GRAM - 8]))
            self._joined()
        self.doc = np.searchsorted(c.offsets, self.start, "right") - 1

    def _joined(self) -> None:
        """Neighbours of one minimizer as one piece, if it stands there again and again, as in a line of one letter."""
        new = np.ones(len(self.start), bool)
        new[1:] = (self.start[1:] != self.start[:-1] + self.size[:-1]) | (self.key[1:] != self.key[:-1])
        if new.all():
            return
        begin = self.start[new]
        step = (self.start - begin[np.cumsum(new) - 1]) // MOST
        new[1:] |= step[1:] != step[:-1]
        first = np.flatnonzero(new)
        self.start, self.size, self.key = self.start[first], np.add.reduceat(self.size, first), self.key[first]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct minimizers, whether each stands in several texts, and its number of pieces."""
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], self.doc[order]
        if not len(key):
            return key, np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        # texts ascend within a minimizer's pieces
        last = np.append(first[1:], len(key)) - 1
        return key[first], (doc[first] != doc[last]).astype(np.uint8), np.diff(np.append(first, len(key))).astype(np.uint32)


class Sent:
    """What a chunk sends: its distinct candidate pieces by bucket, each with its smallest document; and which of them each
    candidate piece of the chunk is."""

    def __init__(self, c: Chunk, window: int, flags: np.ndarray, parts: int) -> None:
        p = Pieces(c, window)
        keys, which = np.unique(p.key, return_inverse=True)
        flag = flags[which] if len(keys) else np.zeros(0, np.uint8)
        keep = np.flatnonzero(flag == 1)
        self.start, self.size, key, doc = p.start[keep], p.size[keep], p.key[keep], p.doc[keep]
        hot = np.flatnonzero(flag == 2)
        if len(hot):  # a piece for each window
            n = p.size[hot]
            at = np.repeat(p.start[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            raw = c.data.tobytes()
            own = np.fromiter((int.from_bytes(hashlib.blake2b(raw[i : i + window], digest_size=8).digest(), "little") for i in at.tolist()), np.uint64, len(at))
            self.start, self.size = np.append(self.start, at), np.append(self.size, np.ones(len(at), np.int64))
            key, doc = np.append(key, own), np.append(doc, np.repeat(p.doc[hot], n))
        self.order = c.order[doc]
        raw = c.data.tobytes()
        texts: dict[bytes, int] = {}
        piece = np.array([texts.setdefault(raw[i:j], len(texts)) for i, j in zip(self.start.tolist(), (self.start + self.size + window - 1).tolist())], np.int64)
        # the smallest document of each text
        order = np.lexsort((self.order, piece))
        one = order[np.flatnonzero(np.diff(piece[order], prepend=-1))]
        bucket = ((key[one] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.piece = back[piece]
        self.least, self.windows, self.bucket = self.order[one][by], self.size[one][by], bucket[by]
        self.texts = list(texts)
        self.by = by.tolist()

    def rows(self, chunk: str) -> pa.RecordBatch:
        import zstandard

        full, first = np.unique(self.bucket, return_index=True)
        cut = np.append(first, len(self.bucket)).tolist()
        part = list(zip(cut[:-1], cut[1:]))
        squeeze = zstandard.ZstdCompressor(level=1)
        text = [squeeze.compress(b"".join([self.texts[k] for k in self.by[i:j]])) for i, j in part]
        cols = [text, [planes(self.windows[i:j].astype(np.uint16)) for i, j in part], [planes(self.least[i:j]) for i, j in part]]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.string()), *(pa.array(x, pa.binary()) for x in cols)], ["bucket", "chunk", "keys", "v0", "v1"])

    def gone(self, t: pa.Table) -> np.ndarray:
        """Starts of the windows that also start in a smaller document; t: the buckets' answers."""
        if not t.num_rows:
            return np.zeros(0, np.int64)
        bits, n = t["bits"].to_pylist(), np.bincount(self.bucket, weights=self.windows).astype(np.int64)
        bucket = t["bucket"].to_pylist()
        hit = np.concatenate([np.unpackbits(np.frombuffer(bits[j], np.uint8), count=int(n[bucket[j]])) for j in np.argsort(bucket)]).astype(bool)
        before = np.cumsum(self.windows) - self.windows
        step = np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        at = np.repeat(self.start, self.size) + step
        return at[hit[np.repeat(before[self.piece], self.size) + step] | np.repeat(self.order > self.least[self.piece], self.size)]


# ---------------------------------------------------------------- sorting a bucket by difference cover


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and which of them (in that order) differ from the one before."""
    bits = max(len(key) - 1, 1).bit_length()
    if int(key.max(initial=0)).bit_length() + bits <= 64:  # sorting numbers is several times faster than sorting places
        both = (key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << bits) - 1)).view(np.int64)
        both >>= np.uint64(bits)
    else:
        order = np.argsort(key)
        both = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    return order, new


def _dense(key: np.ndarray) -> np.ndarray:
    """The number of smaller distinct keys, for each."""
    order, new = _order(key)
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return out


def _joined(*columns: np.ndarray) -> np.ndarray:
    """Tuples of integers as one integer each, in the same order; with room for a place beside it, where that can be had."""
    room = 64 - max(len(columns[0]) - 1, 1).bit_length()
    out = columns[0].astype(np.uint64)
    for x in columns[1:]:
        bits = int(x.max(initial=0)).bit_length()
        if int(out.max(initial=0)).bit_length() + bits > room:
            out = _dense(out).astype(np.uint64)
        out <<= np.uint64(bits)
        out |= x
    return out


def _symbols(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of the `width` bytes from each place on, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
    n, have = len(data), min(width, 5)
    rank = _dense(np.ndarray((n + width,), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * have))
    while have < width:
        step = min(have, width - have)
        rank = _dense(_joined(rank[:-step], rank[step:]))
        have += step
    return rank[:n]


def sorted_windows(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows at places `at` (ascending) in the order of the suffixes that begin there, and which of them
    (in that order) differ in their `window` bytes from the one before."""
    width = -(-window // 3)
    n = -(-len(data) // (3 * width)) * 3 * width
    sym, rank = (np.zeros(n + 3 * width, np.uint32) for _ in range(2))
    sym[: len(data)] = _symbols(data, width)
    sample = lambda x, step: x[step : step + n].reshape(-1, 3 * width)[:, width:]
    triples = _joined(*(sample(sym, k * width).reshape(-1) for k in range(3)))
    sample(rank, 0)[:] = _dense(triples).reshape(-1, 2 * width)
    del triples
    cls = at // width % 3
    is0, is1, is2 = (np.flatnonzero(cls == k) for k in range(3))
    total = np.zeros(len(at), np.int64)
    # the sample among itself
    total[cls > 0] = _smaller(rank[at[cls > 0]])
    # those at 0 among themselves and against those at 1, then against those at 2
    p = at[np.concatenate([is0, is1])]
    key = _joined(sym[p], rank[p + width])
    zero, one = key[: len(is0)], key[len(is0) :]
    total[is0] = _smaller(zero) + _below(one, zero)
    total[is1] += _below(zero, one)
    p = at[np.concatenate([is0, is2])]
    key = _joined(sym[p], sym[p + width], rank[p + 2 * width])
    zero, two = key[: len(is0)], key[len(is0) :]
    total[is0] += _below(two, zero)
    total[is2] += _below(zero, two)
    order, _ = _order(total)
    p = at[order]
    new = np.ones(len(p), bool)
    new[1:] = False
    for step in (0, width, window - width):
        s = sym[p + step]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _smaller(key: np.ndarray) -> np.ndarray:
    """How many keys are smaller, for each."""
    order, new = _order(key)
    first = np.flatnonzero(new)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(first, np.diff(np.append(first, len(key))))
    return out


def _below(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of the keys are less than each of `of`."""
    order, _ = _order(of)
    out = np.empty(len(of), np.int64)
    out[order] = np.searchsorted(np.sort(keys), of[order])
    return out


def decide(t: pa.Table, window: int) -> pa.Table:
    """For each row of pieces (as Sent.rows() makes them) a bit for each window: does it also start in a smaller document?"""
    import zstandard

    squeeze = zstandard.ZstdDecompressor()
    size = [from_planes(x, "u2").astype(np.int64) for x in t["v0"].to_pylist()]
    n_row = np.array([len(x) for x in size])
    size = np.concatenate(size)
    doc = np.concatenate([from_planes(x, "i8") for x in t["v1"].to_pylist()])
    raw = b"".join([squeeze.decompress(x) for x in t["keys"].to_pylist()])
    end = np.cumsum(size + window - 1)
    texts: dict[bytes, int] = {}
    piece = np.array([texts.setdefault(raw[i:j], len(texts)) for i, j in zip([0, *end[:-1].tolist()], end.tolist())], np.int64)
    order = np.lexsort((doc, piece))
    one = order[np.flatnonzero(np.diff(piece[order], prepend=-1))]
    raw = b"".join(texts)
    del texts, order
    n, least = size[one], doc[one]
    begin = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat((window - 1) * np.arange(len(n)), n)
    order, new = sorted_windows(np.frombuffer(raw, np.uint8), at, window)
    group = np.flatnonzero(new)
    smallest = np.empty(len(at), np.int64)
    smallest[order] = np.minimum.reduceat(np.repeat(least, n)[order], group)[np.cumsum(new) - 1]
    # every sent piece's windows against its own document
    each = np.repeat(begin[piece] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    hit = smallest[each] < np.repeat(doc, size)
    cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_row)])].tolist()
    bits = pa.array([np.packbits(hit[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
    return pa.table({"bucket": t["bucket"], "chunk": t["chunk"], "bits": bits})


# ---------------------------------------------------------------- sorting over the cluster by difference cover


def _key(*words: np.ndarray) -> np.ndarray:
    """Triples of integers, a column each."""
    out = np.zeros((3, len(words[0])), np.uint64)
    for i, x in enumerate(words):
        out[i] = x
    return out


def _distinct_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct triples, and which of them each is."""
    order = np.lexsort(key[::-1])
    new = np.ones(len(order), bool)
    ordered = key[:, order]
    new[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(0)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[:, new], back


def _sent(chunk: str, key: np.ndarray, kind: np.ndarray, bucket_of) -> pa.RecordBatch:  # noqa: ANN001
    """Distinct keys with their numbers of each kind (0, 1), by bucket."""
    uniq, back = _distinct_keys(key)
    n0, n1 = (np.bincount(back[kind == k], minlength=uniq.shape[1]).astype(np.uint32) for k in (0, 1))
    b = bucket_of(uniq[0])
    full, first = np.unique(b, return_index=True)
    cut = np.append(first, len(b))
    part = [slice(cut[i], cut[i + 1]) for i in range(len(full))]
    keys = [b"".join(planes(np.ascontiguousarray(uniq[w, p])) for w in range(3)) for p in part]
    counts = [[planes(np.ascontiguousarray(x[p])) for p in part] for x in (n0, n1)]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.string()), *(pa.array(x, pa.binary()) for x in (keys, *counts))], ["bucket", "chunk", "keys", "v0", "v1"])


def _unpack_keys(blob: bytes) -> np.ndarray:
    n = len(blob) // 3
    return np.stack([from_planes(blob[w * n : (w + 1) * n], "u8") for w in range(3)])


def count_smaller(rows: DataFrame, buckets: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Sorts all keys; for each that was sent, how many of kind 0 and of kind 1 are smaller (within its bucket; the
    second result has those of all buckets before)."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        keys = [_unpack_keys(x) for x in t["keys"].to_pylist()]
        cut = np.concatenate([[0], np.cumsum([k.shape[1] for k in keys])])
        uniq, back = _distinct_keys(np.concatenate(keys, axis=1))
        less, total = [], []
        for v in ("v0", "v1"):
            n = np.bincount(back, weights=np.concatenate([from_planes(x, "u4") for x in t[v].to_pylist()]), minlength=uniq.shape[1]).astype(np.int64)
            less.append((np.cumsum(n) - n)[back])
            total.append(int(n.sum()))
        cols = [t["bucket"].combine_chunks(), t["chunk"].combine_chunks()]
        cols += [pa.array([planes(np.ascontiguousarray(x[a:b])) for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for x in less]
        cols += [pa.array([n] * t.num_rows) for n in total]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "a0", "a1", "t0", "t1"])

    out = stored(rows.repartitionById(buckets, F.col("bucket")).mapInArrow(sort, "bucket int, chunk string, a0 binary, a1 binary, t0 long, t1 long"))
    before, a, b = {}, 0, 0
    for r in out.groupBy("bucket").agg(F.first("t0").alias("t0"), F.first("t1").alias("t1")).orderBy("bucket").collect():  # one row per bucket
        before[r.bucket] = (a, b)
        a, b = a + r.t0, b + r.t1
    return out.drop("t0", "t1"), before


def _less(t: pa.Table, before: dict[int, tuple[int, int]], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What count_smaller() found for each of a chunk's keys."""
    if not key.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = t["bucket"].to_pylist()
    order = np.argsort(bucket)
    back = _distinct_keys(key)[1]
    out = []
    for i in (0, 1):
        blobs = t[f"a{i}"].to_pylist()
        out.append(np.concatenate([from_planes(blobs[j], "i8") + before[bucket[j]][i] for j in order])[back])
    return out[0], out[1]


class Suffixes:
    """All suffixes of a chunk's pieces, and the steps of the difference-cover sort."""

    def __init__(self, c: Chunk) -> None:
        n = len(c.data)
        self.end = np.repeat(c.offsets[1:], np.diff(c.offsets))
        self.i = np.arange(n)
        local = self.i - np.repeat(c.offsets[:-1], np.diff(c.offsets))
        self.sym = np.zeros(n, np.uint64)
        for t in range(WIDTH):
            self.sym |= self.ahead(c.data.astype(np.uint64), t) << np.uint64(8 * (WIDTH - 1 - t))
        self.cls, self.cls1 = local // WIDTH % 3, local // (3 * WIDTH) % 3
        self.sample = self.cls > 0

    def ahead(self, x: np.ndarray, by: int) -> np.ndarray:
        """x at the place `by` bytes on, 0 beyond the piece."""
        to = self.i + by
        ok = to < self.end
        out = np.zeros_like(x)
        out[ok] = x[to[ok]]
        return out

    def put(self, where: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.i), np.int64)
        out[where] = values
        return out

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.sample)
        return at, _key(self.sym[at], self.ahead(self.sym, WIDTH)[at], self.ahead(self.sym, 2 * WIDTH)[at])

    def name_triples(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.sample & (self.cls1 > 0))
        return at, _key(name[at], self.ahead(name, 3 * WIDTH)[at], self.ahead(name, 6 * WIDTH)[at])

    def merge_keys(self, symbol: np.ndarray, rank: np.ndarray, cls: np.ndarray, among: np.ndarray, step: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, keys and kinds (1: of the sample) of the suffixes at 0 and those at `other` (1 or 2)."""
        at = np.flatnonzero(among & ((cls == 0) | (cls == other)))
        if other == 1:
            key = _key(symbol[at], self.ahead(rank, step)[at])
        else:
            key = _key(symbol[at], self.ahead(symbol, step)[at], self.ahead(rank, 2 * step)[at])
        return at, key, (cls[at] == other).astype(np.int8)


def suffix_ranks(pieces: DataFrame, parts: int):  # noqa: ANN201
    """Sorts all suffixes of the pieces.  Gives the exchanges' answers, and what makes a chunk's ranks of them."""

    def sample(c: Chunk) -> Iterator[pa.RecordBatch]:
        s = Suffixes(c).sym
        yield pa.RecordBatch.from_arrays([pa.array(np.sort(s)[:: max(1, len(s) // each)].astype(np.int64))], ["s"])

    each = max(2, 40 * parts // max(1, pieces.count()))
    seen = np.sort(each_chunk(pieces, sample, "s long").toPandas().s.to_numpy().astype(np.uint64))  # about 40 for each bucket
    edges = np.unique(seen[np.linspace(0, len(seen) - 1, parts + 1).astype(int)[1:-1]]) if len(seen) else np.zeros(0, np.uint64)
    by_symbol = lambda a: np.searchsorted(edges, a, "right")
    back: dict[str, DataFrame] = {}
    before: dict[str, dict] = {}
    schema = "bucket int, chunk string, keys binary, v0 binary, v1 binary"

    def names(s: Suffixes, got: dict[str, pa.Table]) -> np.ndarray:
        at, key = s.triples()
        return s.put(at, 1 + _less(got["name"], before["name"], key)[0])

    def ranks(s: Suffixes, got: dict[str, pa.Table], symbol: np.ndarray, rank: np.ndarray, cls: np.ndarray, among: np.ndarray, step: int, one: str, two: str) -> np.ndarray:
        """1 + the number of smaller suffixes, of all that are merged."""
        a1, k1, _ = s.merge_keys(symbol, rank, cls, among, step, 1)
        a2, k2, _ = s.merge_keys(symbol, rank, cls, among, step, 2)
        zero1, own1 = (s.put(a1, x) for x in _less(got[one], before[one], k1))
        zero2, own2 = (s.put(a2, x) for x in _less(got[two], before[two], k2))
        total = np.where(cls == 0, zero1 + own1 + own2, rank - 1 + np.where(cls == 1, zero1, zero2)) + 1
        return np.where(among, total, 0)

    def level1(s: Suffixes, got: dict[str, pa.Table]) -> np.ndarray:
        name = names(s, got)
        at, key = s.name_triples(name)
        return s.put(at, 1 + _less(got["again"], before["again"], key)[0])

    def sampled(s: Suffixes, got: dict[str, pa.Table]) -> np.ndarray:
        return ranks(s, got, names(s, got), level1(s, got), s.cls1, s.sample, 3 * WIDTH, "one", "two")

    def final(s: Suffixes, got: dict[str, pa.Table]) -> np.ndarray:
        return ranks(s, got, s.sym.astype(np.int64), sampled(s, got), s.cls, np.ones(len(s.i), bool), WIDTH, "last_one", "last_two")

    def first(c: Chunk) -> Iterator[pa.RecordBatch]:
        _, key = Suffixes(c).triples()
        yield _sent(c.name, key, np.zeros(key.shape[1], np.int8), by_symbol)

    back["name"], before["name"] = count_smaller(each_chunk(pieces, first, schema), parts)
    n_sample = _total(pieces)
    width = max(1, -(-(n_sample + 1) // parts))
    by_name = lambda a: np.minimum(a.astype(np.int64) // width, parts - 1)

    def second(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        s = Suffixes(c)
        _, key = s.name_triples(names(s, got))
        return pa.Table.from_batches([_sent(c.name, key, np.zeros(key.shape[1], np.int8), by_name)])

    back["again"], before["again"] = count_smaller(each_answered(pieces, back, second, schema), parts)

    def merge(other: int, last: bool):  # noqa: ANN202
        def run(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
            s = Suffixes(c)
            if last:
                _, key, kind = s.merge_keys(s.sym.astype(np.int64), sampled(s, got), s.cls, np.ones(len(s.i), bool), WIDTH, other)
            else:
                _, key, kind = s.merge_keys(names(s, got), level1(s, got), s.cls1, s.sample, 3 * WIDTH, other)
            return pa.Table.from_batches([_sent(c.name, key, kind, by_symbol if last else by_name)])

        return run

    for last, pair in ((False, ("one", "two")), (True, ("last_one", "last_two"))):
        found = {}
        for other, name in zip((1, 2), pair):
            found[name], before[name] = count_smaller(each_answered(pieces, dict(back), merge(other, last), schema), parts)
        back |= found
    return back, final


def _total(pieces: DataFrame) -> int:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(from_planes(x, "i8")[-1]) for b in batches for x in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return pieces.select("offsets").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0


# ---------------------------------------------------------------- the operator


def deduplicate(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, n_bytes)."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} bytes at least")
    spark = docs.sparkSession
    store = chunked(docs, doc_id, text, CHUNK)
    parts = max(partitions(spark), -(-store.count() * CHUNK // BUCKET))

    def minimizers(c: Chunk) -> Iterator[pa.RecordBatch]:
        keys, multi, n = Pieces(c, window).keys()
        yield bucket_rows(c.name, keys, [multi, n], parts)

    def shared(inverse: np.ndarray, values: list[np.ndarray], chunk_no: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        several = several_documents(values[0], chunk_no, inverse, starts)
        hot = np.bincount(inverse, weights=values[1], minlength=len(starts)) > HOT
        return [(several * (1 + hot))[inverse].astype(np.uint8)]

    flags = stored(exchange(each_chunk(store, minimizers, buckets_schema(2)), parts, ["u1", "u4"], shared, 1))
    cleaned(spark)

    def send(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        return pa.Table.from_batches([Sent(c, window, answers(got["flags"], 0, "u1"), parts).rows(c.name)])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from decide(pa.Table.from_batches(held), window).combine_chunks().to_batches()
        tidy()

    sent = each_answered(store, {"flags": flags}, send, "bucket int, chunk string, keys binary, v0 binary, v1 binary")
    gone = stored(sent.repartitionById(parts, F.col("bucket")).mapInArrow(sort, "bucket int, chunk string, bits binary"))
    cleaned(spark)

    def rewrite(c: Chunk, got: dict[str, pa.Table]) -> pa.Table:
        flag = np.zeros(max(len(c.data) - window + 1, 0), bool)
        flag[Sent(c, window, answers(got["flags"], 0, "u1"), parts).gone(got["gone"])] = True
        drop = covered(flag, window, len(c.data))
        edge = np.zeros(len(c.data) + 1, bool)
        edge[: len(drop)] = drop
        edge[1:-1] &= ~drop[:-1]
        edge[c.offsets[:-1]] |= np.append(drop, False)[c.offsets[:-1]]
        start = np.flatnonzero(edge[:-1])
        step = np.concatenate([[0], np.cumsum(drop)])
        size, n_gone = np.diff(c.offsets), step[c.offsets[1:]] - step[c.offsets[:-1]]
        kept = memoryview(c.data[~drop].tobytes())
        to = np.concatenate([[0], np.cumsum(size - n_gone)]).tolist()
        sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:])]
        by = np.searchsorted(start, c.offsets)
        back_ = np.ones(len(c.data) + 1, bool)
        back_[: len(drop)] = ~drop
        back_[c.offsets] = True
        stop = np.flatnonzero(back_)
        length = stop[np.searchsorted(stop, start, "right")] - start
        local = start - np.repeat(c.offsets[:-1], np.diff(by))
        spans = pa.ListArray.from_arrays(pa.array(by, pa.int32()), pa.StructArray.from_arrays([pa.array(local), pa.array(length)], ["start", "n_bytes"]))
        return pa.Table.from_arrays([c.ids, pa.array(size), pa.array(n_gone), pa.array(np.diff(by)), pa.array(sha, pa.string()), spans], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return each_answered(store, {"flags": flags, "gone": gone}, rewrite, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, n_bytes: long>>")
