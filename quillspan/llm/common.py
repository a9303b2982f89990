"""Shared pieces of the training-data operators: scratch tables, word spans and hashes, packed exchanges.

Text is handled as whole UTF-8 buffers inside Arrow batches.  Words are found and hashed with numpy over
those buffers, a *chunk* of documents (a few MB of text) at a time, and what crosses a shuffle is one
packed binary per (chunk, bucket) instead of one row per word.  A chunk sends each distinct key once, so
a key that a third of all rows share weighs no more in its bucket than any other key.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files whose numbers are broadcast (some 200 bytes each).
FEW_FILES = 50_000
#: Bytes of text that make one chunk.
CHUNK_BYTES = 4 << 20
#: What a row weighs in a chunk besides its text, so that the number of rows of a chunk is bounded.
ROW_BYTES = 16
#: Bytes of text whose keys one bucket of an exchange takes.
BUCKET_BYTES = 16 << 20

SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of the contamination rule: digits, ASCII letters and everything beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x80:] = True
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_R, _M = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_K3 = np.uint64(0x9FB21C651E98DF25)
#: The first n bytes of a block, by n.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        size = 1 << max(17, int(n - 1).bit_length())
        step = np.full(size, pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        step[0] = 1
        have = _POWERS[base, inverse] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K1
    h = (h ^ (h >> np.uint64(29))) * _K2
    return h ^ (h >> np.uint64(32))


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroups batches into tables of about `limit` bytes of text; a longer text is a table of its own.

    A row counts as some bytes more than its text, so tables of empty texts end, too.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        offsets = offsets + np.arange(len(offsets)) * ROW_BYTES
        at = 0
        while at < batch.num_rows:
            room = max(limit - size, 0)
            end = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
            if end <= at:
                if held:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
                end = at + 1
            held.append(batch.slice(at, end - at))
            size += int(offsets[end] - offsets[at])
            at = end
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (one more entry than documents)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    word = kind[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = word[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word: its blocks of eight bytes, each mixed into what the ones before gave, so that no rule of
    arithmetic makes two words equal; words of more than 64 bytes by a digest."""
    size = ends - starts
    raw = np.concatenate([LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = mix(size.astype(np.uint64) * _K3 + np.uint64(_R))
    for j in range(LONG_WORD // 8):
        at = np.flatnonzero((size > 8 * j) & (size <= LONG_WORD))
        if not len(at):
            break
        block = blocks[starts[at] + 8 * j] & _HEADS[np.minimum(size[at] - 8 * j, 8)]
        h[at] = mix((h[at] ^ block) * _K3 + np.uint64(_R))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def windows(h: np.ndarray, k: int, base: int = _M) -> np.ndarray:
    """Hash of every run of k entries of h (documents are not minded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = h[:n].copy()
        for j in range(1, k):
            out = out * np.uint64(base) + h[j : j + n]
        return mix(out)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=run[1:])
    return mix((run[k:] - run[:n]) * powers(base, n, True))


def window_ok(counts: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k entries stay within one document; counts: entries before each document."""
    n = int(counts[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(counts[1:], np.diff(counts))[:n]
    return np.arange(k, n + k) <= end


def covered(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Entries that lie in a flagged run of k entries."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + k, n), -1)
    return np.cumsum(step[:-1]) > 0


# ---------------------------------------------------------------- packed arrays


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte planes of their differences, which the shuffle's compression then shrinks."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from one bucket (an equal range of the 64-bit space) to the next."""
    width = (1 << 64) // buckets + 1
    edges = np.array([b * width for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def bucket_rows(chunk: str, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row per bucket that gets any: bucket, chunk, keys and each of the value arrays."""
    cut = bucket_cuts(keys, buckets)
    full = np.flatnonzero(np.diff(cut))
    cols = [pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.string()), pa.array([pack_sorted(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary())]
    cols += [pa.array([planes(np.ascontiguousarray(v[cut[b] : cut[b + 1]])) for b in full], pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "keys", *(f"v{i}" for i in range(len(values)))])


def buckets_schema(n: int) -> str:
    return "bucket int, chunk string, keys binary" + "".join(f", v{i} binary" for i in range(n))


def tidy() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and what they keep counts."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(store: DataFrame, limit: int) -> int:
    """Number of buckets of an exchange between the chunks of `limit` bytes at most: it follows the text's size, so that a bucket's does not."""
    return max(partitions(store.sparkSession), -(-store.count() * limit // BUCKET_BYTES))


Answer = Callable[[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]


def exchange(rows: DataFrame, n_buckets: int, dtypes: list[str], answer: Answer, n_out: int) -> DataFrame:
    """Brings equal keys of all chunks together and answers each chunk.

    rows: as bucket_rows() makes them.  answer(inverse, values, chunk_no, group_starts) gets all entries of a
    bucket, `inverse` naming the group of equal keys of each, and returns n_out arrays with an entry each; they
    go back per (chunk, bucket) in the order in which the chunk sent its keys.  One bucket is one task.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        sizes = np.array([len(k) for k in keys])
        values = [np.concatenate([from_planes(x, t) for x in table[f"v{i}"].to_pylist()]) for i, t in enumerate(dtypes)]
        allk = np.concatenate(keys)
        del keys
        order = np.argsort(allk, kind="stable")
        new = np.ones(len(allk), bool)
        np.not_equal(allk[order][1:], allk[order][:-1], out=new[1:])
        inverse = np.empty(len(allk), np.int64)
        inverse[order] = np.cumsum(new) - 1
        del allk, order
        outs = answer(inverse, values, np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(new))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        bucket, chunk = table["bucket"], table["chunk"]
        for lo in range(0, len(sizes), 64):
            hi = min(lo + 64, len(sizes))
            cols = [bucket.slice(lo, hi - lo).combine_chunks(), chunk.slice(lo, hi - lo).combine_chunks()]
            cols += [pa.array([planes(np.ascontiguousarray(o[cut[r] : cut[r + 1]])) for r in range(lo, hi)], pa.binary()) for o in outs]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", *(f"a{i}" for i in range(n_out))])
        del table, values, inverse, outs, cols
        tidy()

    spread = rows.repartitionById(n_buckets, F.col("bucket"))
    return spread.mapInArrow(reduce, "bucket int, chunk string" + "".join(f", a{i} binary" for i in range(n_out)))


def answers(table: pa.Table, i: int, dtype: str) -> np.ndarray:
    """The answers of one chunk in the order of its sorted keys."""
    if not table.num_rows:
        return np.zeros(0, dtype)
    order = np.argsort(table["bucket"].to_numpy())
    blobs = table[f"a{i}"].to_pylist()
    return np.concatenate([from_planes(blobs[j], dtype) for j in order])


# ---------------------------------------------------------------- scratch


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        import tempfile

        # one machine, one process: any folder is shared
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillspan-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Written as a table to the shared folder and read again: the lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspan_path = path
    return out


def cleaned(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles whose plans are no longer in use, which it does as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_quillspan_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        cleaned(tables[0].sparkSession)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number for each, the same at each reading however the files are split: the file's number among all
    files, and the row's within the file.  Rows that come from no Parquet files are stored first."""
    try:
        from_files = rows.select("*", F.col("_metadata.file_path").alias("_quillspan_file"), F.col("_metadata.row_index").alias("_quillspan_index"))
    except AnalysisException:
        return numbered(stored(rows), name)
    files = from_files.select("_quillspan_file").distinct()
    files = stored(files.select("_quillspan_file", (F.row_number().over(Window.orderBy("_quillspan_file")) - 1).cast("long").alias("_quillspan_no")))
    if files.count() <= FEW_FILES:
        files = F.broadcast(files)
    both = from_files.join(files, "_quillspan_file").withColumn(name, F.col("_quillspan_no") * F.lit(1 << 36) + F.col("_quillspan_index"))
    return both.drop("_quillspan_file", "_quillspan_no", "_quillspan_index")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


# ---------------------------------------------------------------- chunks


def planes(x: np.ndarray) -> bytes:
    """Integers as byte planes; those that are all zero cost nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


def from_planes(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


CHUNKS = "chunk string, doc_ids array<bigint>, folds binary, offsets binary, text binary"


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = CHUNK_BYTES, apart: int | None = None) -> DataFrame:
    """Documents packed into chunks and stored: ids, crc32 folds, offsets, and the zstd-compressed text of each chunk.

    apart: a fold whose documents get chunks of their own, with names that end in "t".
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, squeeze = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=2)
        for no, whole in enumerate(slices(batches, "text", limit)):
            for t, end in ((whole, ""),) if apart is None else ((whole.filter(pc.not_equal(whole["fold"], apart)), ""), (whole.filter(pc.equal(whole["fold"], apart)), "t")):
                if t.num_rows:
                    data, offsets = utf8(t["text"])
                    ids = t["doc_id"].combine_chunks()
                    cols = [pa.array([f"{part}-{no}{end}"]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([t["fold"].to_numpy().astype(np.uint8).tobytes()], pa.binary()), pa.array([planes(offsets)], pa.binary()), pa.array([squeeze.compress(data.tobytes())], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["chunk", "doc_ids", "folds", "offsets", "text"])
        tidy()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), fold(doc_id).alias("fold"))
    return stored(rows.mapInArrow(pack, CHUNKS))


def packed(c: Chunk, ids: pa.Array) -> pa.Table:
    """A chunk as a row again, with other ids."""
    import zstandard

    text = zstandard.ZstdCompressor(level=2).compress(c.data.tobytes())
    cols = [pa.array([c.name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([c.folds.tobytes()], pa.binary()), pa.array([planes(c.offsets)], pa.binary()), pa.array([text], pa.binary())]
    return pa.Table.from_arrays(cols, ["chunk", "doc_ids", "folds", "offsets", "text"])


class Chunk:
    """One chunk, unpacked; a null id counts as the largest."""

    def __init__(self, table: pa.Table | pa.RecordBatch, row: int = 0) -> None:
        import zstandard

        get = lambda c: table.column(table.schema.get_field_index(c))[row]
        self.name = get("chunk").as_py()
        self.ids = get("doc_ids").values
        self.order = np.asarray(self.ids.fill_null(np.iinfo(np.int64).max)) if self.ids.null_count else self.ids.to_numpy()
        self.folds = np.frombuffer(get("folds").as_py(), np.uint8)
        self.offsets = from_planes(get("offsets").as_py(), "i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(get("text").as_py(), max_output_size=max(1, int(self.offsets[-1]))), np.uint8)


    def subset(self, docs: np.ndarray) -> Chunk:
        """The same chunk with some of its documents only (by number, ascending)."""
        out = object.__new__(Chunk)
        size = np.diff(self.offsets)[docs]
        out.name, out.ids, out.order, out.folds = self.name, self.ids.take(pa.array(docs)), self.order[docs], self.folds[docs] if len(self.folds) else self.folds
        out.offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        out.data = self.data[np.repeat(self.offsets[:-1][docs] - out.offsets[:-1], size) + np.arange(out.offsets[-1])]
        return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While rows are large, fewer of them go to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def each_chunk(store: DataFrame, fn: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn for every chunk of the stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from fn(Chunk(b, i))
                tidy()

    return store.mapInArrow(run, schema)


def each_answered(store: DataFrame, back: dict[str, DataFrame], fn: Callable[[Chunk, dict[str, pa.Table]], pa.Table], schema: str) -> DataFrame:
    """fn for every chunk, with the rows that each exchange sent back to it."""
    both = None
    for name, df in back.items():
        tagged = df.withColumn("exchange", F.lit(name))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    names = list(back)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(Chunk(left), {n: right.filter(pc.equal(right["exchange"], n)) for n in names})
        tidy()
        return out

    return store.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(run, schema)


def in_group(inverse: np.ndarray, starts: np.ndarray, x: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how (np.minimum, np.maximum, np.add) of x over each group of equal keys."""
    order = np.argsort(inverse, kind="stable")
    return how.reduceat(x[order], starts, dtype=x.dtype) if len(x) else x


def several_documents(multi: np.ndarray, chunk_no: np.ndarray, inverse: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group: does its key stand in two documents at least?  A key comes once from each chunk that has it."""
    return (np.bincount(inverse, minlength=len(starts)) > 1) | (np.bincount(inverse, weights=multi, minlength=len(starts)) > 0)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - have : w - have + len(x) - w + 1]) if len(x) >= w else x[:0]


def keys_of_documents(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether each stands in several documents."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, np.zeros(0, np.uint8)
    return keys[first], (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)).astype(np.uint8)
