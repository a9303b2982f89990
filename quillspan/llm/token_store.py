"""Token files with directly addressable codes.

An id is cut into chunks of `width` bits.  Level k holds chunk k of every id that reaches it, and a bitmap
tells which of them go on to level k+1; a rank directory (ones before each block of 512 bits) turns a place
in one level into the place in the next, so any token is read without decoding its neighbours.

File layout, little-endian: magic, width, number of levels, number of documents, number of ids; document
ids (with a null mask); ids before each document; then per level its length, chunks, bitmap, and directory.

Documents go into files in ascending doc_id order (null first, rows with equal ids in any order), each file
one range of ids.  Null text is empty and gives the end id alone; an empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, partitions, scratch, slices, stored, utf8, word_hashes, word_spans

MAGIC = b"QSDAC1\0\0"
BLOCK = 512
END_ID = 1
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks, packed bitmap of those that go on, ones before each block."""
    levels, rest = [], ids.astype(np.uint64)
    kind = np.uint8 if width <= 8 else np.uint16
    while True:
        chunk = (rest & np.uint64((1 << width) - 1)).astype(kind)
        on = rest >> np.uint64(width) != 0
        bits = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        ones = _POP[padded].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        levels.append((chunk, bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint64) if len(ones) else np.zeros(0, np.uint64)))
        rest = rest[on] >> np.uint64(width)
        if not len(rest):
            return levels


class Codes:
    """Random access to the ids of one file."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> None:
        self.levels, self.width = levels, width

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for chunk, bits, ones in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            i = int(ones[block]) + int(_POP[bits[block * (BLOCK // 8) : i >> 3]].sum()) + int(_POP[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            shift += self.width
        raise ValueError("a code goes on beyond the last level")

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value = self.levels[-1][0].astype(np.uint64)
        for chunk, bits, _ in self.levels[-2::-1]:
            on = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            full = chunk.astype(np.uint64)
            full[on] |= value << np.uint64(self.width)
            value = full
        return value


def dump(doc_ids: list[int | None], before: np.ndarray, ids: np.ndarray, width: int = 8) -> bytes:
    levels = encode(ids, width)
    out = [MAGIC, struct.pack("<IIQQ", width, len(levels), len(doc_ids), len(ids))]
    out += [np.array([x or 0 for x in doc_ids], np.int64).tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), before.astype(np.uint64).tobytes()]
    for chunk, bits, ones in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), ones.tobytes()]
    return b"".join(out)


def load(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, ids before each document (one more entry), codes."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    width, n_levels, n_docs, n = struct.unpack_from("<IIQQ", data, 8)
    at = 32

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, before = take(np.int64, n_docs), take(np.uint8, n_docs), take(np.uint64, n_docs + 1)
    levels = []
    for _ in range(n_levels):
        m = int(take(np.uint64, 1)[0])
        levels.append((take(np.uint8 if width <= 8 else np.uint16, m), take(np.uint8, -(-m // 8)), take(np.uint64, -(-m // BLOCK))))
    return [None if z else int(x) for x, z in zip(doc_ids, null)], before.astype(np.int64), Codes(levels, width)


#: What a byte is, for cutting words: ASCII letters 1, other ASCII but space and apostrophe 2, anything else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[0x27] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts by their parts, each distinct part once.

    The tokenizer drops white space and never joins across it, nor across a border between an ASCII letter and
    another ASCII character that is no apostrophe, so a text's ids are those of the parts between such borders.
    Words with "<|" stay whole, as they may hold a special token.  Parts are told apart by their 64-bit hash;
    what is known is kept from batch to batch, and emptied when it holds `keep` parts.
    """

    def __init__(self, path: str, keep: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def clear(self) -> None:
        self.hashes, self.first, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.count = np.zeros(0, np.uint32)

    def new_ids(self, texts: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        model, rest = self.tokenizer.model, []
        for i, x in enumerate(texts):
            if x.isalpha():  # of ASCII letters alone: only the lower-casing precedes the model
                out.append([t.id for t in model.tokenize(x.lower().decode())])
            else:
                out.append(None)
                rest.append(i)
        for lo in range(0, len(rest), 1024):
            part = rest[lo : lo + 1024]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all parts, and the parts before each document."""
        starts, ends, _ = word_spans(data, offsets, SPACE_WORD)
        kind = _KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = kind[1:] + kind[:-1] == 3
        cut[offsets[:-1][offsets[:-1] < len(data)]] = False
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        for w in np.unique(np.searchsorted(starts, special, "right") - 1).tolist():
            cut[starts[w] + 1 : ends[w]] = False
        inner = np.flatnonzero(cut)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        return starts, ends, np.searchsorted(starts, offsets)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and the ids before each (without end ids)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, words = self.parts(data, offsets)
        uniq, at, back = np.unique(word_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        if len(self.hashes) > self.keep:
            self.clear()
        place = np.searchsorted(self.hashes, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == uniq
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            got = self.new_ids([raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for g in got for x in g), np.uint32, int(n.sum()))
            if len(flat) and flat.max() > 0xFFFF:
                self.pool = self.pool.astype(np.uint32)
            hashes = np.concatenate([self.hashes, uniq[new]])
            order = np.argsort(hashes, kind="stable")
            self.first = np.concatenate([self.first, (len(self.pool) + np.cumsum(n) - n).astype(np.uint32)])[order]
            self.count, self.hashes = np.concatenate([self.count, n.astype(np.uint32)])[order], hashes[order]
            self.pool = np.concatenate([self.pool, flat.astype(self.pool.dtype)])
            place = np.searchsorted(self.hashes, uniq)
        first, count = self.first[place][back].astype(np.int64), self.count[place][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        index = np.repeat(first - total[:-1], count) + np.arange(total[-1])
        return self.pool[index].astype(np.uint32), total[words]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, width: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files of documents in ascending doc_id order; gives the manifest: file_no, part, path, n_docs, n_tokens, base, root."""
    spark = docs.sparkSession
    root = scratch(spark) + "/tokens"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base)
        encoder = WordEncoder.of(tokenizer)
        out = []
        for no, t in enumerate(slices(batches, "text")):
            data, offsets = utf8(t["text"])
            ids, before = encoder(data, offsets)
            ids, before = np.insert(ids, before[1:], end_id), before + np.arange(len(before))
            path = f"{base}/{uuid.uuid4().hex}.dac"
            with store.open_output_stream(path, compression=None) as f:
                f.write(dump(t["doc_id"].to_pylist(), before, ids, width))
            out.append((t["part"][0].as_py(), no, path, t.num_rows, len(ids)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "file_no", "path", "n_docs", "n_tokens"])

    manifest = stored(rows.mapInArrow(write, "part int, file_no int, path string, n_docs long, n_tokens long"))
    # ids before each file: first within a range of doc ids, then over the ranges, of which there are as many as partitions
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = manifest.withColumn("within", within).join(parts, "part")
    return manifest.select("part", "file_no", "path", "n_docs", "n_tokens", (F.col("within") + F.col("ahead")).alias("base"), F.lit(root).alias("root"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def readers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base, root in zip(*(b.column(i).to_pylist() for i in range(3))):
                store, _ = fs.FileSystem.from_uri(root)
                with store.open_input_stream(path, compression=None) as f:
                    doc_ids, before, codes = load(f.read())
                raw = memoryview(codes.all().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(before[:-1].tolist(), before[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before[:-1] + base), pa.array(np.diff(before)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "base", "root").repartition(partitions(manifest.sparkSession), "path")
    return files.mapInArrow(readers, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer))
