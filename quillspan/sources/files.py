"""Text files as rows, and rows as text files: a data source and sink of whole files.

Reading: files are listed once and packed into partitions by size, files of no bytes included; a task reads its
files one after the other.  Each gives name, path, size, content (its bytes) and text: the bytes as UTF-8, damaged
sequences as U+FFFD, a byte order mark at the beginning being no part of the text.

Writing: every row becomes a file whose bytes are exactly its text's.  A task attempt writes below a staging folder of
its own, `part-.../1/<name>`; a second row of the same name goes to `part-.../2/<name>`, and so on, so equal names do
not mix.  The commit moves one folder for each task that succeeded; what failed or speculative attempts have left
goes with the staging folder.  Only one folder name for each task passes through the driver.  Folders must be
renameable (local disks, HDFS).
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspan.functions.text import extension_of, filtered_name, route

FORMAT = "span_files"
#: Bytes of files that one partition reads, and what a file weighs beside its bytes.
PACK, WEIGHT = 64 << 20, 64 << 10
#: Bytes of one batch of rows.
BATCH = 8 << 20
STAGING = "_staging-"
BOM = b"\xef\xbb\xbf"
SCHEMA = "name string, path string, size long, content binary, text string"


@dataclass
class Packed(InputPartition):
    """Files that one task reads: the folder they were found through, path, size."""

    files: list[tuple[str, str, int]]


@dataclass
class Staged(WriterCommitMessage):
    """What one task attempt has written."""

    folder: str
    files: int


def pack(files: list[tuple], limit: int = PACK) -> list[list[tuple]]:
    """Files (their last entry is the size) in order, in groups of about `limit` bytes; an empty file weighs something, too."""
    groups: list[list[tuple]] = []
    weight = limit
    for file in sorted(files):
        if weight + file[-1] + WEIGHT > limit:
            groups.append([])
            weight = 0
        groups[-1].append(file)
        weight += file[-1] + WEIGHT
    return groups


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], wanted: list[str]) -> None:
        self.options, self.wanted = options, wanted

    def partitions(self) -> list[Packed]:
        found: list[tuple[str, str, int]] = []
        for root in self.options["path"].split(","):
            store, base = fs.FileSystem.from_uri(root)
            info = store.get_file_info(base)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
            inside = (lambda i: i.base_name) if infos == [info] else lambda i: i.path[len(base) :]
            found += [(root, i.path, i.size) for i in infos if i.type == fs.FileType.File and self.shown(inside(i))]
        limit = int(self.options.get("packbytes", PACK))
        return [Packed(g) for g in pack(found, limit)] or [Packed([])]

    def shown(self, below: str) -> bool:
        """Names that begin with _ or . are the writers' own; `pathGlobFilter` is matched against the file's name."""
        steps = [s for s in below.split("/") if s]
        return not any(s.startswith((STAGING, "_temporary")) for s in steps) and fnmatch.fnmatchcase(steps[-1] if steps else "", self.options.get("pathglobfilter", "*"))

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for root, path, _ in partition.files:
            store, _ = fs.FileSystem.from_uri(root)
            with store.open_input_stream(path, compression=None) as f:
                data = f.read()
            held.append((posixpath.basename(path), path, len(data), data, data.removeprefix(BOM).decode("utf-8", "replace") if "text" in self.wanted else None))
            size += len(data)
            if size >= BATCH:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(("name", "path", "size", "content", "text"), zip(*rows)))
        kinds = {"name": pa.string(), "path": pa.string(), "size": pa.int64(), "content": pa.binary(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in self.wanted], self.wanted)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        folder = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        store, base = fs.FileSystem.from_uri(f"{self.staging}/{folder}")
        seen: dict[str, int] = {}
        for b in iterator:
            names, texts = b.column(b.schema.get_field_index("name")), b.column(b.schema.get_field_index("text"))
            for name, text in zip(names.to_pylist(), texts.to_pylist()):
                if not name or "/" in name or "\0" in name or name in (".", ".."):
                    raise ValueError(f"no name of a file: {name!r}")
                seen[name] = seen.get(name, 0) + 1
                at = f"{base}/{seen[name]}"
                store.create_dir(at)
                with store.open_output_stream(f"{at}/{name}", compression=None) as f:
                    f.write(text if isinstance(text, bytes) else (text or "").encode())
        return Staged(folder, sum(seen.values()))

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        _, staging = fs.FileSystem.from_uri(self.staging)
        store.create_dir(base)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base)):
                if old.path.rstrip("/") != staging:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for m in messages:
            if m is not None and m.files:
                store.move(f"{staging}/{m.folder}", f"{base}/{m.folder}")
        self._clear(store, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, staging = fs.FileSystem.from_uri(self.staging)
        self._clear(store, staging)

    @staticmethod
    def _clear(store: fs.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class SpanFiles(DataSource):
    """`spark.read.format("span_files").load(path)` and `df.write.format("span_files").mode("append").save(path)`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()}, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.names != ["name", "text"]:
            raise ValueError(f"files are written from the columns name, text, not {schema.names}")
        return _Writer(dict(self.options)["path"], overwrite)


def read_whole(spark: SparkSession, *paths: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """name, path, size, content, text of whole files; columns: those that are wanted, with their types."""
    spark.dataSource.register(SpanFiles)
    return spark.read.format(FORMAT).schema(columns).options(**options).load(",".join(paths))


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Name, text of whole files, empty ones included."""
    return read_whole(spark, *paths, columns="name string, text string")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Name, content and route (txt, docx, pdf; null: not read) of files of any kind."""
    files = read_whole(spark, *paths, columns="name string, content binary")
    return files.withColumn("route", route(F.col("name"), F.lit(None).cast("string"), F.col("content")))


def write_texts(docs: DataFrame, path: str, name: str = "name", text: str = "redacted", mode: str = "append") -> None:
    """K1: one file for each row, under the name X15 gives, with exactly the text's bytes."""
    docs.sparkSession.dataSource.register(SpanFiles)
    docs.select(filtered_name(F.col(name)).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")).write.format(FORMAT).mode(mode).save(path)


def kinds(docs: DataFrame, name: str = "name") -> DataFrame:
    """How many files of each extension there are."""
    return docs.groupBy(extension_of(F.col(name)).alias("extension")).agg(F.count("*").alias("n"))
