"""Artifact inventory, content hashes and uploads, on any file system that pyarrow opens.

:class:`ArtifactSource` is a Python data source: the files below a root, empty ones and those
whose names begin with ``_`` or ``.`` too, are dealt to partitions by size, a large file to one
of its own, and tasks read them in chunks. Every size and every scheme goes the same way;
nothing but the list of files passes through the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 4 * 1024 * 1024
#: Files are dealt to a partition up to this many bytes, and up to this many files.
PARTITION_BYTES, PARTITION_FILES = 256 * 1024 * 1024, 1000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme = urlparse(path).scheme if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else ""
    if scheme in ("", "file"):
        local = unquote("/" + urlparse(path).path.lstrip("/")) if scheme else os.path.abspath(path)
        return fs.LocalFileSystem(), local.rstrip("/") or "/"
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return system, inner.rstrip("/")


def listed(path: str, below: str = "") -> list[fs.FileInfo]:
    """The files below ``path/below``, by path; none where there is no such folder."""
    system, root = file_system(path)
    folder = f"{root}/{below}".rstrip("/")
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)


def sha256_of(system: fs.FileSystem, path: str, chunk: int) -> str:
    digest = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while part := stream.read(chunk):
            digest.update(part)
    return digest.hexdigest()


@dataclass
class Files(InputPartition):
    """``key, path, size, modified (microseconds)`` of each."""

    files: list


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.below = options["path"], options.get("below", "")
        self.hashed = options.get("hashed", "false") == "true"
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Files]:
        _, root = file_system(self.path)
        out, size = [Files([])], 0
        for f in listed(self.path, self.below):
            held = out[-1].files
            if held and (size + f.size > PARTITION_BYTES or len(held) >= PARTITION_FILES):
                out.append(Files([]))
                size = 0
            out[-1].files.append((f.path[len(root) + 1 :], f.path, f.size, f.mtime_ns // 1000))
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for key, path, size, modified in partition.files:
            try:
                digest = sha256_of(system, path, self.chunk) if self.hashed else None
            except FileNotFoundError:
                continue  # it went after it was listed: it is missing, no more
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([size], pa.int64()), pa.array([modified], pa.timestamp("us", "UTC")), pa.array([digest], pa.string())],
                names=["key", "size_bytes", "modified", "sha256"],
            )


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_artifacts"

    def schema(self) -> str:
        return "key string, size_bytes bigint, modified timestamp, sha256 string"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(dict(self.options))


def _files(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArtifactSource)
    return spark.read.format(ArtifactSource.name()).options(path=path, **options).load()


def list_artifacts(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``key, uri, size_bytes, modified`` below a prefix, by key. Contents are not read."""
    return (
        _files(spark, path, below=prefix[: prefix.rfind("/") + 1])
        .filter(F.col("key").startswith(prefix))
        .select("key", F.concat(F.lit("artifact://"), "key").alias("uri"), "size_bytes", "modified")
        .orderBy("key")
    )


def hash_artifacts(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``key, size_bytes, sha256`` of every file below ``path``, read in chunks inside tasks."""
    return _files(spark, path, hashed="true", chunk=str(chunk)).select("key", "size_bytes", "sha256")


def put_artifacts(rows: DataFrame, path: str) -> DataFrame:
    """Write ``body`` (bytes) of each row of ``key, body`` to ``path/key``, from the tasks;
    ``key, size_bytes, sha256`` of what was written. A file is moved to its name when it is
    whole, so a task that runs again replaces it."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            sizes, hashes = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{key}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(part := f"{target}.{uuid.uuid4().hex}.upload") as stream:
                    stream.write(body or b"")
                system.move(part, target)
                sizes.append(len(body or b""))
                hashes.append(hashlib.sha256(body or b"").hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], names=["key", "size_bytes", "sha256"]
            )

    return rows.select("key", "body").mapInArrow(put, "key string, size_bytes bigint, sha256 string")
