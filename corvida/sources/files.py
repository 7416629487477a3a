"""Trees of files: a listing that tells links from files, and copies that are hashed again before they appear."""

from __future__ import annotations

import hashlib
import os
import posixpath
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvida.operators import contracts
from corvida.session import ship_package
from corvida.sources.store import local_path

LISTED = "path string, kind string, size long, target string"
#: Bytes read at once.
BLOCK = 1 << 20
#: Entries of the top folder in a partition of a listing at most.
ENTRIES = 256


def _kind(mode: int) -> str:
    return "link" if stat.S_ISLNK(mode) else "folder" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


class _Entries(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Entries]:
        names = sorted(os.listdir(self.root))
        return [_Entries(names[k : k + ENTRIES]) for k in range(0, len(names), ENTRIES)] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        todo = list(reversed(partition.names))
        while todo:
            name = todo.pop()
            at = os.path.join(self.root, name)
            found = os.lstat(at)  # a link is never followed
            kind = _kind(found.st_mode)
            yield name, kind, found.st_size if kind == "file" else None, os.readlink(at) if kind == "link" else None
            if kind == "folder":
                todo += [posixpath.join(name, x) for x in sorted(os.listdir(at), reverse=True)]


class FileListing(DataSource):
    """``spark.read.format("corvida_files")``: what lies below a folder that driver and executors mount."""

    @classmethod
    def name(cls) -> str:
        return "corvida_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, kind, size, target`` of all entries below a folder; kinds are file, folder, link and other.

    Other stores than a mounted file system have no links: there Spark lists
    the files, and reads none.
    """
    if (own := local_path(root)) is not None:
        ship_package(spark)
        spark.dataSource.register(FileListing)
        return spark.read.format("corvida_files").option("path", os.path.abspath(own)).load()
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return files.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), F.lit("file").alias("kind"), F.col("length").alias("size"), F.lit(None).cast("string").alias("target"))


def refuse_links(spark: SparkSession, root: str) -> None:
    """ValueError if a folder is a link, or anything below it is one or no plain file."""
    if (own := local_path(root)) is not None and os.path.islink(own.rstrip("/")):
        raise ValueError(f"{root} is a link")
    contracts.require(listing(spark, root).where("kind NOT IN ('file', 'folder')").select("path", "kind", "target"), "links or odd files")


def _copied(source: str, target: str) -> tuple[str, int]:
    """Digest and size of what was written, read back from the target."""
    from pyarrow import fs

    (a, start), (b, end) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
    part = f"{end}.{uuid.uuid4().hex}.part"  # a second attempt writes a file of its own
    b.create_dir(posixpath.dirname(end), recursive=True)
    with a.open_input_stream(start) as x, b.open_output_stream(part) as y:
        while block := x.read(BLOCK):
            y.write(block)
    b.move(part, end)
    held, size = hashlib.sha256(), 0
    with b.open_input_stream(end) as x:
        while block := x.read(BLOCK):
            held.update(block)
            size += len(block)
    return held.hexdigest(), size


def _address(path: str) -> str:
    return path if local_path(path) is None else f"file://{os.path.abspath(local_path(path))}"


def copy_files(rows: DataFrame, source: str, target: str) -> DataFrame:
    """``path, sha256, size`` of what the executors wrote below ``target``, from ``rows(source, path)`` of files below ``source``."""
    ship_package(rows.sparkSession)
    start, end = _address(source).rstrip("/"), _address(target).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(1).to_pylist()
            told = [_copied(f"{start}/{a}", f"{end}/{b}") for a, b in zip(batch.column(0).to_pylist(), paths)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int64())], names=["path", "sha256", "size"])

    return rows.select("source", "path").mapInArrow(run, "path string, sha256 string, size long")


def publish_files(rows: DataFrame, source: str, target: str, frames: dict[str, DataFrame] | None = None) -> None:
    """Files of ``rows(source, path, sha256, size)`` copied to new paths in one new folder, with tables beside them, all or none.

    Executors copy the files and hash what they wrote; digests and sizes must
    be those of ``rows``, and the folder holds no other file. Then one rename
    makes it appear. Paths are plain and relative, and no two are one on a file
    system that ignores case; a target that exists, or that the source holds
    or lies in, is refused.
    """
    spark = rows.sparkSession
    contracts.check_apart(source, target)
    contracts.require(contracts.unsafe_paths(rows, "path"), "unsafe paths")
    contracts.require(contracts.unsafe_paths(rows, "source"), "unsafe paths")
    contracts.require(contracts.repeated(rows.select(F.lower("path").alias("path")), "path"), "paths that collide")
    taken = [name for name in frames or {} if rows.where(F.lower(F.substring_index("path", "/", 1)) == name.lower()).limit(1).count()]
    if taken:
        raise ValueError(f"tables and files share the names {taken}")
    refuse_links(spark, source)
    jvm = spark._jvm.org.apache.hadoop.fs
    end = jvm.Path(target)
    fs = end.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(end):
        raise FileExistsError(target)
    staged = f"{target.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        fs.mkdirs(jvm.Path(staged))
        wanted = rows.select("path", "sha256", F.col("size").cast("long").alias("size"))
        # the copies are made once, and told in a table that is read twice
        told = f"{staged}/_told"
        copy_files(rows, source, staged).write.parquet(told)
        contracts.require(contracts.difference(wanted, spark.read.parquet(told)), "files that changed on the way")
        fs.delete(jvm.Path(told), True)
        found = listing(spark, staged).where("kind <> 'folder'").select("path", "size")
        contracts.require(contracts.difference(wanted.select("path", "size"), found), "files that aren't those asked for")
        for name, frame in (frames or {}).items():
            frame.write.parquet(f"{staged}/{contracts.check_relative_path(name)}")
        if fs.exists(end) or not fs.rename(jvm.Path(staged), end):
            raise FileExistsError(target)
    finally:
        fs.delete(jvm.Path(staged), True)
