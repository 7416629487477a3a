"""Session defaults and the shared staging folder every iterative operator uses."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def build(app: str = "corvida", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; ``conf`` overrides them.

    Keys are given with underscores for dots only where they hold none
    themselves, so callers normally pass ``**{"spark.x.y": "z"}``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a temporary folder is made and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="corvida-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever the driver found it; once for an application."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _SHIPPED or not root.is_dir():
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="corvida-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(app)


class Stage:
    """Tables written to the shared folder to cut lineage between iterations.

    A written table survives the loss of executors, which a local checkpoint
    does not, and its columnar files are smaller than a checkpoint's.
    ``drop`` removes a table that a later one has replaced; the rest goes when
    the driver ends, as lazy results may still read it, or at the end of a
    ``with`` block by a caller who has read them. What a killed driver left
    ``sweep_stages`` removes.
    """

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.at.clear()
        self._remove(self.root)

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.at: dict[int, tuple[DataFrame, str]] = {}  # a held table keeps its id to itself
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        # the context may have stopped before the driver ends
        if self.spark.sparkContext._jsc is not None:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if held := self.at.pop(id(table), None):
                self._remove(held[1])


def sweep_stages(spark: SparkSession, hours: float = 168.0) -> list[str]:
    """Remove folders of staged tables in the shared folder that nothing has touched for so many hours; their names.

    Give more hours than the longest job takes: a running one may still read what it wrote first.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        name = entry.getPath().getName()
        if entry.isDirectory() and re.fullmatch("[a-z_]+-[0-9a-f]{32}", name):
            newest = max([entry.getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(entry.getPath()))])
            if newest < jvm.System.currentTimeMillis() - hours * 3_600_000:
                fs.delete(entry.getPath(), True)
                gone.append(name)
    return sorted(gone)
