"""Small documents on any store that Spark reaches: read whole, created whole or not at all."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession


def local_path(path: str) -> str | None:
    """The path of a ``file:`` address or a plain path; None for another store's."""
    plain = re.sub("^file:/+", "/", path)
    return None if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:/", plain) else plain


def _hadoop(path: str):
    """Path, context of its store and package of the session's Hadoop."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a Spark session")
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return at, jvm.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()), spark._jvm


def read_bytes(path: str) -> bytes:
    if (own := local_path(path)) is not None:
        with open(own, "rb") as f:
            return f.read()
    at, context, jvm = _hadoop(path)
    stream = context.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def exists(path: str) -> bool:
    if (own := local_path(path)) is not None:
        return os.path.lexists(own)
    at, context, _ = _hadoop(path)
    return context.util().exists(at)


def create_once(path: str, data: bytes) -> None:
    """A new file with these bytes; FileExistsError if another writer was first. No reader ever sees a part of it.

    On a local disk a hard link makes the name, elsewhere a rename that doesn't
    overwrite, which Hadoop's stores promise to be one step.
    """
    staged = f"{path}.{uuid.uuid4().hex}.part"
    if (own := local_path(path)) is not None:
        staged = local_path(staged)
        with open(staged, "xb") as f:
            f.write(data)
        try:
            os.link(staged, own)
        finally:
            os.remove(staged)
        return
    at, context, jvm = _hadoop(path)
    part = jvm.org.apache.hadoop.fs.Path(staged)
    gateway = SparkSession.getActiveSession().sparkContext._gateway
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    stream = context.create(part, flags, gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    try:
        if context.util().exists(at):
            raise FileExistsError(path)
        context.rename(part, at, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except FileExistsError:
        raise
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise FileExistsError(path) from None
        raise
    finally:
        context.delete(part, False)
