"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's `spark.checkpoint.dir`; where none is set and all tasks run on this
    machine, under a local temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="prosemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Batches:
    """Arrow batches that tasks write into a shared folder, a file each, and that other tasks read by name. A task that runs
    again writes files of its own, so only names that Spark has committed may be read."""

    def __init__(self, folder: str):
        self.folder = folder
        at = urlsplit(folder)
        self.local = unquote(at.path) if at.scheme in ("", "file") else None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, batch: pa.RecordBatch) -> str:
        name = f"{uuid.uuid4().hex}.arrow"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            out = pa.OSFile(f"{self.local}/{name}", "wb")
        else:
            store, path = self._store()
            store.create_dir(path, recursive=True)
            out = store.open_output_stream(f"{path}/{name}")
        with out, pa.ipc.new_stream(out, batch.schema) as to:
            to.write_batch(batch)
        return name

    def read(self, name: str) -> pa.RecordBatch:
        if self.local is not None:
            source = pa.OSFile(f"{self.local}/{name}")
        else:
            store, path = self._store()
            source = store.open_input_stream(f"{path}/{name}")
        with source, pa.ipc.open_stream(source) as found:
            return found.read_next_batch()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may be a pattern, names a file or folder in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def require(spark: SparkSession, path: str, what: str) -> str:
    """The path, or FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")
    return path
