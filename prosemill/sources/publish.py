"""Published outputs that are replaced whole: readers see the former version or the new one, never a part.

A version is written beside the others, in a folder of its own; then the file `_CURRENT`, which names the folder to be
read, is replaced by one rename of the Hadoop file system. A run that fails before leaves the former version as it was.
Former versions but `keep` are removed after a publication, so that readers that have just begun can end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CURRENT = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the published version; the path itself where nothing was published by versions."""
    if any(c in path for c in "*?[{,"):
        return path
    fs, named = _fs(spark, f"{path.rstrip('/')}/{CURRENT}")
    if not fs.exists(named):
        return path
    held = fs.open(named)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()
    return f"{path.rstrip('/')}/{name.strip()}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 1) -> str:
    """Let `write` fill a new folder and make it the current version; returns that folder."""
    base, name = path.rstrip("/"), f"v-{uuid.uuid4().hex}"
    fs, folder = _fs(spark, f"{base}/{name}")
    before = current(spark, base)
    try:
        write(f"{base}/{name}")
        _, staged = _fs(spark, f"{base}/_{name}")
        out = fs.create(staged, True)
        out.write(bytearray(name.encode()))
        out.close()
        _replace(spark, staged, f"{base}/{CURRENT}")
    except Exception:
        fs.delete(folder, True)
        raise
    kept = {name, before.rsplit("/", 1)[-1]}
    old = sorted(((s.getModificationTime(), s.getPath()) for s in fs.listStatus(_fs(spark, base)[1]) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in kept), key=lambda s: s[0])
    for _, done in old[: max(0, len(old) - keep + 1)] if keep else old:
        fs.delete(done, True)
    return f"{base}/{name}"


def _replace(spark: SparkSession, staged, target: str) -> None:
    """One rename over the file that is there, which no reader sees half done."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    to = jvm.org.apache.hadoop.fs.Path(target)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    uri = staged.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(staged).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(staged, to, options)


def publish_table(df: DataFrame, path: str, keep: int = 1) -> str:
    """A table published as Parquet."""
    return publish(df.sparkSession, path, lambda folder: df.write.parquet(folder), keep)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))
