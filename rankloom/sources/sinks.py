"""Writing Parquet tables so that a reader sees the old or the new one, never a part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def allowed_path(path: str, roots: list[str]) -> None:
    """Refuses a path outside the given folders; source tables are never written."""
    if not any(path.rstrip("/") == r.rstrip("/") or path.startswith(r.rstrip("/") + "/") for r in roots):
        raise PermissionError(f"{path} lies outside {roots}")


def rebuild(df: DataFrame, path: str, *, roots: list[str], partition_by: list[str] | None = None) -> None:
    """The whole table anew: written beside the old one, then swapped in, so that ``df`` may read the old one."""
    allowed_path(path, roots)
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(fresh)
    fs, target = _fs(df.sparkSession, path)
    path_of = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, path_of(old))
    fs.rename(path_of(fresh), target)
    fs.delete(path_of(old), True)


def write_pair(first: tuple[DataFrame, str], last: tuple[DataFrame, str], *, roots: list[str]) -> None:
    """Two tables without a common transaction: the one that marks the work as done comes last."""
    rebuild(first[0], first[1], roots=roots)
    rebuild(last[0], last[1], roots=roots)
