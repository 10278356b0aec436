"""Paths on shared storage, through the file system that Spark opens them with."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _opened(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a directory holds; nothing if there is none."""
    fs, p = _opened(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _opened(spark, path)
    fs.delete(p, True)
