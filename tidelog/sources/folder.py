"""Files through Hadoop's own API, so that any store Spark reads can hold a database."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def claim(spark: SparkSession, path: str) -> bool:
    """Makes an empty file, or says that it is there: of several writers one succeeds."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        made = spark._jvm.java.io.File(p.toUri().getPath()).createNewFile()
        return bool(made)
    try:
        fs.create(p, False).close()
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    return True


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether the move happened; false if the target is there."""
    fs, p = _fs(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    return not fs.exists(target) and fs.rename(p, target)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or one under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
