"""Small files that are published whole and at most once, in any file system Spark writes to.

Two writers that publish the same name cannot both succeed. On a local file system this is a hard
link to a finished file; elsewhere a rename, which must refuse a target that exists and
make it visible at once, as in HDFS and its kin.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, content: dict) -> bool:
    """Write ``content`` as JSON under ``path``; False if something is there already."""
    jvm = spark.sparkContext._jvm
    target, fs = _fs(spark, path)
    made, _ = _fs(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(target) and fs.rename(made, target)
        as_file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(as_file(target), as_file(made))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(made, False)


def published(spark: SparkSession, folder: str) -> list[str]:
    """The names published in a folder, in order."""
    target, fs = _fs(spark, folder)
    if not fs.exists(target):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(target))
    return sorted(n for n in names if not n.startswith("."))


def content(spark: SparkSession, path: str) -> dict:
    target, fs = _fs(spark, path)
    source = fs.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()
