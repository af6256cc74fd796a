"""What Spark's readers and writers leave out: names in a folder, removal, and a rename that never replaces anything."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, folder: str) -> dict[str, int]:
    """The names in a folder with their times of change in milliseconds; nothing for a folder that is not there."""
    fs = _file_system(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(_path(spark, folder))}


def remove(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(_path(spark, path), True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step; false, with nothing changed, if the target exists."""
    jvm = spark._jvm
    target_path = _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _file_system(spark, target).getUri(), spark._jsc.hadoopConfiguration())
    never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, source), target_path, never_replace)
    except Py4JJavaError as err:
        if err.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True
