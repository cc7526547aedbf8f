"""Path checks through the Hadoop file system, so any mounted storage works. Only metadata reaches the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hadoop_path


def require_path(spark: SparkSession, path: str) -> str:
    """The path itself; ``FileNotFoundError`` when nothing is there."""
    fs, hadoop_path = _hadoop_path(spark, path)
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(path)
    return path


def path_state(spark: SparkSession, path: str) -> tuple[str, str]:
    """Qualified path and its state: ``missing``, ``file``, ``empty`` or ``directory``."""
    fs, hadoop_path = _hadoop_path(spark, path)
    full = fs.makeQualified(hadoop_path).toString().rstrip("/")
    if not fs.exists(hadoop_path):
        return full, "missing"
    if not fs.getFileStatus(hadoop_path).isDirectory():
        return full, "file"
    return full, "directory" if fs.listStatusIterator(hadoop_path).hasNext() else "empty"


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Full paths of the files directly in a directory, sorted by name."""
    fs, hadoop_path = _hadoop_path(spark, directory)
    found = fs.listStatus(hadoop_path)
    return sorted(status.getPath().toString() for status in found if status.isFile())


def data_files(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """Files that a read of a directory takes in, each as the path to read and as the form ``_metadata.file_path`` gives it.

    Names that begin with ``_`` or ``.`` are left out; folders named ``name=value`` are entered.
    """
    fs, hadoop_path = _hadoop_path(spark, directory)
    found = []
    for status in fs.listStatus(hadoop_path):
        place = status.getPath()
        name = place.getName()
        if status.isDirectory():
            if "=" in name:
                found += data_files(spark, place.toString())
        elif name[0] not in "._":
            _, plain = _hadoop_path(spark, place.toString())  # the path as Spark itself will build it from the text
            found.append((place.toString(), plain.toUri().toString()))
    return sorted(found)


def list_folders(spark: SparkSession, directory: str) -> list[str]:
    """Full paths of the folders directly in a directory, sorted by name; none if it is missing."""
    fs, hadoop_path = _hadoop_path(spark, directory)
    found = fs.listStatus(hadoop_path) if fs.exists(hadoop_path) else []
    return sorted(status.getPath().toString() for status in found if status.isDirectory())


def remove_folder(spark: SparkSession, directory: str) -> bool:
    fs, hadoop_path = _hadoop_path(spark, directory)
    return fs.delete(hadoop_path, True)


def rename_file(spark: SparkSession, source: str, target: str) -> bool:
    fs, hadoop_path = _hadoop_path(spark, source)
    return fs.rename(hadoop_path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target))
