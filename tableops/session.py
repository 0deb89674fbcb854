"""Where an operator may put data that other executors have to read."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the session's ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a new folder of
    its own. A cluster session without it is an error, because a machine-local
    folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tableops-")
    return _LOCAL_DIRS[app]


def hadoop_path(spark: SparkSession, path: str, is_uri: bool = False):
    """``(file system, path)`` of the JVM's Hadoop client for ``path``, as written or as a URI."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if is_uri else path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as file listings spell it, with scheme and host."""
    fs, jpath = hadoop_path(spark, path)
    return fs.makeQualified(jpath).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_path(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str, is_uri: bool = False) -> bool:
    fs, jpath = hadoop_path(spark, path, is_uri)
    return fs.delete(jpath, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Move a file, making the folder it goes to."""
    fs, jpath = hadoop_path(spark, path)
    _, jto = hadoop_path(spark, to)
    fs.mkdirs(jto.getParent())
    if not fs.rename(jpath, jto):
        raise OSError(f"{path} can't be moved to {to}")


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """One file that is there as a whole or not at all: written beside, then renamed."""
    fs, jpath = hadoop_path(spark, path)
    _, beside = hadoop_path(spark, f"{path}.part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move_path(spark, f"{path}.part", path)


def read_small_text(spark: SparkSession, path: str) -> str:
    fs, jpath = hadoop_path(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
