"""A session with the settings that tests, bench and examples use."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


#: Application -> the folder made for it where none is set.
_OWN: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark takes it for, so that other readers take it for the same."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it isn't set in a local run, one of our own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(sc.applicationId)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-gaugework-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return qualified(spark, root)


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, which must be there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]


def remove_dir(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def package_root() -> str:
    """The folder that this package lies in."""
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver does: on one machine, or from a folder that all share."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package_root() not in paths:
        env["PYTHONPATH"] = os.pathsep.join([package_root(), *paths])
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to all executors, for clusters where they don't have it: once a session, as a zip in the shared folder."""
    import pyarrow.fs as pafs

    data, top = io.BytesIO(), os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith((".py", ".npz")):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    uri = work_dir(spark, "package")
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/gaugework.zip") as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(f"{uri}/gaugework.zip")
