"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine wants; a session that has its own keeps them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("groundstone")
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    return (
        build.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")  # small tables still use all cores
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting: it then gets a temporary folder, which is shared
    because there is one machine.  A cluster without it is an error, not a silent local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    found = "file://" + tempfile.mkdtemp(prefix="groundstone-")
    spark.conf.set("spark.checkpoint.dir", found)
    _forget_later(spark, found)
    return found


#: Paths of cuts by the scratches that are open, the innermost last.
_open: list[list[str]] = []


def cut(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The result has no lineage beyond its files, so the loss of an executor costs nothing that was
    computed before, and the columns a later step doesn't use aren't read.  The files go when the
    ``scratch`` around them ends (with ``keep`` the one around that), at the latest with the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundstone-cuts/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    frames = _open[:-1] if keep else _open
    if frames:
        frames[-1].append(path)
    _forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Cuts made inside are deleted at the end: for steps whose results have been written elsewhere."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            forget(spark, path)


#: Beside a table's path: its next version, and the one before while they change places.
NEW, OLD = ".new", ".old"


def settled(spark: SparkSession, path: str) -> bool:
    """Finish a replacement that may have been broken off; is there a table at ``path``?

    A next version that is whole takes the table's place, any other goes.
    """
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path + NEW)):
        if fs.exists(at(f"{path}{NEW}/_SUCCESS")):
            if fs.exists(at(path)):
                fs.delete(at(path + OLD), True)
                fs.rename(at(path), at(path + OLD))
            fs.rename(at(path + NEW), at(path))
        else:
            fs.delete(at(path + NEW), True)
    if fs.exists(at(path)):
        fs.delete(at(path + OLD), True)
    elif fs.exists(at(path + OLD)):
        fs.rename(at(path + OLD), at(path))
    return fs.exists(at(path))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any shared store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget_later(spark: SparkSession, path: str) -> None:
    def run() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                forget(spark, path)
        except Exception:  # the session may be gone by now
            pass

    atexit.register(run)
