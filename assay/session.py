"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library relies on. Session time zone is UTC so
# that zoned timestamps derived from NTZ columns render the same everywhere.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "assay",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let the launcher decide; tests pass
    ``local[N]``. Size ``spark.sql.shuffle.partitions`` for the largest
    shuffle (about its bytes / 128 MB) and let AQE coalesce the small ones;
    AQE's skew-join splits partitions of hot keys at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``assay`` importable in Python workers (pandas functions are pickled
    by module reference): zip the package once and add it with ``addPyFile``,
    which distributes it with the job like ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "_assay_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="assay-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    sc._assay_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, read from ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only a local-mode
    session without the setting (tests, benchmarks) gets a fresh folder under
    the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="assay-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: How tables of events are written: their texts and ids take a half to a tenth of the default's bytes.
STORED = {"compression": "zstd"}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query leave the disk when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the library's own, if it is there, through the file system of the path."""
    fs, root = _file_system(spark, path)
    fs.delete(root, True)


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Move the files of one folder into another, their names after ``prefix``; returns their number."""
    fs, root = _file_system(spark, source)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(target))
    found = [s.getPath() for s in fs.listStatus(root) if s.isFile()] if fs.exists(root) else []
    for f in found:
        if not fs.rename(f, path(target, prefix + f.getName())):
            raise OSError(f"{f.toString()} could not be moved to {target}")
    return len(found)


class WorkTables:
    """Tables that a job keeps in one folder for as long as it needs them. Checkpoints are not compressed and stay until the driver
    happens to collect its garbage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        remove_folder(spark, path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.options(**STORED).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove_folder(self.spark, f"{self.path}/{name}")


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` that a finished write left (they hold ``_SUCCESS``), through the
    file system of the path, whichever it is."""
    fs, root = _file_system(spark, path)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if fs.exists(done(p, "_SUCCESS")))
