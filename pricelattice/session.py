"""Session settings and the few session-bound helpers that operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pricelattice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and AQE on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``{folder}/{name}.parquet``, narrowed to ``columns`` so that only they reach the scan.

    A folder without the table raises Spark's own PATH_NOT_FOUND; an empty table gives an empty frame.
    """
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session (tests, a laptop) takes a
    temporary folder, which goes with the process; on a cluster it is an error, for a folder of one machine loses
    what an executor wrote.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme, by the session's Hadoop configuration."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = file_system(spark, path)
    return files.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, empty if there is none."""
    files, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def spread(frame: DataFrame, bytes_a_core: int = 64 << 20) -> DataFrame:
    """``frame`` over all cores, for work that is heavy a row.

    Little data would otherwise sit in one or two tasks (one row group, partitions coalesced by size). By Catalyst's
    estimate, from ``bytes_a_core`` a core on there are enough tasks anyway, and the rows stay where they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(2 * cores) if size < cores * bytes_a_core else frame
