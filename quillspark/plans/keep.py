"""Cutting lineage between the stages of a plan."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """What frames made in here shuffle is removed as soon as they are written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that driver and executors share.

    A stage that several others read would otherwise be planned, and its expressions canonicalised,
    once for each reader. The folder is spark.checkpoint.dir; a local session without one gets its
    own, which on a cluster would be another folder on each machine. What was shuffled for a stage is
    removed as soon as the stage is written. Inside packing(): pack().
    """
    if _packing.get():
        return pack(df)
    shared_dir(df.sparkSession)
    with _cleaning(df.sparkSession):
        # a frame takes the setting when it is made
        return df.select("*").checkpoint()


def pack(df: DataFrame) -> DataFrame:
    """As keep(), as compressed columns: for texts and long lists, of which readers take some columns only.

    A checkpoint holds rows as they lie in memory, nearly twice the size of the table that texts came from. The
    columns go with discard(), or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    with _cleaning(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


_packing = contextvars.ContextVar("packing", default=False)


@contextlib.contextmanager
def packing():
    """Stages kept in here are packed."""
    token = _packing.set(True)
    try:
        yield
    finally:
        _packing.reset(token)


def discard(packed: DataFrame) -> None:
    """Remove a packed stage that nobody reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in packed.inputFiles()}:
        _remove(packed.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone already
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(configured or f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
    return sc.getCheckpointDir()
