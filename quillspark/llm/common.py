"""Session plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; on a cluster that folder would be
    another one on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    own = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    sc.setCheckpointDir(own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has gone already
        pass


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    Any executor can reread it, so a lost executor costs a task and not the job. The table goes
    when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    _STORED[path] = None
    return spark.read.schema(df.schema).parquet(path)


_STORED: dict[str, None] = {}


class Scratch:
    """Tables that loops write round by round: `keep` writes the next one and removes the one before."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def keep(self, df: DataFrame) -> DataFrame:
        out = store(df, self.name)
        path, self.path = self.path, next(reversed(_STORED))
        if path:
            _remove(df.sparkSession, path)
        return out


def gathered(df: DataFrame) -> DataFrame:
    """A scan's splits in as few tasks as full splits would take, at least two for each core.

    Many small files would otherwise make as many tasks, Python workers' batches and files written.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.coalesce(min(1 << 30, max(2 * spark.sparkContext.defaultParallelism, -(-size // split))))


MOST_ROWS = 1_000_000  # short rows that may be broadcast: a bound on what the driver and each task hold


def few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def sized(small: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcasting where it has at most MOST_ROWS rows.

    Beyond that the join is left to Spark, which shuffles both sides.
    """
    return F.broadcast(small) if few(small, MOST_ROWS) else small


BIG, LEAST_HOT = 10_000, 1000


def join_spread(rows: DataFrame, per_key: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a written table of one row per key, which says how many of the `total` rows a key has.

    Keys of a BIGth of all rows or more (there are at most BIG of them) are broadcast, so no key of
    the shuffle holds more rows than that.
    """
    hot = F.col(count) >= max(LEAST_HOT, total // BIG)
    return rows.join(F.broadcast(per_key.where(hot)), on).unionByName(rows.join(per_key.where(~hot), on))


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
