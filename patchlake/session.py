"""Table access, checkpointing and size checks shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only when it was counted and has at most this many rows (narrow rows: well under 64 MB).
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, so that it need not be installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_patchlake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="patchlake-")  # of the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "patchlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(at, n)
                    z.write(path, os.path.join("patchlake", os.path.relpath(path, package)))
    sc.addPyFile(archive)
    sc._patchlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; one of this machine only where the session runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="patchlake-shared-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return shared.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (``spark.checkpoint.dir``), so a lost executor loses nothing.

    The files of a checkpoint go when its DataFrame does, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before a Python stage, where the scan has fewer partitions than there are cores.

    A large table has more partitions than cores and stays as it is.  As Python stages begin here, the executors get
    this package first.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 32) -> DataFrame:
    """Equi-join of ``left`` to ``right`` (unique on ``key``).

    ``right`` is broadcast when a count proves it small; otherwise each of its rows is copied once per salt and the
    left rows take one salt by hash, so a key that holds a third of ``left`` is spread over ``salts`` tasks.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns[:1]), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")
