"""Session helpers: table access and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Tables whose rows are long texts, so that work on a row outweighs moving it.
TEXTS = ("documents", "pages")
#: Bytes of a file up to which it may be dealt anew.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is one small file of fewer row groups than that, which no split size of the reader divides.

    The bound is absolute: a table of over ``SMALL`` bytes is never moved for this, on any number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and df.rdd.getNumPartitions() < cores else df


def show_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is not installed."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; read by Spark alone, so any store it knows will do."""
    show_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (tests, one machine), a fresh local one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    set_by = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_by is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(set_by or tempfile.mkdtemp(prefix="lexweave-ckpt-"))
    return jsc.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage by a reliable checkpoint, which survives lost executors.

    Only narrow tables (ids, hashes, verdicts) go through here, never texts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, read again: computed once, with texts compressed and columns pruned."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
