"""Session facts the operators need: the checkpoint folder and sensible defaults."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brightloom-checkpoint-"))
    else:
        raise RuntimeError(
            "Set spark.checkpoint.dir to a folder every executor can reach; "
            "a machine-local folder would be lost with its executor."
        )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables written along the way."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage and survives lost executors; unlike a row checkpoint the result
    can still be read column by column, and values such as
    ``monotonically_increasing_id`` are frozen by the write.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Write a short text as the only file of the folder ``path``, through Spark's file systems."""
    spark.range(1, numPartitions=1).select(F.lit(text)).write.mode("overwrite").text(path)
    return path


def read_text(spark: SparkSession, path: str) -> str:
    """What ``write_text`` wrote, or a plain file."""
    rows = spark.read.text(path, wholetext=True).where(F.length("value") > 0).collect()
    return "".join(r[0] for r in rows).removesuffix("\n")


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to the workers as code, so they need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
