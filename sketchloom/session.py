"""Session helpers: table reading and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package's source to the Python workers of the session, once."""
    sc = spark.sparkContext
    if getattr(sc, "_sketchloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="loom-")
    path = os.path.join(folder, "sketchloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, str(Path("sketchloom") / f.relative_to(_ROOT)))
    sc.addPyFile(path)
    sc._sketchloom_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, `<sf_dir>/<table>.parquet`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores: dealt by key if it has fewer partitions than the session has slots."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a folder under the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/loom-checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
