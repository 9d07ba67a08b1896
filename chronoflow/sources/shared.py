"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only on one machine (tests) a temporary one is made
    and set where there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronoflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut_folder(spark: SparkSession, name: str = "cut") -> str:
    """A folder in the shared one that no earlier job has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows written in the shared folder and read again. The plan of a loop does not grow, what is used several times
    is computed once, and a lost executor costs no recomputation."""
    path = cut_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_folder"] = path
    return out


def grown(df: DataFrame) -> DataFrame:
    """For joins: rows that grow with the input, met by sorted merges. Spark's own check takes the compressed bytes of the
    columns read for a table's size, and would send through the driver, as 10 MB, what is hundreds of them there."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in as many parts as the session has shuffle partitions: for small tables each row of which becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        if path := df.__dict__.get("_cut_folder"):
            drop_folder(df.sparkSession, path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
