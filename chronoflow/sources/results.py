"""Sinks of experiments: results by seed, feature matrices, fitted pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def put_seed(rows: DataFrame, path: str, seed: int) -> None:
    """The results of one seed in a folder of their own, as soon as the seed is done. A repeat replaces that folder, and
    readers see only files of writes that ended."""
    rows.drop("seed").write.mode("overwrite").parquet(f"{path}/seed={int(seed)}")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """The results so far, with the column seed."""
    return spark.read.option("basePath", path).parquet(f"{path}/seed=*")


def dump_features(rows: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """A matrix in long form: key, feature, value. An existing folder is an error."""
    names = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows.select(key, F.explode(names).alias("x")).select(key, "x.*").write.mode("errorifexists").parquet(path)


def load_features(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """The columns asked of a dumped matrix; only their rows are read. Null where a key lacks a feature."""
    rows = spark.read.parquet(path).where(F.col("feature").isin(columns))
    return rows.groupBy(key).pivot("feature", columns).agg(F.first("value"))


def save_model(model: PipelineModel, path: str) -> None:
    model.save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
