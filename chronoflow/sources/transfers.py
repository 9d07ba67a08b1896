"""Sources and sinks of transfers: guarded scans, windowed extraction, manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

EDGES = "block_timestamp timestamp, transaction_hash string, from_address string, to_address string, value_lossless string, value_eth double"
ROWS_PER_FILE = 5_000_000


def estimated_gb(df: DataFrame) -> float:
    """What the optimised plan would read, in GB, without running it; column and partition pruning count."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e9


def run_query(spark: SparkSession, sql: str, max_gb: float = 10.0) -> DataFrame:
    """The result of ``sql``; raises before running it if the plan would read more than ``max_gb``."""
    df = spark.sql(sql)
    if (gb := estimated_gb(df)) > max_gb:
        raise ValueError(f"the query would read {gb:.2f} GB, more than {max_gb} GB")
    return df


def value_eth(wei: Column) -> Column:
    """Wei, kept as a string so that no digit is lost, in units of 1e18."""
    return wei.cast("double") / F.lit(1e18)


def window_of(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Transfers of [start, end) with a positive value, with value_eth. Both bounds reach the scan."""
    rows = raw.where((F.col("block_timestamp") >= F.lit(start).cast("timestamp")) & (F.col("block_timestamp") < F.lit(end).cast("timestamp")) & (F.col("value_lossless").cast("double") > 0))
    return rows.select("block_timestamp", "transaction_hash", "from_address", "to_address", "value_lossless", value_eth(F.col("value_lossless")).alias("value_eth"))


def edges_view(spark: SparkSession, source, name: str = "edges") -> DataFrame:
    """Registers a path, glob or DataFrame as the view of edges and returns its five columns."""
    df = source if isinstance(source, DataFrame) else spark.read.parquet(source)
    df = df.select("from_address", "to_address", "block_timestamp", "transaction_hash", "value_eth")
    df.createOrReplaceTempView(name)
    return df


def save(df: DataFrame, path: str, params: dict | None = None, rows_per_file: int = ROWS_PER_FILE) -> dict:
    """Writes ``df`` to a new folder (an existing one is an error) in files of bounded length and, only when that is
    done, a manifest beside it. Counts come from the write itself, not from another pass."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)
    manifest = {"rows": seen.get["rows"], "schema": df.schema.simpleString(), "written": datetime.now(timezone.utc).isoformat(), "params": params or {}}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.manifest")
    return manifest


def save_sample(nodes: DataFrame, edges: DataFrame, folder: str, params: dict | None = None) -> dict:
    """A sample as a pair of tables, ``nodes`` and ``edges``, each with its manifest, and one for both, written last. Edges
    lie in the order of time, then hash and ends: by ranges from file to file, sorted within."""
    order = ["block_timestamp", "transaction_hash", "from_address", "to_address"]
    found = {"nodes": save(nodes, f"{folder}/nodes", params)["rows"], "edges": save(edges.repartitionByRange(*order).sortWithinPartitions(*order), f"{folder}/edges", params)["rows"]}
    whole = found | {"params": params or {}}
    nodes.sparkSession.createDataFrame([(json.dumps(whole, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return whole


def manifest_of(spark: SparkSession, path: str) -> dict:
    """The manifest of a folder; without one its write did not end."""
    return json.loads(spark.read.text(f"{path}.manifest").first()["value"])


def reconciled(spark: SparkSession, path: str) -> dict:
    """Counts what is on disk and raises if the manifest says otherwise."""
    df = spark.read.parquet(path)
    found = df.agg(F.count("*").alias("rows"), *([F.min("block_timestamp").alias("first"), F.max("block_timestamp").alias("last")] if "block_timestamp" in df.columns else [])).first().asDict()
    if found["rows"] != manifest_of(spark, path)["rows"]:
        raise ValueError(f"{path} has {found['rows']} rows, its manifest {manifest_of(spark, path)['rows']}")
    return found


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Name, column, type and place of every column of every table and view of the session."""
    rows = [(t.name, c.name, c.dataType, k) for t in spark.catalog.listTables(database) for k, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(sorted(rows), "table_name string, column_name string, data_type string, ordinal int")
