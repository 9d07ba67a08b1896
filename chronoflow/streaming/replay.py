"""Point-in-time features over a stream of days.

Every micro-batch is a day (one file, read with ``maxFilesPerTrigger=1``) of events and queries. The queries are
answered from the days before, then the events join the state; queries never do. State and answers are written by
batch number, so that a batch that is repeated after a failure replaces itself. Rows of a day that is not after the
last one are late: they go to a folder of their own and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoflow.operators.features import BASE4, features

SCHEMA = "query_id long, s long, d long, day int, is_query boolean"


class Replay:
    """Answers ``columns`` for each query; folders ``state``, ``answers`` and ``late`` lie under ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = BASE4):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns

    def _before(self, batch: int) -> DataFrame:
        empty = self.spark.createDataFrame([], "s long, d long, day int, batch long")
        if not batch:
            return empty
        return self.spark.read.schema("s long, d long, day int, batch long").parquet(f"{self.root}/state").where(F.col("batch") < batch)

    def step(self, rows: DataFrame, batch: int) -> None:
        """One tick. With a batch number of its own each write is a folder that a repeat overwrites."""
        past = self._before(batch)
        last = past.agg(F.coalesce(F.max("day"), F.lit(-1)).alias("last"))
        marked = rows.crossJoin(F.broadcast(last))
        fresh, late = marked.where("day > last").drop("last"), marked.where("day <= last").drop("last")
        late.write.mode("overwrite").parquet(f"{self.root}/late/batch={batch}")
        asked = fresh.where("is_query").select("query_id", "s", "d", "day")
        # Events of the same tick may hold several days; a query sees those before its own.
        known = past.select("s", "d", "day").unionByName(fresh.where("NOT is_query").select("s", "d", "day"))
        features(known, asked, self.columns).write.mode("overwrite").parquet(f"{self.root}/answers/batch={batch}")
        fresh.where("NOT is_query").select("s", "d", "day").write.mode("overwrite").parquet(f"{self.root}/state/batch={batch}")

    def start(self, source: str) -> StreamingQuery:
        """Runs over the files that are in ``source``, one a tick in the order of their time, and ends."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def answers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/answers").drop("batch")


def daily_counts(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events of each day of a stream, final once the watermark has passed the day."""
    day = F.window(F.col(time), "1 day")
    return stream.withWatermark(time, delay).groupBy(day).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("dt"), "n")
