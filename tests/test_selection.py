"""Medians, numbers of strings, adjacency by buckets, samples as pairs of tables, spans of negatives."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_operators import edge_table

from chronoflow.operators import daily, graph, metrics, sampling
from chronoflow.sources import transfers


@pytest.mark.parametrize("bins, few", ((3, 2), (metrics.BINS, metrics.FEW)))
def test_exact_median(spark, monkeypatch, bins, few):
    monkeypatch.setattr(metrics, "BINS", bins)
    monkeypatch.setattr(metrics, "FEW", few)
    r = random.Random(4)
    for values in ([], [5.0], [1.0, 2.0], [3.0] * 40, [r.random() for _ in range(41)], [r.choice((0.0, 1e-300, 1e300, -7.5)) for _ in range(30)], [float(int(10 ** r.uniform(0, 9))) for _ in range(60)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert metrics.exact_median(df, "v") == (statistics.median(values) if values else None)


def test_addresses_are_numbered_in_even_ranges(spark):
    r = random.Random(7)
    rows = sorted({f"0x{r.getrandbits(160):040x}" for _ in range(4000)})
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(rows, len(rows))], "addr string")
    got = daily.numbered(df, "addr", "n")
    assert [x.addr for x in got.orderBy("n").collect()] == rows and got.agg(F.max("n")).first()[0] == len(rows) - 1
    sizes = [x["count"] for x in df.repartitionByRange(16, "addr").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(rows) / 16


KIND = "from_address string, to_address string, transaction_hash string, block_timestamp timestamp_ntz"


def test_a_hop_reads_the_buckets_of_its_frontier(spark):
    rows = spark.createDataFrame([(f"a{k}", f"a{k * 7 % 50}", f"h{k}", None) for k in range(200)] + [(None, "a1", "x", None)], KIND)
    known = graph.adjacency(rows)
    assert known.count() == 400
    plan = known.where(F.col("bucket").isin([3, 5]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan
    assert known.where("bucket = 3").select("anchor").distinct().withColumn("b", graph.bucket_of("anchor")).where("b <> 3").count() == 0


def test_samples_are_saved_as_nodes_edges_and_manifest(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("a"), "id").alias("from_address"), F.lit("b").alias("to_address"), F.concat(F.lit("h"), "id").alias("transaction_hash"), F.timestamp_seconds(1_700_000_000 - F.col("id") * 60).alias("block_timestamp"))
    nodes = rows.select(F.col("from_address").alias("address"))
    assert transfers.save_sample(nodes, rows, f"file://{tmp_path}/s", {"seed": 1}) == {"nodes": 50, "edges": 50, "params": {"seed": 1}}
    times = [x.block_timestamp for x in spark.read.parquet(f"file://{tmp_path}/s/edges").coalesce(1).withColumn("f", F.input_file_name()).collect()]
    back = spark.read.parquet(f"file://{tmp_path}/s/edges").withColumn("f", F.input_file_name()).collect()
    files = sorted({x.f for x in back})
    assert sum([[x.block_timestamp for x in back if x.f == f] for f in files], []) == sorted(times)
    assert transfers.reconciled(spark, f"file://{tmp_path}/s/edges")["rows"] == 50 and spark.read.text(f"file://{tmp_path}/s/manifest").count() == 1
    with pytest.raises(Exception, match="already exists"):
        transfers.save_sample(nodes, rows, f"file://{tmp_path}/s")


def test_negatives_of_a_span_and_of_the_last_targets(spark):
    r = random.Random(3)
    rows = sorted({(r.randrange(10), r.randrange(10, 30), r.randrange(20)) for _ in range(200)}, key=lambda x: x[2])
    e, n = edge_table(spark, rows).cache(), spark.createDataFrame([(30,)], "n_nodes long")
    whole = {x.event_idx: tuple(x) for x in sampling.mixture(e, n, 5).collect()}
    part = {x.event_idx: tuple(x) for x in sampling.mixture(e, n, 5, span=(50, 90)).collect()}
    assert set(part) <= set(range(50, 90)) and part == {k: v for k, v in whole.items() if 50 <= k < 90}
    for x in sampling.mixture(e, n, 5, hard=0.0, popular=1.0, novel=0.0, tokens=3).collect():
        if x.branch == "popular":
            before = sum(day < rows[x.event_idx][2] for *_, day in rows)
            assert x.dst in [d for _, d, _ in rows[max(0, before - 3) : before]]
