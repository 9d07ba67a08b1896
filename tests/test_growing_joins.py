"""Tables that grow with the input meet by sorted merges: however small their files are, none is sent through the driver."""

from pyspark.sql import functions as F

from chronoflow.operators import daily, features, sampling
from chronoflow.plans import catalogue, views

SF = "/root/testdata/sf0.001"


def sent(df) -> list[str]:
    """The keyed broadcasts of a plan, but those of the calendar, of a table's ranges and of one row."""
    lines = [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    return [x for x in lines if not any(f"{c}#" in x for c in ("day", "_p", "n_nodes"))]


def test_pools_are_not_sent(spark):
    e = catalogue.edges(spark, SF, "party")
    pool = sampling.first_seen(e)
    clocks = e.where("split = 'test'").groupBy(F.col("day").cast("long").alias("clock")).agg(F.count("*").alias("need")).withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(300).cast("long")})
    own = e.select(F.col("day").cast("long").alias("clock"), "src", "dst")
    assert not sent(sampling.from_pool(clocks, pool, own, 1, "x"))
    assert not sent(sampling.unseen_pairs(e.where("split = 'test'"), e, catalogue.n_nodes(e), 1))
    assert not sent(sampling.uniform_targets(e, catalogue.n_nodes(e), 1))


def test_keys_of_the_views_are_not_sent(spark):
    assert not sent(views.nation(spark, SF))
    assert not sent(daily.numbered_edges(daily.daily_edges(views.party(spark, SF), views.ASSETS)))


def test_features_are_not_sent(spark):
    e = catalogue.edges(spark, SF, "party").select("event_idx", F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    assert not sent(features.features(e, e.withColumnRenamed("event_idx", "query_id")))


def test_edges_carry_numbers_alone(spark):
    """Numbers stand in the order of names, so nothing after the numbering shuffles, orders or writes names."""
    e = daily.daily_edges(views.party(spark, SF), views.ASSETS, amounts=False)
    bare, named = daily.numbered_edges(e, names=False), daily.numbered_edges(e)
    assert set(bare.columns) == {"day", "src", "dst", "event_idx", "split"}
    assert catalogue.edges(spark, SF, "party").columns == bare.columns
    rows = named.select("event_idx", "day", "s", "d", "src", "dst").collect()
    assert [x.event_idx for x in sorted(rows, key=lambda x: (x.day, x.s, x.d))] == list(range(len(rows)))
    assert bare.select("event_idx", "day", "src", "dst").exceptAll(named.select("event_idx", "day", "src", "dst")).isEmpty()
