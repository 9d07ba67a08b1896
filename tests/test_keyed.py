"""Features from keyed streaming state against the same features of the whole table."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoflow.operators.features import WIDE23, features
from chronoflow.streaming import keyed, replay


def streamed(spark, root, ticks, columns=keyed.COLUMNS):
    for k, rows in enumerate(ticks):
        spark.createDataFrame(rows, replay.SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(replay.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    keyed.start(stream, f"file://{root}", columns).awaitTermination()
    return spark.read.parquet(f"{root}/parts")


@pytest.mark.parametrize("columns", (keyed.COLUMNS, WIDE23), ids=("own keys", "all columns"))
def test_keyed_state(spark, tmp_path, columns):
    draw, n, ticks, every = random.Random(5), 0, [], []
    # 260 days go by, so that early ones are folded; the last tick brings a late event and two late queries.
    for days in ([0, 1, 2], [3], [40, 41], [100], [101, 131], [260]):
        rows = []
        for day in days:
            for is_query in (False, True):
                for _ in range(12):
                    n += 1
                    rows.append((n, draw.randrange(4), draw.randrange(4), day, is_query))
        # Edges are daily: a pair has one a day.
        rows = list({(r[1:], r[0] if r[4] else 0): r for r in rows}.values())
        ticks.append(rows)
        every += rows
    every.append((900, 1, 2, 250, False))
    ticks.append([(900, 1, 2, 250, False), (901, 1, 2, 261, True), (902, 1, 2, 1, True), (903, 1, 2, 165, True)])
    got = keyed.answers(streamed(spark, str(tmp_path), ticks, columns), columns)
    rows = spark.createDataFrame(every + [(901, 1, 2, 261, True)], replay.SCHEMA)
    # Queries of earlier ticks did not see the late event, whose day is after theirs or, on day 260, not yet come.
    seen = rows.where("NOT is_query AND query_id <> 900").select("s", "d", "day")
    first = features(seen, rows.where("is_query AND query_id <> 901").select("query_id", "s", "d", "day"), columns)
    last = features(rows.where("NOT is_query").select("s", "d", "day"), rows.where("query_id = 901").select("query_id", "s", "d", "day"), columns)
    want = {r.query_id: r for r in first.unionByName(last).collect()}
    have = {r.query_id: r for r in got.collect()}
    assert set(have) == set(want) | {902, 903}
    for late in (have[902], have[903]):
        assert late.late and all(late[c] is None for c in columns)
    for k, r in want.items():
        assert not have[k].late
        assert [have[k][c] for c in columns] == pytest.approx([r[c] for c in columns]), k


def test_keyed_state_without_rows(spark, tmp_path):
    parts = spark.createDataFrame([], keyed.PART)
    assert keyed.answers(parts).count() == 0
    assert keyed.by_key(spark.createDataFrame([(1, None, 2, 3, True)], replay.SCHEMA)).select(F.count("key")).first()[0] == 3


class Held(dict):
    """A map state in memory."""

    getValue = dict.get
    updateValue = dict.__setitem__


def test_one_call_serves_all_keys_of_a_share():
    rows = pd.DataFrame([("a", 1, 0, False), ("b", 2, 0, False), ("b", 3, 1, False), ("a", 4, 5, True), ("b", 5, 1, True), ("c", 6, 5, True)], columns=["key", "query_id", "day", "is_query"])
    state = Held()
    got = pd.concat(keyed.advance(("pair", 0), iter([rows[:2], rows[2:]]), state)).set_index("query_id")
    assert got["n"].to_dict() == {4: 1, 5: 1, 6: 0}
    assert got["last"].fillna(-1).to_dict() == {4: 0, 5: 0, 6: -1}
    assert set(state) == {("a",), ("b",)} and state[("b",)][:2] == ([0, 1], [1, 1])
    pairs = pd.DataFrame([(1, 2, 1, 2, 0, 7, False), (1, 2, 2, 1, 3, 8, True), (1, 3, 1, 3, 1, 9, False)], columns=["a", "b", "s", "d", "day", "query_id", "is_query"])
    state = Held()
    moves = pd.concat(keyed.met((0,), iter([pairs]), state))
    assert state == {(1, 2): (0, None), (1, 3): (1, None)}
    nodes = Held()
    ends = pd.concat(keyed.ranked((0,), iter(keyed.summed(iter([moves]))), nodes)).set_index("kind")
    assert set(nodes) == {(1,), (2,), (3,)} and nodes[(1,)][2] == 2
    assert (ends.loc["of_s", "deg"], ends.loc["of_s", "partners"], ends.loc["of_c", "deg"]) == (1, 0, 2)


def test_states_of_a_share_are_read_and_written_by_buckets():
    calls = []

    class Counted(Held):
        def getValue(self, key):
            calls.append(("get", key))
            return self.get(key)

        def updateValue(self, key, value):
            calls.append(("put", key))
            self[key] = value

    rows = pd.DataFrame([(f"k{n}", n, n % 3, False) for n in range(500)], columns=["key", "query_id", "day", "is_query"])
    store, plain = Counted(), Held()
    for part in (rows, rows.assign(day=7)):
        list(keyed.advance(("pair", 0), iter([part]), plain))
        held = keyed.Buckets(store)
        list(keyed.advance(("pair", 0), iter([part]), held))
        held.write()
    assert len(calls) <= 4 * keyed.BUCKETS and len(set(calls)) == len(store) * 2
    again = keyed.Buckets(store)
    assert all(tuple(again.getValue(name)) == state for name, state in plain.items()) and len(plain) == 500
    assert again.getValue(("none",)) is None


def test_state_has_a_partition_a_core_at_most(spark, tmp_path):
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    spark.conf.set(name, cores + 40)
    try:
        streamed(spark, str(tmp_path), [[(1, 1, 2, 0, False), (2, 1, 2, 1, True)]], keyed.BASE4)
        assert spark.conf.get(name) == str(cores + 40)
    finally:
        spark.conf.set(name, before)
    assert len([p for p in (tmp_path / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]) == cores
