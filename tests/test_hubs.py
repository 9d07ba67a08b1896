"""Counts that list nothing: partner ranks, numbered incidences and day totals against plain loops over a graph with a hub."""

import math
import random

import pytest

from chronoflow.operators import asof, features as feat, ranking
from test_operators import asked, edge_table, events

RND = random.Random(12)
ROWS = sorted({(0 if RND.random() < 0.5 else RND.randrange(8), RND.randrange(12), RND.randrange(40)) for _ in range(500)}, key=lambda x: x[2])


def lasts(rows, s, day):
    out = {}
    for a, b, t in rows:
        if a == s and t < day:
            out[b] = max(t, out.get(b, t))
    return out


def test_partner_ranks_equal_loops(spark):
    queries = [(k, RND.randrange(9), RND.randrange(13), RND.choice((0, 1, 15, 39, 40, 77, RND.randrange(40)))) for k in range(150)]
    got = {x.query_id: x for x in feat.partner_ranks(events(spark, ROWS), spark.createDataFrame(queries, "query_id long, s long, d long, day int")).collect()}
    assert len(got) == len(queries)
    for k, s, d, day in queries:
        last = lasts(ROWS, s, day)
        mine = last.get(d)
        x = got[k]
        assert (x.partners, x.mine) == (len(last), mine)
        assert x.later == (None if mine is None else sum(t > mine for t in last.values()))
        assert x.equal == (None if mine is None else sum(t == mine for t in last.values()))


def test_partner_ranks_without_events(spark):
    x = feat.partner_ranks(events(spark, []), asked(spark, 1, 2, 3)).first()
    assert (x.partners, x.mine, x.later, x.equal) == (0, None, None, None)


def test_recency_ranks_equal_loops(spark):
    val_end = sum(t < 25 for *_, t in ROWS)
    got = {x.event_idx: x.rank for x in ranking.recency_ranks(edge_table(spark, ROWS, 100, val_end), spark.createDataFrame([(20,)], "n_nodes long")).collect()}
    assert set(got) == set(range(val_end, len(ROWS)))
    for k in got:
        s, d, day = ROWS[k]
        others = {b for a, b, t in ROWS if a == s and t == day and b != d}
        last = {n: t for n, t in lasts(ROWS, s, day).items() if n not in others}
        score = lambda n: last.get(n, -1)  # noqa: E731, B023
        rest = [n for n in range(20) if n != d and n not in others]
        assert got[k] == 1 + sum(score(n) > score(d) for n in rest) + 0.5 * sum(score(n) == score(d) for n in rest)


@pytest.mark.parametrize("block, hub", ((3, 100), (4096, 0), (4096, 10**6)))
def test_incidences_are_numbered_in_order(spark, monkeypatch, block, hub):
    monkeypatch.setattr(asof, "BLOCK", block)
    monkeypatch.setattr(asof, "HUB", hub)
    got = {}
    for x in asof.incidence(edge_table(spark, ROWS)).collect():
        got.setdefault(x.node, []).append((x.rn, x.day, x.event_idx, x.dir))
    for node, rows in got.items():
        want = sorted((t, k, side) for k, (s, d, t) in enumerate(ROWS) for side, end in ((0, s), (1, d)) if end == node)
        assert sorted(rows) == [(n + 1, *w) for n, w in enumerate(want)]


@pytest.mark.parametrize("light", (2, 512))
def test_common_neighbours_equal_loops(spark, monkeypatch, light):
    monkeypatch.setattr(feat, "LIGHT", light)
    rows = [*ROWS, (3, 3, 5), (0, 0, 2)]
    queries = [(k, RND.randrange(9), RND.randrange(13), RND.randrange(42)) for k in range(80)]
    got = {x.query_id: x for x in feat.common_neighbors(events(spark, rows), spark.createDataFrame(queries, "query_id long, s long, d long, day int")).collect()}
    assert len(got) == len(queries)
    for k, s, c, day in queries:
        past = [(a, b, t) for a, b, t in rows if t < day]
        met = {}
        for a, b, t in past:
            for x, y in ((a, b), (b, a)):
                met.setdefault(x, {})[y] = max(t, met.get(x, {}).get(y, t))
        both = set(met.get(s, {})) & set(met.get(c, {}))
        paths = {b for a, b, _ in past if a == s} & {a for a, b, _ in past if b == c}
        x = got[k]
        assert (x.cn, x.cn_recent) == (len(both), sum(met[s][m] >= day - 30 and met[c][m] >= day - 30 for m in both))
        assert x.aa == pytest.approx(sum(1 / math.log(1 + len(met[m])) for m in both)) and x.two_hop == pytest.approx(math.log(1 + len(paths)))
