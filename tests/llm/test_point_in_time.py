"""The point-in-time table against a walk over all rows, in chunks so small that clients and items span many."""

import math
import random
import zlib
from datetime import datetime, timedelta

import pytest

from chronoflow.llm import point_in_time as pit

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, chunk string, m long"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, t string"
LINES = "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, client string, start long"
ZERO = datetime(2024, 1, 1)


def us(x):
    return None if x is None else (x - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def cents(x):
    return 0 if x is None or not abs(x) < 9e13 else math.floor(100 * x + 0.5)


def walk(clicks, sales, lines):
    day, late = 86_400_000_000, 240 * 60_000_000
    out = []
    for sale_id, client, _, _, sold, _, _, _ in sales:
        if client is None or sold is None:
            continue
        t = us(sold) + (zlib.crc32(str(sale_id).encode()) if sale_id is not None else 0) % 259_200 * 1_000_000
        label = any(x[1] == client and x[4] is not None and t < us(x[4]) <= t + 7 * day for x in sales)
        for d in (2, 14):
            within = lambda at, arrived: at is not None and arrived is not None and t - d * day < us(at) <= t and us(arrived) + late <= t  # noqa: E731, B023
            c = [x for x in dict.fromkeys(clicks) if x[3] == client and within(x[1], x[2])]
            s = [x for x in sales if x[1] == client and within(x[4], x[5])]
            rows = [y for x in s for y in lines if x[0] is not None and y[0] == x[0] and y[4] is not None and us(y[4]) <= t]
            last = max(c, key=lambda x: (x[1], x[0] is not None, x[0] or 0), default=[None])[0]
            out.append((sale_id, d, t, label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(s), sum(cents(x[3]) for x in s), len(rows), len({y[2] for y in rows} - {None}), sum(cents(y[3]) for y in rows)))
    return out


def shop(seed, n, hot):
    r = random.Random(seed)
    when = lambda days=25: None if r.random() < 0.04 else ZERO + timedelta(hours=r.randrange(days * 24))
    some = lambda x: None if r.random() < 0.05 else x
    later = lambda t: None if t is None or r.random() < 0.04 else t + timedelta(minutes=r.choice((0, 1, 240, 5000)))
    client = lambda: some(0 if r.random() < hot else r.randrange(12))
    clicks = [(some(k), t := when(), later(t), client(), some(r.choice(("purchase", "view"))), some(r.choice((0.005, 12.345, -3.1, float("nan"), float("inf")))), some("{}"), "x", 1) for k in range(n)]
    clicks += r.choices(clicks, k=n // 10)
    sales = [(k, client(), "done", some(round(r.random() * 50, 3)), t := when(), later(t), 1, "x") for k in range(n // 2)]
    lines = [(some(0 if r.random() < hot else r.randrange(n // 2 + 5)), 1, some(0 if r.random() < hot else r.randrange(6)), some(r.random() * 9), when(40), "x", 1) for _ in range(2 * n)]
    return clicks, sales, lines + r.choices(lines, k=n // 10)


def result(spark, clicks, sales, lines):
    return pit.point_in_time(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)).collect()


order = lambda rows: sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("hot", (0.1, 0.6))
def test_equals_the_walk_with_nulls_ties_and_repeated_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(pit, "CHUNK", 60)
    data = shop(3, 240, hot)
    data[1].append(data[1][7])
    data[1].append((None, 0, "done", 1.0, ZERO + timedelta(days=3), ZERO + timedelta(days=3), 1, "x"))
    assert order(result(spark, *data)) == order(walk(*data))


def test_empty_tables(spark):
    assert result(spark, [], [], []) == []
    sale = (5, 1, "done", 2.5, ZERO, ZERO - timedelta(hours=4), 1, "x")
    got = result(spark, [], [sale], [])
    assert order(got) == order(walk([], [sale], []))
    assert [x.n_sales for x in got if x.d == 14] == [1]
