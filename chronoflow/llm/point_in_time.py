"""A point-in-time feature table: what was known of a client at the moment of each of its sales.

A sale asks at a time t of its own. A record (click, sale, sale line, item) counts for the window of d days from the moment
it is known, max(its time, its arrival + ``DELAY``), until its time + d days, if that is later: an interval on the client's
time line. A count or sum at t is the total of the starts up to t less the total of the expiries up to t.

Starts and expiries are points of one table, dealt by ranges of (client, time): a chunk has whole clients or a stretch of
one client's time, and as many rows as any other, so a client with a third of all rows is many chunks. In a chunk numpy
sorts starts and expiries by client and time, adds up prefix sums, and finds each sale's place in them by binary search.
The totals of a client's earlier chunks come as base points before all times. Distinct items are counted by first taking
the union of the intervals of each client and item; the same dealing by ranges serves there, what carries over to the next
chunk being the latest expiry so far.

Null times, arrivals and clients count nowhere; a null or unbounded amount is 0 cents; null click ids come last among
clicks of one time. Equal clicks count once; equal sales are sales of their own (each returns its rows) and equal lines
are lines of their own. A null sale_id has no lines and the remainder 0. Times are taken as they stand, as UTC. Empty
tables give no rows, or zeros; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoflow.llm.store import dropped, written

DAY = 86_400_000_000
WINDOWS = (2, 14)
HORIZON = 7
DELAY = 240 * 60_000_000
SPREAD = 259_200
CHUNK = 300_000
CLICK, SALE, LINE, ITEM, LABEL, QUERY = range(6)  # sales last
FIRST = -(1 << 62)  # before all times
LARGEST = 9e13
POINT = "client long, t long, m int, sign int, lo int, hi int, n long, n2 long, cents long, ts long, id long"


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp as it reads, whatever the session's zone."""
    c = F.col(name)
    of_day = F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
    return (F.unix_date(c.cast("date")).cast("long") * 86400 + of_day) * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def cents(name: str) -> Column:
    return F.when(F.abs(F.col(name)) < LARGEST, F.floor(F.col(name) * 100 + 0.5)).otherwise(0).cast("long")


def dealt(rows: DataFrame, *order: str, size: int = 0) -> DataFrame:
    """The rows in chunks of at most ``size``, each a stretch of the rows in ``order``: chunk is its number."""
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    within = F.floor(F.col("_n").bitwiseAND((1 << 33) - 1) / (size or CHUNK))
    return written(ids.withColumn("chunk", F.shiftleft(F.shiftright("_n", 33), 33) + within).drop("_n"), "chunks")


def carried(chunks: DataFrame, keys: list[str], sides: list[str], aggregates: dict[str, tuple]) -> DataFrame:
    """For each chunk after the first of a key that spans several: the aggregates over the key's earlier chunks, by
    ``sides`` too. ``aggregates``: name -> (of rows, of aggregates). Rows are added up by chunk before anything else, so a
    key with many rows is as many rows here as it has chunks."""
    ends = chunks.groupBy(*keys).agg(F.min("chunk").alias("_a"), F.max("chunk").alias("_z")).where("_a < _z")
    part = chunks.groupBy(*keys, *sides, "chunk").agg(*[f(c).alias(c) for c, (f, _) in aggregates.items()])
    part = written(part.join(ends, keys, "left_semi"), "totals")
    own = part.select(*keys, "chunk").distinct()
    grid = part.select(*keys, *sides).distinct().join(own, keys)
    before = W.partitionBy(*keys, *sides).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    names = [*keys, *sides, "chunk"]
    full = grid.join(part, names, "left").select(*names, *[f(c).over(before).alias(c) for c, (_, f) in aggregates.items()])
    return full.where(" OR ".join(f"{c} IS NOT NULL" for c in aggregates))


def known(time: Column, arrival: Column) -> Column:
    """When a record is known; null if either is null."""
    return F.when(time.isNotNull() & arrival.isNotNull(), F.greatest(time, arrival + DELAY))


def _points(rows: DataFrame, m: int, windows: tuple[int, ...], start: str, time: str) -> DataFrame:
    """Start and expiries of intervals that begin at ``start`` and end at ``time`` + d days. A start counts for all
    windows from the first one that is longer than the wait for it."""
    ends = [F.col(time) + d * DAY for d in windows]
    lo = sum((F.when(F.col(start) >= e, 1).otherwise(0) for e in ends), F.lit(0))
    last = len(windows) - 1
    point = lambda t, sign, a, z, *own: F.struct(t.cast("long").alias("t"), F.lit(sign).alias("sign"), a.cast("int").alias("lo"), z.cast("int").alias("hi"))
    all_points = F.array(point(F.col(start), 1, F.col("_lo"), F.lit(last)), *[F.when(F.col("_lo") <= k, point(e, -1, F.lit(k), F.lit(k))) for k, e in enumerate(ends)])
    r = rows.withColumn("_lo", lo).where(F.col(start).isNotNull() & F.col("client").isNotNull() & (F.col("_lo") <= last))
    r = r.withColumn("p", F.explode(F.filter(all_points, lambda x: x.isNotNull())))
    zero = lambda c: F.col(c) if c in rows.columns else F.lit(None if c in ("ts", "id") else 0).cast("long").alias(c)
    own = lambda c: F.when(F.col("p.sign") == 1, F.col(c)).alias(c) if c in rows.columns else zero(c)
    return r.select("client", "p.t", F.lit(m).alias("m"), "p.sign", "p.lo", "p.hi", *[zero(c) for c in ("n", "n2", "cents")], own("ts"), own("id"))


def click_points(clicks: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    h = [F.xxhash64("props").alias("_x"), F.hash(F.lit(7), "props").alias("_h"), F.length("props").alias("_l")]
    c = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", *h).distinct()
    c = c.select(F.col("client_id").alias("client"), micros("ts").alias("ts"), micros("arrived_at").alias("_at"), F.col("click_id").alias("id"), F.lit(1).cast("long").alias("n"), F.when(F.col("kind") == "purchase", 1).otherwise(0).cast("long").alias("n2"), cents("value").alias("cents"))
    return _points(c.withColumn("start", known(F.col("ts"), F.col("_at"))), CLICK, windows, "start", "ts")


def _unions(windows: tuple[int, ...]):
    """Over a chunk of (client, item, start, sold), base rows before: the starts and expiries of the union of each client's
    and item's intervals [start, sold + d days), for each d."""

    def run(table: pa.Table) -> pa.Table:
        client, item, start = (table[c].to_numpy() for c in ("client", "item", "start"))
        order = np.lexsort((start, item, client))
        client, item, start = client[order], item[order], start[order]
        new = np.r_[True, (client[1:] != client[:-1]) | (item[1:] != item[:-1])]
        group = np.cumsum(new) - 1
        out = []
        for k, d in enumerate(windows):
            end = table[f"end{k}"].to_numpy()[order]
            base = start == FIRST
            # Before an interval the latest end of its group's earlier ones: as groups ascend, a running maximum of
            # (group, rank of end) never looks back into another group.
            value, rank = np.unique(end, return_inverse=True)
            top = np.maximum.accumulate(group * len(value) + rank)
            ahead = np.r_[np.int64(FIRST), value[top[:-1] % len(value)]] if len(end) else end
            begin = np.maximum(start, np.where(new, FIRST, ahead))
            on = ~base & (begin < end)
            for t, sign in ((begin[on], 1), (end[on], -1)):
                out.append(pa.table({"client": client[on], "t": t, "sign": np.full(len(t), sign, np.int32), "lo": np.full(len(t), k, np.int32), "hi": np.full(len(t), k, np.int32)}))
        return pa.concat_tables(out)

    return run


def item_points(lines: DataFrame, windows: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Points of the union of intervals by client and item, and the written table that they read; ``lines``: client, item,
    start, time."""
    ends = [F.when(F.col("start") < F.col("time") + d * DAY, F.col("time") + d * DAY).otherwise(FIRST).alias(f"end{k}") for k, d in enumerate(windows)]
    # Of the lines of one sale and item only the first start matters.
    rows = lines.where("item IS NOT NULL").groupBy("client", "item", "time").agg(F.min("start").alias("start"))
    chunks = dealt(rows.select("client", "item", "start", *ends), "client", "item", "start")
    names = [f"end{k}" for k in range(len(windows))]
    base = carried(chunks, ["client", "item"], [], {c: (F.max, F.max) for c in names})
    both = chunks.unionByName(base.select("client", "item", F.lit(FIRST).alias("start"), *names, "chunk"))
    points = both.groupBy("chunk").applyInArrow(_unions(windows), "client long, t long, sign int, lo int, hi int")
    none = [F.lit(None).cast("long").alias(c) for c in ("ts", "id")]
    points = points.select("client", "t", F.lit(ITEM).alias("m"), "sign", "lo", "hi", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n2"), F.lit(0).cast("long").alias("cents"), *none)
    return points, chunks


def _answers(windows: tuple[int, ...]):
    """Over a chunk of points and sales: the counts and sums of each sale and window."""

    def run(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("t", "m", "sign", "lo", "hi", "n", "n2", "cents")}
        ids, client = np.unique(table["client"].to_numpy(), return_inverse=True)
        times, at = np.unique(col["t"], return_inverse=True)
        place = client * len(times) + at  # orders by client and time
        order = np.argsort(place, kind="stable")
        place, client = place[order], client[order]
        col = {c: x[order] for c, x in col.items()}
        asks = np.flatnonzero(col["m"] == QUERY)
        q, first = place[asks], client[asks] * len(times)

        def total(which: np.ndarray, values: tuple[str, ...]) -> list[np.ndarray]:
            """Sums of the client's rows among ``which`` up to each sale's time."""
            p = place[which]
            a, z = np.searchsorted(p, first, "left"), np.searchsorted(p, q, "right")
            sums = [np.r_[np.int64(0), np.cumsum(col[v][which])] for v in values]
            return [s[z] - s[a] for s in sums]

        def active(m: int, k: int, *values: str) -> list[np.ndarray]:
            own = (col["m"] == m) & (col["lo"] <= k) & (k <= col["hi"])
            plus, minus = (total(np.flatnonzero(own & (col["sign"] == s)), values) for s in (1, -1))
            return [x - y for x, y in zip(plus, minus, strict=True)]

        # The latest click that is known: a running maximum of (client, ts, id).
        clicked = np.flatnonzero((col["m"] == CLICK) & (col["sign"] == 1))
        rows = order[clicked]
        ts = table["ts"].combine_chunks().fill_null(FIRST).to_numpy()[rows]
        has_id = table["id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[rows]
        number = table["id"].combine_chunks().fill_null(0).to_numpy()[rows]
        by = np.lexsort((number, has_id, ts, client[clicked]))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        best = by[np.maximum.accumulate(rank)] if len(by) else by
        upto = np.searchsorted(place[clicked], q, "right") - 1
        some = (upto >= 0) & (np.searchsorted(place[clicked], first, "left") <= upto) if len(by) else np.zeros(len(q), bool)
        best = best[np.where(some, upto, 0)] if len(by) else np.zeros(len(q), np.int64)
        t = col["t"][asks]
        (label,) = active(LABEL, 0, "n")
        out = []
        for k, d in enumerate(windows):
            clicks, purchases, click_cents = active(CLICK, k, "n", "n2", "cents")
            sales, sale_cents = active(SALE, k, "n", "cents")
            lines, line_cents = active(LINE, k, "n", "cents")
            (items,) = active(ITEM, k, "n")
            last = some & (ts[best] > t - d * DAY) & has_id[best] if len(by) else some
            last_id = pa.array(number[best] if len(by) else np.zeros(len(q), np.int64), mask=~last)
            sale = table["id"].combine_chunks().take(pa.array(order[asks]))
            out.append(pa.table({"sale_id": sale, "d": np.full(len(q), d, np.int32), "t_us": t, "label": label > 0, "n_clicks": clicks, "n_purchases": purchases, "click_cents": click_cents, "last_click_id": last_id, "n_sales": sales, "sale_cents": sale_cents, "n_lines": lines, "n_items": items, "line_cents": line_cents}))
        return pa.concat_tables(out)

    return run


RESULT = "sale_id long, d int, t_us long, label boolean, n_clicks long, n_purchases long, click_cents long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long"


def point_in_time(clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """For each sale with a client and a time, and each of the ``windows`` (days, ascending): the columns of ``RESULT``."""
    one = F.lit(1).cast("long").alias("n")
    s = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", F.col("client_id").alias("client"), micros("sold_at").alias("time"), micros("arrived_at").alias("_at"), cents("total").alias("cents"))
    s = s.withColumn("start", known(F.col("time"), F.col("_at")))
    asked = F.col("time") + F.coalesce(F.crc32(F.col("sale_id").cast("string")), F.lit(0)) % SPREAD * 1_000_000
    null = F.lit(None).cast("long")
    queries = s.select("client", asked.alias("t"), F.lit(QUERY).alias("m"), F.lit(0).alias("sign"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), *[F.lit(0).cast("long").alias(c) for c in ("n", "n2", "cents")], null.alias("ts"), F.col("sale_id").alias("id"))
    # A sale is ahead of the times from HORIZON days before it until it.
    labels = _points(s.select("client", one, (F.col("time") - HORIZON * DAY).alias("start"), (F.col("time") - DAY).alias("time")), LABEL, (1,), "start", "time")
    sold = _points(s.select("client", one, "cents", "start", "time"), SALE, windows, "start", "time")
    line = sale_lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select("sale_id", F.col("item_id").alias("item"), cents("amount").alias("cents"), micros("shipped_at").alias("_shipped"))
    line = line.join(s.where("start IS NOT NULL").select("sale_id", "client", "time", "start"), "sale_id")
    line = line.select("client", "item", "time", "cents", F.greatest("start", "_shipped").alias("start")).where(F.col("start") < F.col("time") + max(windows) * DAY)
    line = written(line, "lines")
    lines = _points(line.select("client", one, "cents", "start", "time"), LINE, windows, "start", "time")
    lines = lines.groupBy("client", "t", "m", "sign", "lo", "hi").agg(*[F.sum(c).alias(c) for c in ("n", "n2", "cents")], F.max("ts").alias("ts"), F.max("id").alias("id"))
    items, stretches = item_points(line, windows)
    points = click_points(clicks, windows).unionByName(sold).unionByName(labels).unionByName(lines).unionByName(items).unionByName(queries)
    # Points come before the sales of their moment, as a chunk may end there.
    chunks = dealt(points, "client", "t", "m")
    dropped(line, stretches)
    latest = F.max(F.when((F.col("m") == CLICK) & (F.col("sign") == 1), F.struct("ts", "id")))
    base = carried(chunks.where(F.col("m") != QUERY), ["client"], ["m", "sign", "lo", "hi"], {c: (F.sum, F.sum) for c in ("n", "n2", "cents")} | {"latest": (lambda _: latest, F.max)})
    base = base.select("client", F.lit(FIRST).alias("t"), "m", "sign", "lo", "hi", "n", "n2", "cents", F.col("latest.ts").alias("ts"), F.col("latest.id").alias("id"), "chunk")
    return chunks.unionByName(base).groupBy("chunk").applyInArrow(_answers(windows), RESULT)


# DuckDB has no crc32: the table of the reflected polynomial 0xEDB88320, then a step for each digit.
QUERY_SQL = f"""
WITH steps AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
s AS (SELECT sale_id, client_id, total, epoch_us(sold_at) AS at, CASE WHEN arrived_at IS NULL THEN NULL ELSE greatest(epoch_us(sold_at), epoch_us(arrived_at) + {DELAY}) END AS start,
  epoch_us(sold_at) + coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295), 0) % {SPREAD} * 1000000 AS t
  FROM sales, steps WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
q AS (SELECT row_number() OVER () AS r, s.*, d FROM s, (VALUES {", ".join(f"({d})" for d in WINDOWS)}) AS w(d)),
c AS (SELECT client_id, click_id, kind, value, epoch_us(ts) AS at, greatest(epoch_us(ts), epoch_us(arrived_at) + {DELAY}) AS start FROM (SELECT DISTINCT * FROM clicks) WHERE ts IS NOT NULL AND arrived_at IS NOT NULL),
l AS (SELECT s.client_id, s.at, greatest(s.start, epoch_us(shipped_at)) AS start, item_id, amount FROM sale_lines JOIN s USING (sale_id) WHERE s.start IS NOT NULL AND shipped_at IS NOT NULL),
of_clicks AS (SELECT r, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(coalesce(floor(100 * value + 0.5), 0)) AS click_cents, last(click_id ORDER BY c.at, click_id NULLS FIRST) AS last_click_id
  FROM q JOIN c ON c.client_id = q.client_id AND c.start <= q.t AND c.at > q.t - d * {DAY} GROUP BY r),
of_sales AS (SELECT r, count(*) AS n_sales, sum(coalesce(floor(100 * x.total + 0.5), 0)) AS sale_cents FROM q JOIN s AS x ON x.client_id = q.client_id AND x.start <= q.t AND x.at > q.t - d * {DAY} GROUP BY r),
of_lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(floor(100 * amount + 0.5), 0)) AS line_cents FROM q JOIN l ON l.client_id = q.client_id AND l.start <= q.t AND l.at > q.t - d * {DAY} GROUP BY r),
ahead AS (SELECT DISTINCT r FROM q JOIN s AS x ON x.client_id = q.client_id AND x.at > q.t AND x.at <= q.t + {HORIZON * DAY})
SELECT sale_id, d::INTEGER AS d, t AS t_us, ahead.r IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0)::BIGINT AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM q LEFT JOIN of_clicks USING (r) LEFT JOIN of_sales USING (r) LEFT JOIN of_lines USING (r) LEFT JOIN ahead USING (r)"""
