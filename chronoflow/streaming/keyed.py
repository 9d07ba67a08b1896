"""Point-in-time features over a stream, from keyed state.

Each row goes to its pair, its source and its target; a key's state is its daily counts of the last ``KEEP`` days and, of
the days before, their number and their first and last day. A tick touches the state of its own keys only and reads no
history. Its events join the state first, and a query counts days before its own, so that the order inside a tick does
not matter and queries never advance state.

Late events count for all later queries, however late they are. A late query is answered too, unless its longest window
reaches days that its key has folded: then it is marked late, with null features. A query that comes in time never is.

Degrees and ranks need more than one key and go through two states, one behind the other. The state of a pair of nodes is
its last day in each direction; what an event changes there (a first contact, a partner's last day that moves) becomes a
row for each of its nodes, summed up before it is dealt again. The state of a node is the number of its partners by their
last day, as long as the calendar, and its degrees. So a hub's state does not hold its partners, and a tick brings it as
many rows as there are days and tasks, not events. These columns are null for a query that comes behind a later event of
its pair or of one of its nodes.

Keys come in shares, as a call of Python for each key cost more than its work. A share's state is a map of ``BUCKETS``
entries, each with the states of some keys as JSON, as a call of the state store for each key cost more than its work too.
A tick reads and writes the entries of its own keys only; what one call holds are the tick's rows of a share and these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from chronoflow.operators.features import BASE4, shaped

WINDOWS = (7, 30, 90)
KEEP = max(WINDOWS)
PART = "query_id long, kind string, day int, first int, last int, n long, n7 long, n30 long, n90 long, late boolean, deg long, partners long, later long"
CONTACT = "node long, kind string, day int, bucket int, n long, query_id long"
# What a pair, a source and a target can answer, and what goes by contacts and ranks.
CONTACTS = ("deg_s", "deg_c", "out_deg_s", "in_deg_c", "rec_rank", "n_partners_s")
COLUMNS = (*BASE4, "src_seen", "src_recency", "src_freq", "dst_freq", "dst_freq30", "pair_freq", "pair_age", "dst_freq7", "dst_freq90", "src_freq30", "dt_1", "dt_2", "dt_7")
SHARES = 128  # what the keys of a kind are dealt in: a tick calls Python once for each, not for each key
BUCKETS = 16  # what the states of a share's keys are kept in
NEVER = -(1 << 31)
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_key(rows: DataFrame) -> DataFrame:
    """Each row (query_id, s, d, day, is_query) once for each of its keys."""
    text = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    keys = [F.struct(F.lit(kind).alias("kind"), text(*cols).alias("key")) for kind, cols in (("pair", "sd"), ("src", "s"), ("dst", "d"))]
    return rows.select(F.explode(F.array(*keys)).alias("k"), "query_id", "day", "is_query").select("k.kind", "k.key", "query_id", "day", "is_query")


def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: MapState) -> Iterator[pd.DataFrame]:
    """One tick of the keys of a share: a key's events join its state, its queries are answered. Rows come in chunks, of
    which only the events' number by key and day and the queries are held."""
    counted, asked = [], []
    for rows in chunks:
        query = rows["is_query"].to_numpy(bool)
        counted.append(rows[~query].groupby(["key", "day"]).size())
        asked.append(rows.loc[query, ["key", "query_id", "day"]])
    new: dict[str, dict[int, int]] = {}
    for (name, day), n in pd.concat(counted).items():
        mine = new.setdefault(name, {})
        mine[int(day)] = mine.get(int(day), 0) + int(n)
    asked = pd.concat(asked)
    numbers = asked[["query_id", "day"]].to_numpy(np.int64)
    queries = {name: numbers[at] for name, at in asked.reset_index(drop=True).groupby("key").indices.items()}
    out = []
    for name in sorted(new.keys() | queries.keys()):
        days, counts, folded, first, last = state.getValue((name,)) or ([], [], 0, None, None)
        known = dict(zip(days, counts))
        for day, n in new.get(name, {}).items():
            known[day] = known.get(day, 0) + n
        if name in queries:
            out.append(_answers(queries[name], known, folded, first, last))
        if name in new:
            # Days that were folded before and days that no window of a query in time can reach.
            old = sorted(x for x in known if x < max(known) - KEEP or (last is not None and x <= last))
            if old:
                folded += sum(known.pop(x) for x in old)
                first, last = min(old[0], old[0] if first is None else first), max(old[-1], old[-1] if last is None else last)
            days = sorted(known)
            state.updateValue((name,), (days, [known[x] for x in days], folded, first, last))
    if out:
        yield _own_parts(key[0], [np.concatenate(c) for c in zip(*out)])


def _answers(q: np.ndarray, known: dict[int, int], folded: int, first: int | None, last: int | None) -> tuple[np.ndarray, ...]:
    """Of each query (query_id, day) of a key: these two, the first and last day and number of events before it, the
    numbers of the windows, whether there are any events and whether it is late."""
    # Late events on folded days are counted with them.
    days = np.array(sorted(known), np.int64)
    sums = np.concatenate([[0], np.cumsum([known[int(x)] for x in days], dtype=np.int64)]).astype(np.int64)
    before = np.searchsorted(days, q[:, 1])  # how many known days lie before each query's
    late = np.full(len(q), False) if last is None else q[:, 1] - KEEP <= last
    total = folded + sums[before]
    lows = days[0] if len(days) else 0
    lowest = lows if first is None else min(first, lows) if len(days) else first
    highest = np.where(before > 0, days[np.maximum(before, 1) - 1] if len(days) else 0, 0 if last is None else last)
    if last is not None:
        highest = np.maximum(highest, last)
    back = [sums[before] - sums[np.searchsorted(days, q[:, 1] - w)] for w in WINDOWS]
    return q[:, 0], q[:, 1], np.full(len(q), lowest, np.int64), highest, total, *back, total > 0, late


def _blank(a: np.ndarray, keep: np.ndarray, kind: str = "Int64") -> pd.api.extensions.ExtensionArray:
    return pd.array(pd.Series(np.where(keep, a, 0), dtype=kind).mask(~keep))


def _own_parts(kind: str, found: list[np.ndarray]) -> pd.DataFrame:
    query_id, day, first, last, n, *back, some, late = found
    out = {"query_id": query_id, "kind": kind, "day": day.astype(np.int32), "first": _blank(first, some & ~late, "Int32"), "last": _blank(last, some & ~late, "Int32"), "n": _blank(n, ~late)}
    out |= {f"n{w}": _blank(c, ~late) for w, c in zip(WINDOWS, back)}
    none = _blank(n, np.full(len(n), False))
    return pd.DataFrame(out | {"late": late, "deg": none, "partners": none, "later": none})


def met(key: tuple, chunks: Iterator[pd.DataFrame], state: MapState) -> Iterator[pd.DataFrame]:
    """One tick of the pairs of a share (two nodes, the smaller one first): what a pair's events change for each of its
    nodes, and its queries, with the pair's last day, for the ends. Days go in order, a day's queries before its events."""
    out: list[tuple] = []
    rows = pd.concat(list(chunks)).sort_values(["a", "b", "day", "is_query"], ascending=[True, True, True, False])
    columns = [rows[c].tolist() for c in ("a", "b", "s", "d", "day", "query_id", "is_query")]
    for pair, own in groupby(zip(*columns), key=lambda x: x[:2]):
        forth, back = state.getValue(pair) or (None, None)
        last, changed = {True: forth, False: back}, False
        newest = max([x for x in (forth, back) if x is not None], default=None)
        for _, _, s, d, day, query_id, is_query in own:
            way, mine = bool(s <= d), last[bool(s <= d)]
            if is_query:
                late = newest is not None and newest >= day
                out += [(s, "ask_s", day, mine, int(late), query_id), (d, "ask_c", day, None, int(late), query_id)]
                continue
            if mine is None and (s == d or last[not way] is None):
                out += [(x, "deg", day, None, 1, None) for x in dict.fromkeys((s, d))]
            if mine is None:
                out.append((d, "in", day, None, 1, None))
            elif day > mine:
                out.append((s, "out", day, mine, -1, None))
            if mine is None or day > mine:
                out.append((s, "out", day, day, 1, None))
                last[way], changed = day, True
        if changed:
            state.updateValue(pair, (last[True], last[False]))
    if out:
        yield pd.DataFrame(out, columns=["node", "kind", "day", "bucket", "n", "query_id"]).astype({"node": "int64", "day": "int32", "bucket": "Int32", "n": "int64", "query_id": "Int64"})


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes of one node, day and bucket as one row; queries as they are."""
    for rows in batches:
        asks = rows[rows["query_id"].notna()]
        moves = rows[rows["query_id"].isna()].groupby(["node", "kind", "day", "bucket"], dropna=False, as_index=False)["n"].sum()
        yield asks
        yield moves[moves["n"] != 0].assign(query_id=pd.array([pd.NA] * int((moves["n"] != 0).sum()), "Int64"))[list(rows.columns)]


def ranked(key: tuple, chunks: Iterator[pd.DataFrame], state: MapState) -> Iterator[pd.DataFrame]:
    """One tick of the nodes of a share: the changes join a node's state, its queries are answered as of their days."""
    moves, asks = [], []
    for rows in chunks:
        q = rows["query_id"].notna()
        moves.append(rows[~q].groupby(["node", "kind", "day", "bucket"], dropna=False, as_index=False)["n"].sum())
        asks.append(rows[q])
    moves, asks = pd.concat(moves).sort_values(["node", "day"]), pd.concat(asks).sort_values(["node", "day"])
    steps = {node: list(own) for node, own in groupby(zip(*[moves[c].tolist() for c in ("node", "kind", "day", "bucket", "n")]), key=lambda x: x[0])}
    # Of each query: day, query_id, whether it asks for a source, the candidate's last day (none: before all), whether it is late.
    asked = np.column_stack([asks["day"], asks["query_id"].astype(np.int64), asks["kind"] == "ask_s", asks["bucket"].fillna(NEVER), asks["n"] > 0]).astype(np.int64)
    cuts = np.flatnonzero(np.diff(asks["node"].to_numpy(np.int64))) + 1
    nodes = asks["node"].to_numpy(np.int64)[np.concatenate([[0], cuts])] if len(asks) else []
    queries = dict(zip([int(x) for x in nodes], np.split(asked, cuts)))
    out = []
    for node in sorted(steps.keys() | queries.keys()):
        days, counts, deg, into, newest = state.getValue((node,)) or ([], [], 0, 0, None)
        partners, todo, at = dict(zip(days, counts)), steps.get(node, []), 0
        own = queries.get(node, asked[:0])
        for day in [*np.unique(own[:, 0]), None]:
            while at < len(todo) and (day is None or todo[at][2] < day):
                _, kind, _, bucket, n = todo[at]
                if kind == "out":
                    partners[int(bucket)] = partners.get(int(bucket), 0) + int(n)
                elif kind == "deg":
                    deg += int(n)
                else:
                    into += int(n)
                at += 1
            if day is None:
                break
            rows = own[own[:, 0] == day]
            some = sorted(x for x in partners if partners[x])
            sums = np.concatenate([[0], np.cumsum([partners[x] for x in some], dtype=np.int64)]).astype(np.int64)
            source, late = rows[:, 2] > 0, (rows[:, 4] > 0) | (newest is not None and newest >= day)
            later = sums[-1] - sums[np.searchsorted(np.array(some, np.int64), rows[:, 3], "right")]
            out.append((rows[:, 1], rows[:, 0], source, late, np.full(len(rows), deg, np.int64), np.where(source, sums[-1], into), later, source & (rows[:, 3] > NEVER)))
        if todo:
            some = sorted(x for x in partners if partners[x])
            state.updateValue((node,), (some, [partners[x] for x in some], deg, into, max(max(x[2] for x in todo), newest if newest is not None else NEVER)))
    if out:
        query_id, day, source, late, deg, partners, later, known = [np.concatenate(c) for c in zip(*out)]
        made = pd.DataFrame({"query_id": query_id, "kind": np.where(source, "of_s", "of_c"), "day": day.astype(np.int32)})
        none = np.full(len(made), False)
        for c in ("first", "last", "n", "n7", "n30", "n90"):
            made[c] = _blank(day, none, "Int32" if c in ("first", "last") else "Int64")
        made["late"], made["deg"], made["partners"], made["later"] = late, _blank(deg, ~late), _blank(partners, ~late), _blank(later, known & ~late)
        yield made


class Buckets:
    """The states of a share's keys, read from a map's entries as they are asked for and written back by ``write``."""

    def __init__(self, state: MapState):
        self.state, self.held, self.changed = state, {}, set()

    def _bucket(self, key: tuple) -> tuple[int, dict]:
        at = crc32("|".join(map(str, key)).encode()) % BUCKETS
        if at not in self.held:
            found = self.state.getValue((at,))
            self.held[at] = {tuple(k): v for k, v in json.loads(found[0])} if found else {}
        return at, self.held[at]

    def getValue(self, key: tuple):  # noqa: N802
        return self._bucket(key)[1].get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        at, held = self._bucket(key)
        held[key] = value
        self.changed.add(at)

    def write(self) -> None:
        for at in sorted(self.changed):
            self.state.updateValue((at,), (json.dumps(list(self.held[at].items()), default=int, separators=(",", ":")),))


class Step(StatefulProcessor):
    """One of the steps above as a processor."""

    def __init__(self, step):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("held", "bucket int", "states string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = Buckets(self.state)
        out = list(self.step(key, rows, held))
        held.write()
        yield from out


def _stepped(rows: DataFrame, group: list[str], own: list[str], step, schema: str) -> DataFrame:
    """``step`` over the keys ``own`` of ``rows``, dealt in ``SHARES`` (of each of ``group``)."""
    shared = rows.withColumn("share", F.pmod(F.xxhash64(*own), F.lit(SHARES)))
    return shared.groupBy(*group, "share").transformWithStateInPandas(Step(step), schema, "Append", "None")


def contacts(stream: DataFrame) -> DataFrame:
    """What each end of each query has met; an append-only stream."""
    pair = stream.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"), "s", "d", "day", "query_id", "is_query")
    moves = _stepped(pair, [], ["a", "b"], met, CONTACT)
    return _stepped(moves.mapInPandas(summed, CONTACT), [], ["node"], ranked, PART)


def parts(stream: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """What each key of each query has seen; an append-only stream."""
    own = _stepped(by_key(stream), ["kind"], ["key"], advance, PART)
    return own.unionByName(contacts(stream)) if set(columns) & set(CONTACTS) else own


def start(stream: DataFrame, root: str, columns: tuple[str, ...] = COLUMNS) -> StreamingQuery:
    """Runs the stream over what is there, for ``columns`` of the features, keyed state in RocksDB under ``root``, whose folder the executors share.

    Each partition of state costs a task of Python, a load and a commit in every step of every tick, whatever it holds: a
    new stream has as many as the cluster has cores and the session shuffle partitions at most. A restart keeps its own."""
    spark = stream.sparkSession
    made = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, PARTITIONS: str(min(spark.sparkContext.defaultParallelism, int(spark.conf.get(PARTITIONS))))}
    before = {name: spark.conf.get(name) for name in made}
    for name, value in made.items():
        spark.conf.set(name, value)
    try:
        writer = parts(stream, columns).writeStream.format("parquet").option("path", f"{root}/parts").option("checkpointLocation", f"{root}/checkpoint")
        return writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def answers(parts: DataFrame, columns: tuple[str, ...] = BASE4) -> DataFrame:
    """query_id, late and the features (of all 23) of each query, from the parts of its keys."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = [of(kind, c).alias(f"{kind}_{c.removeprefix('n') if c in ('n7', 'n30', 'n90') else c}") for kind in ("pair", "src", "dst") for c in ("first", "last", "n", "n7", "n30", "n90")]
    ends = [of("of_s", "deg").alias("n_deg_s"), of("of_c", "deg").alias("n_deg_c"), of("of_s", "partners").alias("out_deg"), of("of_c", "partners").alias("in_deg"), of("of_s", "later").alias("later")]
    own, behind = F.col("kind").isin("pair", "src", "dst"), F.col("kind").isin("of_s", "of_c")
    late = [F.max(F.when(c, F.col("late"))).alias(name) for c, name in ((own, "late_own"), (behind, "late_behind"))]
    r = parts.groupBy("query_id").agg(F.max("day").alias("day"), *late, *wide, *ends).withColumn("partners", F.col("out_deg"))
    asked = set(columns) & set(CONTACTS)
    flags = r.select("query_id", "late_own", "late_behind")
    made = shaped(r, columns).join(flags, "query_id")
    any_late = F.col("late_own") | (F.col("late_behind") if asked else F.lit(False))
    return made.select("query_id", any_late.alias("late"), *[F.when(~F.col("late_behind" if c in asked else "late_own"), F.col(c)).alias(c) for c in columns])
