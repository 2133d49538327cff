"""Keyed state of a comment service as Structured Streaming: gates, caps, daily counts, upserts.

A gate accepts an event of a key if fewer than ``limit`` events of that key were accepted in the ``seconds`` before it;
rejected events leave no trace. With (30, 3600) it is a visitor's rate limit, with (1, 86400) one vote a day. ``gate`` is the
batch form, for histories; ``gated`` the streaming one, with the accepted times as list state that expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit(accepted: list[float], at: float, limit: int, seconds: float) -> bool:
    """Whether an event passes; ``accepted`` is brought up to date."""
    accepted[:] = [t for t in accepted if at - t < seconds]
    if len(accepted) >= limit:
        return False
    accepted.append(at)
    return True


def gate(events: DataFrame, key: str, limit: int, seconds: float, at: str = "ts", order: str = "event_id") -> DataFrame:
    """``events`` with ``accepted``, in order of time and then ``order``, over each key's own history."""
    rows = events.select(key, order, at, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        held: list[float] = []
        pdf = pdf.sort_values(["_us", order])
        pdf["accepted"] = [admit(held, t / 1e6, limit, seconds) for t in pdf["_us"]]
        return pdf[[key, order, "accepted"]]

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return rows.groupBy(key).applyInPandas(work, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean")


class Gate(StatefulProcessor):
    """(key, ts) in; (key, id, accepted) out."""

    def __init__(self, key: str, limit: int, seconds: float, order: str):
        self.key, self.limit, self.seconds, self.order = key, limit, seconds, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at double", int(self.seconds * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.times.get()] if self.times.exists() else []
        got = pd.concat(list(rows)).sort_values(["ts", self.order])
        accepted = [admit(held, t.timestamp(), self.limit, self.seconds) for t in got["ts"]]
        if held:
            self.times.put([(t,) for t in held])
        yield pd.DataFrame({self.key: got[self.key], self.order: got[self.order], "accepted": accepted})

    def close(self) -> None:
        pass


def gated(stream: DataFrame, key: str, limit: int, seconds: float, order: str = "event_id") -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.select(key, order, "ts")
    return rows.groupBy(key).transformWithStateInPandas(Gate(key, limit, seconds, order), f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean", "Update", "ProcessingTime")


class Capped(StatefulProcessor):
    """At most ``most`` distinct values a key, each counted once."""

    def __init__(self, keys: list[str], value: str, most: int):
        self.keys, self.value, self.most = keys, value, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "v string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0] for k in self.seen.keys()}
        new = []
        for pdf in rows:
            for v in pdf[self.value]:
                if v not in known and len(known) < self.most:
                    known.add(v)
                    self.seen.updateValue((v,), (1,))
                    new.append(v)
        yield pd.DataFrame({**{k: [key[i]] * len(new) for i, k in enumerate(self.keys)}, self.value: new})

    def close(self) -> None:
        pass


def capped(stream: DataFrame, keys: list[str], value: str, most: int = 3) -> DataFrame:
    """(keys, value) of the first ``most`` distinct values of each key."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, value])
    return stream.select(*keys, value).groupBy(*keys).transformWithStateInPandas(Capped(keys, value, most), schema, "Append", "ProcessingTime")


def daily(stream: DataFrame, field: str, zone: str = "America/Los_Angeles") -> DataFrame:
    """(day, field, n): events by local day; complete or update mode."""
    return stream.groupBy(F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd").alias("day"), field).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, field: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, field, n) of closed windows, with events up to ``late`` behind."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", every), field).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), field, "n")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_names(table: DataFrame, posts: DataFrame) -> DataFrame:
    """(video_id, folded, name, count, db, first, last): the posted names added to the table."""
    new = posts.groupBy("video_id", "folded").agg(F.min_by("name", "ts").alias("name"), F.count("*").alias("count"), F.first("db", ignorenulls=True).alias("db"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = table.unionByName(new)
    return both.groupBy("video_id", "folded").agg(F.min_by("name", "first").alias("name"), F.sum("count").alias("count"), F.first("db", ignorenulls=True).alias("db"), F.min("first").alias("first"), F.max("last").alias("last"))


def restarted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two copies of the daily counters (day, field, n) after a restart: their sums."""
    return a.unionByName(b).groupBy("day", "field").agg(F.sum("n").alias("n"))


def shares(votes: DataFrame, choice: str) -> DataFrame:
    """(choice, n, share) of the tally."""
    n = votes.groupBy(choice).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).scalar()
    return n.withColumn("share", F.col("n") / total)


def cached(events: DataFrame, key: str, seconds: float, at: str = "ts") -> DataFrame:
    """``events`` with ``hit``: whether an answer for the key, stored by a miss, is younger than ``seconds``. A miss stores,
    so each key's history is gone through in order."""
    out = gate(events, key, 1, seconds, at)
    return out.withColumn("hit", ~F.col("accepted")).drop("accepted")
