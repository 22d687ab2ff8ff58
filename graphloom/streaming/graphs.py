"""User-day graphs of a stream of events, kept as state until their day is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GRAPH = "user_id long, d date, nodes array<string>, edges array<struct<u: string, v: string>>"
_EVENT = "ts timestamp, event_id long, event_type string"


class DayGraphs(StatefulProcessor):
    """Events of a user's day are held in order of arrival; when the watermark has passed the day's end, they are put in order of time
    and make one graph, and the state goes. Later rows of the day never come here, as the watermark drops them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.events.exists()
        for frame in rows:
            self.events.appendList([(t.to_pydatetime(), int(i), s) for t, i, s in zip(frame.ts, frame.event_id, frame.event_type, strict=True)])
        if new:
            end = pd.Timestamp(key[1]).tz_localize("UTC") + pd.Timedelta(days=1)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(self.events.get(), key=lambda e: (e[0], e[1]))
        self.events.clear()
        seq = [e[2] for e in held]
        edges = dict.fromkeys((min(a, b), max(a, b)) for a, b in zip(seq, seq[1:], strict=False) if a != b)
        yield pd.DataFrame({"user_id": [key[0]], "d": [key[1]], "nodes": [list(dict.fromkeys(seq))], "edges": [[{"u": u, "v": v} for u, v in edges]]})

    def close(self) -> None:
        pass


def day_graphs(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events: a stream of user_id, ts (timestamp), event_id, event_type. (user_id, d, nodes, edges): each user's day once the watermark
    has passed its end. State holds the events of days that aren't over, dealt by user and day; it needs the RocksDB state store."""
    told = events.select("user_id", "ts", "event_id", "event_type").withWatermark("ts", delay).withColumn("d", F.to_date("ts"))
    return told.groupBy("user_id", "d").transformWithStateInPandas(statefulProcessor=DayGraphs(), outputStructType=GRAPH, outputMode="Append", timeMode="EventTime")
