"""Windows over a stream of edges (user -> event type): the same functions serve a batch."""

from __future__ import annotations

from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def edge_stream(events: DataFrame, late: str | None = None) -> DataFrame:
    """(ts, src, dst) of events; with a watermark where late is given."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return e.withWatermark("ts", late) if late else e


def tumbling(edges: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, dst, n): edges by type and window."""
    return edges.groupBy(F.window("ts", width), "dst").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "dst", "n")


def sliding(edges: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return edges.groupBy(F.window("ts", width, step), "dst").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "dst", "n")


def sessions(edges: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(src, start, n): a user's runs of edges with less than the gap between."""
    return edges.groupBy(F.session_window("ts", gap), "src").agg(F.count("*").alias("n")).select("src", F.col("session_window.start").alias("start"), "n")


def steps(edges: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(src, start, first, second, n) of a batch: how often an edge's type follows another's within a user's session; edges of one moment in the order of their types. A session of one edge has none."""
    w = Window.partitionBy("src").orderBy("ts", "dst")
    new = F.when(F.col("ts") < F.lag("ts").over(w) + F.expr(f"interval {gap}"), 0).otherwise(1)
    told = edges.select("src", "ts", "dst", F.lag("dst").over(w).alias("before"), new.alias("new"))
    told = told.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.min("ts").over(Window.partitionBy("src", "session")))
    return told.where("new = 0").groupBy("src", "start", F.col("before").alias("first"), F.col("dst").alias("second")).agg(F.count("*").alias("n"))


STEPS = "src long, start timestamp, first string, second string, n long"


def running_steps(edges: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """steps() of a stream with a watermark, each session's once it is over.

    A user's state is the session's start, its last edge and its counts, plus the edges that the watermark has not passed: late ones are put in order
    before they are counted, and what is later than the watermark is left out by Spark. A timer at the gap after the last edge ends the session
    and clears its state, so a user who stays away holds none.
    """

    class Steps(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "start timestamp, last timestamp, type string")
            self.counts = handle.getMapState("counts", "first string, second string", "n long")
            self.waiting = handle.getListState("waiting", "ts timestamp, dst string")

        def handleInputRows(self, key, rows, timerValues):
            new = [(t.to_pydatetime(), d) for pdf in rows for t, d in zip(pdf["ts"], pdf["dst"], strict=True)]
            yield from self.go(key, new, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self.go(key, [], timerValues.getCurrentWatermarkInMs())

        def go(self, key, new, watermark):
            ms = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
            waiting = sorted([(w[0], w[1]) for w in self.waiting.get()] + new) if self.waiting.exists() else sorted(new)
            ready, later = [w for w in waiting if ms(w[0]) < watermark], [w for w in waiting if ms(w[0]) >= watermark]
            start, last, kind = self.open.get() if self.open.exists() else (None, None, None)
            out = []
            for t, d in ready:
                if start is not None and t < last + timedelta(minutes=gap_minutes):
                    pair = (kind, d)
                    self.counts.updateValue(pair, ((self.counts.getValue(pair)[0] if self.counts.containsKey(pair) else 0) + 1,))
                else:
                    out += self.ended(key, start)
                    start = t
                last, kind = t, d
            if start is not None and ms(last) + gap_minutes * 60_000 <= watermark and not any(t < last + timedelta(minutes=gap_minutes) for t, _ in later):
                out += self.ended(key, start)
                start = None
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            if start is None:
                self.open.clear()
            else:
                self.open.update((start, last, kind))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            due = ([ms(later[0][0]) + 1] if later else []) + ([ms(last) + gap_minutes * 60_000] if start is not None else [])
            if due:
                self.handle.registerTimer(max(min(due), watermark + 1))
            if out:
                yield pd.DataFrame(out, columns=["src", "start", "first", "second", "n"])

        def ended(self, key, start):
            rows = [(key[0], start, a, b, n) for (a, b), (n,) in self.counts.iterator()] if start is not None else []
            self.counts.clear()
            return rows

        def close(self) -> None:
            pass

    return edges.groupBy("src").transformWithStateInPandas(Steps(), outputStructType=STEPS, outputMode="append", timeMode="eventtime")
