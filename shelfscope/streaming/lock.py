"""The 72-hour repeat lock as a stream with state per product.

Posts and offers of a product arrive in any order within the watermark's delay.  The
state holds the time of the last post and what has not been decided yet; an event-time
timer at the earliest undecided row fires once the watermark has passed it, and then the
rows are decided in the order of their time, posts before offers of the same time:

* a post (made elsewhere) restarts the lock;
* an offer is free if the last post is 72 hours or more before it, or there is none; a
  free offer is posted, so it restarts the lock as well.

Another timer, at the end of the lock, clears the state of a product that went quiet, so
state is bounded by the products of the last 72 hours plus the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shelfscope.functions import rules

POST, OFFER = "post", "oferta"
#: Setting of the job (``streams.start(conf=...)``): timers and several states a key need this state store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DECISIONS = "sku string, evento_id long, quando_us long, livre boolean, ultimo_post_us long"
_HOUR_US = 3_600_000_000


def decide(rows: list[tuple], last: int | None, lock_us: int) -> tuple[list[tuple], int | None]:
    """Decisions (id, time, free?, post that locks it) of rows (time, kind, id) in order, and the last post after them."""
    out = []
    for quando, kind, evento in sorted(rows, key=lambda r: (r[0], r[1] != POST, r[2])):
        if kind == POST:
            last = quando
            continue
        free = last is None or quando - last >= lock_us
        out.append((evento, quando, free, None if free else last))
        if free:
            last = quando
    return out, last


class LockProcessor(StatefulProcessor):
    """State: ``last`` post, ``pending`` rows, and the ``timer`` that is set."""

    def __init__(self, hours: int):
        self.lock_us = hours * _HOUR_US

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.timer = handle.getValueState("timer", "ms long")
        self.pending = handle.getListState("pending", "us long, kind string, id long")

    def _set_timer(self, ms: int | None) -> None:
        old = self.timer.get()
        if old is not None and old[0] != ms:
            self.handle.deleteTimer(old[0])
        if ms is None:
            self.timer.clear()
        elif old is None or old[0] != ms:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _next_timer(self, rows: list[tuple], last: int | None) -> None:
        """At the earliest undecided row, else at the end of the lock (milliseconds, not before the time itself)."""
        us = min((r[0] for r in rows), default=None if last is None else last + self.lock_us)
        self._set_timer(None if us is None else -(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [t for pdf in rows for t in zip(pdf["quando_us"].tolist(), pdf["tipo"].tolist(), pdf["evento_id"].tolist())]
        self.pending.appendList(new)
        earliest, held = -(-min(r[0] for r in new) // 1000), self.timer.get()
        if held is None or earliest < held[0]:
            self._set_timer(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.pending.get()]
        due, later = [r for r in rows if r[0] <= now_us], [r for r in rows if r[0] > now_us]
        held = self.last.get()
        decisions, last = decide(due, held[0] if held else None, self.lock_us)
        if last is not None and not later and last + self.lock_us <= now_us:
            last = None      # the lock is over and nothing waits: forget the product
        if later:
            self.pending.put(later)
        else:
            self.pending.clear()
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        self._next_timer(later, last)
        if decisions:
            yield pd.DataFrame([(key[0], e, q, free, p) for e, q, free, p in decisions],
                               columns=[c.split()[0] for c in DECISIONS.split(", ")]
                               ).astype({"ultimo_post_us": "Int64"})

    def close(self) -> None:
        pass


def sliding_lock(events: DataFrame, hours: int = rules.REPEAT_LOCK_HOURS, delay: str = "1 hour") -> DataFrame:
    """Decision for every offer of a stream ``sku, evento_id, tipo ('post' | 'oferta'), quando`` (timestamp):
    ``sku, evento_id, quando, livre, ultimo_post`` (the post that locks it, null if free: an older one may be
    forgotten by then), once the watermark has passed it."""
    rows = (events.where(F.col("sku").isNotNull() & F.col("quando").isNotNull())
            .select("sku", F.col("evento_id").cast("long").alias("evento_id"), "tipo", "quando",
                    F.unix_micros("quando").alias("quando_us"))
            .withWatermark("quando", delay))
    out = rows.groupBy("sku").transformWithStateInPandas(
        statefulProcessor=LockProcessor(hours), outputStructType=DECISIONS, outputMode="Append", timeMode="EventTime")
    return out.select("sku", "evento_id", F.timestamp_micros("quando_us").alias("quando"), "livre",
                      F.timestamp_micros("ultimo_post_us").alias("ultimo_post"))
