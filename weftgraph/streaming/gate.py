"""ST2 and ST3 in one stateful operator: bursts of a path's changes end by a timer, and unchanged content stays silent.

State per path: the hash of its last settled content (a value), and its open bursts (a list with an entry for each burst that the
watermark has not passed; rows are merged into them as they come, so bursts and not rows are kept; without a gap each
change is a burst until the watermark passes it).  A timer at the earliest end of a burst settles it: in order of time, a
burst's last change is compared with the path's hash and handed on if it differs.  A path that is deleted or moved is
forgotten, so what comes back is new.  State is kept by RocksDB with change logs, so what a micro-batch writes follows its own
rows and not the number of paths that were ever seen.

Times count in whole milliseconds, as watermarks and timers do.  Rows behind the watermark are dropped; rows without a path or
a time are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from weftgraph.session import ship

#: Kinds of changes after which a path's remembered hash goes.
GONE = ("deleted", "moved")
_BURST = "first long, last long, id long, kind string, hash string, n long"
_OUT = "path string, kind string, hash string, millis long, id long, n long"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state by RocksDB with change logs; a stream holds to what it started with."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _rank(burst: tuple) -> tuple:
    """Order among changes at one time: nulls first, then by id, kind, hash."""
    return tuple((x is not None, x) for x in burst[1:5])


def merge(bursts: list[tuple], rows: list[tuple], gap: int) -> list[tuple]:
    """Disjoint bursts (first, last, id, kind, hash, n) in order, with rows of the same form among them, joined if less than ``gap`` apart."""
    if not gap:
        return sorted([*bursts, *rows], key=_rank)
    bursts = list(bursts)
    for row in rows:
        low = high = bisect_right(bursts, row[1] - gap, key=lambda b: b[1])
        while high < len(bursts) and bursts[high][0] - row[1] < gap:
            high += 1
        alike = [*bursts[low:high], row]
        bursts[low:high] = [(min(b[0] for b in alike), *max(alike, key=_rank)[1:5], sum(b[5] for b in alike))]
    return bursts


class BurstGate(StatefulProcessor):
    """Settles bursts of one path; see the module."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._hash = handle.getValueState("hash", "hash string")
        self._open = handle.getListState("bursts", _BURST)

    def _keep(self, bursts: list[tuple]) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if bursts:
            self._open.put(bursts)
            self._handle.registerTimer(min(b[1] for b in bursts) + self.gap)
        else:
            self._open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803  the API's names
        bursts = [tuple(b) for b in self._open.get()]
        while some := [(r["millis"], r["millis"], r["id"], r["kind"], r["hash"], 1) for r in islice(rows, 10_000)]:
            bursts = merge(bursts, some, self.gap)
        self._keep(bursts)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        bursts = [tuple(b) for b in self._open.get()]
        last = self._hash.get() if self._hash.exists() else None
        known = last is not None
        for _, at, change, kind, content, n in (b for b in bursts if b[1] + self.gap <= now):
            if not known or content != last[0]:
                yield Row(path=key[0], kind=kind, hash=content, millis=at, id=change, n=n)
            known, last = kind not in GONE, (content,)
        if known:
            self._hash.update(last)
        else:
            self._hash.clear()
        self._keep([b for b in bursts if b[1] + self.gap > now])


def settled(changes: DataFrame, gap: int = 300, late: int = 10_000) -> DataFrame:
    """A stream of changes (path, kind, hash, ts, id) as the settled changes of content: path, kind, hash, ts, id, n.

    A burst is a path's changes less than ``gap`` milliseconds apart, of which the last counts (by time, id, kind, hash); with
    ``gap=0`` every change is one.  ``n`` counts a burst's changes.  Rows may be ``late`` milliseconds out of order.  To be
    started within ``state_store``.
    """
    ship(changes.sparkSession)
    rows = changes.where("path IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late} milliseconds")
    rows = rows.select("path", "ts", F.unix_millis("ts").alias("millis"), F.col("id").cast("long").alias("id"), "kind", "hash")
    found = rows.groupBy("path").transformWithState(BurstGate(gap), _OUT, "Append", "EventTime")
    return found.select("path", "kind", "hash", F.timestamp_millis("millis").alias("ts"), "id", "n")
