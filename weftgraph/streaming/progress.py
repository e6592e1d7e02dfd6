"""ST9, W22: what streams and jobs have done, as a table of events that any session can read.

A listener hears of each micro-batch and of the end of each query and puts one small file for each into a folder that all may
see; a job that goes through steps (files to be indexed, say) tells its own.  Events are few (one a micro-batch), written by
the driver, and read as a table.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from weftgraph.storage import put_text

COLUMNS = "name string, run_id string, event string, step long, done long, total long, took_ms long, message string, at timestamp"


class Progress:
    """Events of streams and jobs in one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def tell(self, name: str, event: str, *, run_id: str = "", step: int = 0, done: int = 0, total: int | None = None, took_ms: int | None = None, message: str | None = None) -> None:
        """Add an event: started, progress, ended or failed."""
        row = {"name": name, "run_id": run_id, "event": event, "step": step, "done": done, "total": total, "took_ms": took_ms, "message": message, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        put_text(self.spark, f"{self.path}/events/{time.time_ns()}-{uuid.uuid4().hex}.json", json.dumps(row) + "\n")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).json(f"{self.path}/events")

    def latest(self) -> DataFrame:
        """(name, run_id, event, step, done, total): the state of each run, with all that it has done so far."""
        order = F.struct("at", "step", F.col("event").isin("ended", "failed"))
        last = self.rows().groupBy("name", "run_id").agg(F.max_by(F.struct("event", "step", "total"), order).alias("l"), F.sum("done").alias("done"))
        return last.select("name", "run_id", "l.event", "l.step", "done", "l.total")


class StreamProgress(StreamingQueryListener):
    """Tells a ``Progress`` of every micro-batch: to be added by ``spark.streams.addListener``."""

    def __init__(self, progress: Progress) -> None:
        self._progress, self._names = progress, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802  the API's names
        self._names[str(event.runId)] = event.name or str(event.id)
        self._progress.tell(event.name or str(event.id), "started", run_id=str(event.runId))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        self._progress.tell(p.name or str(p.id), "progress", run_id=str(p.runId), step=p.batchId, done=p.numInputRows, took_ms=p.batchDuration)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        run = str(event.runId)
        failed = event.exception is not None
        self._progress.tell(self._names.pop(run, str(event.id)), "failed" if failed else "ended", run_id=run, step=1 << 40, message=event.exception[:2000] if failed else None)
