"""Change feeds by Structured Streaming: debounce, content gates, re-indexing.

A change event has path, kind, hash and ts.  Every operator here takes a streaming or a batch DataFrame, unless it
says otherwise; state is keyed by path: bounded by a watermark, or one hash per path that exists.  Changes of files come
from ``sources.tree``, and ``gate`` settles bursts of them and holds back unchanged content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import mutate
from weftgraph.sources.files import SKIPPED
from weftgraph.storage import shared_path
from weftgraph.streaming import gate

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, columns: str = EVENTS) -> DataFrame:
    """ST1: a stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(columns).parquet(folder)


def as_changes(events: DataFrame) -> DataFrame:
    """Events of the driver's table as changes: user is the path, props the content's hash."""
    return events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("kind"), F.col("props").alias("hash"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


def as_file_changes(files: DataFrame) -> DataFrame:
    """Files of ``tree.source_changes`` as changes; what is there by now is all that is known, so each is a modification."""
    return files.select("path", F.lit("modified").alias("kind"), F.col("checksum").alias("hash"), F.timestamp_micros(F.expr("modified div 1000")).alias("ts"), F.lit(None).cast("long").alias("id"))


def watched(changes: DataFrame) -> DataFrame:
    """ST4: changes outside skipped and dotted folders."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return changes.where(~F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIPPED)))


def debounced(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """ST2: one row per burst of a path's changes (gaps shorter than ``gap``): the last change, and the burst's size.

    Of changes at the same time the one with the greatest id (then kind and hash) is the last, as a whole.
    """
    last = F.max(F.struct("ts", *[c for c in ("id",) if c in changes.columns], "kind", "hash"))
    return (
        changes.withWatermark("ts", late)
        .groupBy("path", F.session_window("ts", gap).alias("_w"))
        .agg(last.alias("_r"), F.count(F.lit(1)).alias("n"))
        .select("path", "_r.kind", "_r.hash", "_r.ts", "n")
    )


def windowed_counts(changes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes per kind and tumbling window (an extension: late events within the watermark are counted)."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def changed_content(changes: DataFrame, late: int = 0) -> DataFrame:
    """ST3 over a stream: each change whose hash differs from the path's last one, also if it was seen earlier, in order of (ts, id).

    Rows may be ``late`` milliseconds out of order; state and forgotten paths are as in ``gate.settled``, of which this is the form
    without bursts.
    """
    return gate.settled(changes, gap=0, late=late).drop("n")


def changed_content_batch(changes: DataFrame) -> DataFrame:
    """ST3 over a table."""
    gone = [F.lit(k) for k in gate.GONE]
    of = Window.partitionBy("path").orderBy("ts", "id")
    before = F.lag(F.struct("hash", "kind")).over(of)
    fresh = F.col("_b").isNull() | F.col("_b.kind").isin(*gone) | ~F.col("_b.hash").eqNullSafe(F.col("hash"))
    return changes.withColumn("_b", before).where(fresh).drop("_b")


def new_content(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """ST6: files (path, checksum, ...) that were not indexed with that checksum."""
    return files.join(indexed.select("path", "checksum"), ["path", "checksum"], "left_anti")


def reindexed_nodes(nodes: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """The nodes of ``reindexed``, where ``fresh`` are those that files (path, ...) have now: the files' old nodes go."""
    paths = files.select(F.col("path").alias("module_path")).distinct()
    return nodes.join(paths, "module_path", "left_anti").select(nodes.columns).unionByName(fresh, allowMissingColumns=True)


def reindexed(graph: CodeGraph, files: DataFrame) -> CodeGraph:
    """ST5: the graph after some files (path, source) were parsed anew: their old nodes go, the new ones come."""
    from weftgraph.extract.tables import Extraction

    fresh = Extraction.of(files).graph()
    paths = files.select(F.col("path").alias("module_path")).distinct()
    old = graph.nodes.join(paths, "module_path", "left_semi").select("id")
    kept_ids = fresh.nodes.select("id")
    # edges from other files into a node that comes back are kept
    edges = graph.edges.join(old.withColumnRenamed("id", "src"), "src", "left_anti").join(old.join(kept_ids, "id", "left_anti").withColumnRenamed("id", "dst"), "dst", "left_anti")
    return graph.with_(nodes=reindexed_nodes(graph.nodes, files, fresh.nodes), edges=mutate.upsert(edges, fresh.edges, ("type", "src", "dst")), variables=mutate.upsert(graph.variables, fresh.variables), shapes=mutate.insert_only(graph.shapes, fresh.shapes))


def index_stream(changes: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """ST5, ST9, W22: every micro-batch's last change per path goes to a function; at least once, in order."""

    def each(batch: DataFrame, number: int) -> None:
        others = [c for c in batch.columns if c != "path"]
        order = F.struct("ts", *[c for c in ("id", "kind", "hash") if c in others])
        last = batch.groupBy("path").agg(F.max_by(F.struct(*others), order).alias("_r")).select("path", "_r.*")
        on_batch(last, number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def collected_stream(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input that there is and return its rows; for tests and small results."""
    with gate.state_store(stream.sparkSession):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def written_stream(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all input that there is into Parquet files in the shared folder, exactly once, and read them.

    With a ``path`` of an earlier call the stream goes on from where it ended.
    """
    path = path or shared_path(stream.sparkSession, label)
    with gate.state_store(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
