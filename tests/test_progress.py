"""Events of streams and jobs as a table."""

import time

from pyspark.sql import functions as F

from weftgraph.streaming.progress import Progress, StreamProgress


def until(rows, what, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        found = rows().collect()
        if any(what(r) for r in found):
            return found
        time.sleep(0.5)
    raise AssertionError(f"not told in time: {found}")


def test_batches_and_a_failure(spark, tmp_path):
    progress = Progress(spark, str(tmp_path / "progress"))
    progress.tell("index", "started", run_id="r", total=3)
    for k in range(3):
        progress.tell("index", "progress", run_id="r", step=k, done=1, total=3)
    assert [tuple(r)[2:] for r in progress.latest().collect()] == [("progress", 2, 3, 3)]

    for k in range(3):
        spark.range(k * 10, k * 10 + 5 + k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = StreamProgress(progress)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.format("noop").queryName("fine").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = until(progress.rows, lambda r: r["name"] == "fine" and r["event"] == "ended")
        assert sorted(r["done"] for r in rows if r["name"] == "fine" and r["event"] == "progress" and r["done"]) == [5, 6, 7]
        broken = stream.select(F.when(F.col("id") == 21, F.raise_error(F.lit("a bad row"))).otherwise(F.col("id")).alias("id"))
        q = broken.writeStream.format("noop").queryName("broken").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:  # noqa: BLE001  the stream's own error
            pass
        rows = until(progress.rows, lambda r: r["name"] == "broken" and r["event"] == "failed")
        assert "a bad row" in next(r["message"] for r in rows if r["event"] == "failed")
    finally:
        spark.streams.removeListener(listener)
    states = {r["name"]: (r["event"], r["done"]) for r in progress.latest().collect()}
    assert states["fine"] == ("ended", 18) and states["broken"][0] == "failed" and states["broken"][1] < 18
