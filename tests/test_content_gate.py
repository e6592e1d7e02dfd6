"""Keyed state of change streams: bursts, content, restarts, late rows, what a micro-batch writes."""

import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.streaming import changes, gate

COLUMNS = "path string, kind string, hash string, id long"


def put(spark, tmp_path, rows):
    """One more file of the feed; a row's id is its time in seconds unless it has a fifth value."""
    df = spark.createDataFrame([(*r[:4], (r[4] if len(r) > 4 else r[3]) * 1000) for r in rows], f"{COLUMNS}, ms long")
    df.select("path", "kind", "hash", "id", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def feed(spark, tmp_path):
    return spark.readStream.schema(f"{COLUMNS}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def plain_settled(rows, gap):
    """(path, id) of the settled changes of all rows (path, kind, hash, id, ms)."""
    found, by_path = [], {}
    for r in rows:
        by_path.setdefault(r[0], []).append(r)
    for path, mine in by_path.items():
        mine.sort(key=lambda r: (r[4], r[3]))
        last, held = None, None
        for r in [*mine, None]:
            if held is not None and (r is None or not gap or r[4] - held[4] >= gap):
                if last is None or held[2] != last:
                    found.append((path, held[3]))
                last = None if held[1] in gate.GONE else held[2]
            held = r
    return sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=25), st.integers(0, 9))
def test_bursts_do_not_depend_on_order(times, gap):
    rows = [(t, t, i, "k", "h", 1) for i, t in enumerate(times)]
    half = len(rows) // 2
    bursts, ordered = gate.merge(gate.merge([], rows[:half], gap), rows[half:], gap), gate.merge([], sorted(rows), gap)
    assert bursts == ordered and sum(b[5] for b in bursts) == len(times)
    assert len(bursts) == (len(times) if not gap else 1 + sum(b - a >= gap for a, b in zip(sorted(times), sorted(times)[1:], strict=False)))


def test_path_of_many_frames(spark, tmp_path):
    rows = [("hot", "modified", f"h{i // 7 % 5}", i) for i in range(1, 401)] + [("cold", "created", "a", 1)]
    random.Random(0).shuffle(rows)
    put(spark, tmp_path, rows)
    got = changes.written_stream(changes.changed_content(feed(spark, tmp_path)), "gate")
    batch = changes.changed_content_batch(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted((r["path"], r["id"]) for r in got.collect()) == sorted((r["path"], r["id"]) for r in batch.collect()) == plain_settled([(*r, r[3]) for r in rows], 0)


def test_state_between_batches(spark, tmp_path):
    days = [
        [("p", "modified", "A", 1), ("p", "modified", "B", 2), ("q", "deleted", "A", 2), (None, "modified", "A", 2)],
        [("p", "modified", "B", 3), ("p", "modified", "A", 4), ("q", "created", "A", 3), ("r", "created", "A", 3)],
        [("p", "modified", "A", 5), ("r", "modified", "A", 6), ("r", "deleted", "A", 7), ("r", "created", "A", 8)],
    ]
    for rows in days:
        put(spark, tmp_path, rows)
    got = changes.written_stream(changes.changed_content(feed(spark, tmp_path)), "gate")
    assert sorted((r["path"], r["id"]) for r in got.collect()) == [("p", 1), ("p", 2), ("p", 4), ("q", 2), ("q", 3), ("r", 3), ("r", 8)]


def test_restarts_and_late_rows(spark, tmp_path):
    """Bursts that lie across two restarts, rows out of order within the allowed lateness, and one that comes too late."""
    gap, late = 10_000, 30_000
    parts = [
        [("a", "created", "1", 100), ("a", "modified", "2", 108), ("b", "created", "x", 101)],
        [("a", "modified", "3", 104), ("a", "modified", "4", 115), ("b", "modified", "y", 90), ("c", "created", "z", 150)],  # out of order, in time
        [("a", "modified", "4", 160), ("b", "modified", "late", 20), ("c", "deleted", "z", 175)],  # 20 is behind the watermark
        [("c", "created", "z", 230), ("end", "created", "-", 400)],
    ]
    path = f"{tmp_path}/out"
    for rows in parts:  # every call is a new start from the checkpoint
        put(spark, tmp_path, rows)
        got = changes.written_stream(gate.settled(feed(spark, tmp_path), gap, late), "gate", path=path)
    taken = [(*r, r[3] * 1000) for rows in parts for r in rows if r[3] != 20 and r[0] != "end"]
    rows = got.collect()
    assert sorted((r["path"], r["id"]) for r in rows) == plain_settled(taken, gap) == [("a", 115), ("b", 90), ("b", 101), ("c", 150), ("c", 230)]
    assert {r["id"]: r["n"] for r in rows}[115] == 4  # 100, 104, 108, 115


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """After a first batch of many paths, one of few paths writes little state."""

    def state_bytes():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_path}/out/checkpoint/state") for f in names if not f.endswith(".crc"))

    put(spark, tmp_path, [(f"path-{i}", "created", f"hash-{i}", 1) for i in range(20_000)])
    stream = lambda: changes.written_stream(changes.changed_content(feed(spark, tmp_path)), "gate", path=f"{tmp_path}/out")
    assert stream().count() == 20_000
    first = state_bytes()
    put(spark, tmp_path, [("path-7", "modified", "new", 5), ("path-8", "modified", "hash-8", 5)])
    assert stream().count() == 20_001
    assert state_bytes() - first < first / 10
