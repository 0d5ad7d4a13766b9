import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lodemap import schemas
from lodemap.sources import stream_events
from lodemap.streaming import edges as E, trends as S
from lodemap.streaming.progress import late_rows, progress_of

T0 = dt.datetime(2024, 1, 1)


def event(i, minutes, user=1, kind="view", k=1):
    return (i, T0 + dt.timedelta(minutes=minutes), user, kind, 1.0, '{"k": %d}' % k)


class Feed:
    """A folder of event files, one added at a time, with one output and checkpoint."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, base
        self.folder = str(base / "in")

    def add(self, rows):
        self.spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def run(self, build, name="out"):
        stream = build(stream_events(self.spark, self.folder, pattern="*.parquet"))
        with progress_of(self.spark, str(self.base / f"{name}-reports-{uuid.uuid4().hex}")) as reports:
            query = S.run_to_table(stream, str(self.base / name), str(self.base / f"{name}-cp"))
            reports.wait(str(query.runId))
            self.late = late_rows(reports.read()).collect()
        return self.spark.read.schema(stream.schema).parquet(str(self.base / name))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_only_closed_windows_come_out(feed):
    feed.add([event(1, 1), event(2, 2, kind="click"), event(3, 61), event(4, 125)])
    out = feed.run(lambda ev: S.trend_tumbling(ev, "1 hour", "5 minutes"))
    assert {(r["start"].hour, r["concept"]): r["n"] for r in out.collect()} == {(0, "view"): 1, (0, "click"): 1, (1, "view"): 1}


def test_late_rows_within_the_delay_count_and_beyond_it_are_dropped_and_reported(feed):
    feed.add([event(1, 1), event(2, 100)])
    feed.run(lambda ev: S.dedup_stream(ev, "30 minutes"))
    feed.add([event(3, 80), event(4, 10), event(5, 20)])
    out = feed.run(lambda ev: S.dedup_stream(ev, "30 minutes"))
    assert {r["event_id"] for r in out.collect()} == {1, 2, 3}
    late = feed.late
    assert sum(r["n_dropped"] for r in late) == 2
    assert sum(r["n_input"] for r in late) == 3


def test_a_file_sent_again_adds_no_rows(feed):
    rows = [event(i, i) for i in range(5)]
    feed.add(rows)
    feed.run(lambda ev: S.dedup_stream(ev, "1 hour"))
    feed.add(rows)
    assert feed.run(lambda ev: S.dedup_stream(ev, "1 hour")).count() == 5


def test_sessions_close_after_the_gap(feed):
    feed.add([event(1, 0), event(2, 10, kind="click"), event(3, 60), event(4, 0, user=2), event(5, 300)])
    out = feed.run(lambda ev: S.sessions(ev, "30 minutes", "1 minute"))
    got = sorted((r["user_id"], r["n"], r["concepts"]) for r in out.collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_tags_keep_unknown_events(feed, spark):
    entries = spark.createDataFrame([(1, "one")], "k long, concept string")
    feed.add([event(1, 1, k=1), event(2, 2, k=2)])
    out = feed.run(lambda ev: S.tag_stream(ev, entries))
    assert {r["event_id"]: r["concept"] for r in out.collect()} == {1: "one", 2: None}


def test_upsert_adds_batches_and_replay_changes_nothing(feed, spark, tmp_path):
    path, cp = str(tmp_path / "edges"), str(tmp_path / "cp")
    run = lambda c: E.upsert_edges(stream_events(spark, feed.folder, pattern="*.parquet"), path, c).awaitTermination()
    edges = lambda: {(r["src"], r["dst"]): r["n"] for r in E.read_edges(spark, path).collect()}
    assert edges() == {}
    feed.add([event(1, 1), event(2, 2)])
    run(cp)
    feed.add([event(3, 3), event(4, 4, k=2)])
    run(cp)
    want = {("view", "k1"): 3, ("view", "k2"): 1}
    assert edges() == want
    # Batch 1 again, as after a failure between the write and the commit.
    (tmp_path / "cp" / "commits" / "1").unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".1.crc"):
        crc.unlink()
    run(cp)
    assert edges() == want


def counted(spark, *rows):
    return spark.createDataFrame(rows, E.EDGES).coalesce(1)


def test_fifty_batches_leave_few_parts_and_every_crash_counts_once(spark, tmp_path):
    table = E.EdgeTable(spark, str(tmp_path / "edges"), fold=10)
    sums = lambda: {(r["src"], r["dst"]): r["n"] for r in table.read().collect()}
    for n in range(50):
        table.write(counted(spark, ("a", "b", 1), ("a", f"c{n % 3}", n)), n)
        assert table.parts() <= 2 * 10 + 3
    want = {("a", "b"): 50, **{("a", f"c{i}"): sum(range(i, 50, 3)) for i in range(3)}}
    assert sums() == want and table.base().through == 49
    # replays of batches that the base has
    for n in (0, 41, 49):
        table.write(counted(spark, ("a", "b", 1), ("a", f"c{n % 3}", n)), n)
    assert sums() == want
    # a crash after a base was written and before it was committed, then the batch again
    table.write(counted(spark, ("x", "y", 5)), 50)
    table.write_base(50)
    assert sums() == {**want, ("x", "y"): 5} and table.base().through == 49
    table.write(counted(spark, ("x", "y", 5)), 50)
    table.commit(table.write_base(50))
    assert sums() == {**want, ("x", "y"): 5} and table.base().through == 50
    # a reader that planned on the base before still finds it
    planned = table.read()
    table.write(counted(spark, ("x", "y", 1)), 51)
    table.commit(table.write_base(51))
    assert planned.where("src = 'x'").first()["n"] == 5 and sums()[("x", "y")] == 6


def test_progress_of_150_batches_is_all_there(spark, tmp_path):
    """One event a batch, one second apart and every tenth an hour late: more batches than a query remembers."""
    rows = [event(i, i / 60 - (60 if i % 10 == 9 else 0)) for i in range(150)]
    folder = tmp_path / "one-by-one"
    frame = spark.createDataFrame(rows, schemas.EVENTS)
    frame.repartitionByRange(150, "event_id").write.option("maxRecordsPerFile", 1).parquet(str(folder))
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    with progress_of(spark, str(tmp_path / "reports")) as reports:
        query = S.run_to_table(S.dedup_stream(stream, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
        reports.wait(str(query.runId))
        rows_of = late_rows(reports.read()).collect()
    assert sum(r["n_input"] for r in rows_of) == 150 and sum(r["n_input"] > 0 for r in rows_of) == 150
    kept = spark.read.parquet(str(tmp_path / "out")).count()
    assert sum(r["n_dropped"] for r in rows_of) == 150 - kept > 0
    assert len(query.recentProgress) < 150


def test_stream_equals_batch_over_closed_windows(feed, spark):
    rows = [event(i, (i * 37) % 600, user=i % 4, kind=("view", "click")[i % 2]) for i in range(120)]
    feed.add(rows)
    out = feed.run(lambda ev: S.trend_sliding(ev, "2 hours", "1 hour", "10 minutes"))
    limit = T0 + dt.timedelta(minutes=max((i * 37) % 600 for i in range(120)) - 10)
    batch = (
        spark.createDataFrame(rows, schemas.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").count().where(F.col("w.end") <= F.lit(limit))
    )
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    assert {(r["start"], r["concept"]): r["n"] for r in out.collect()} == want
