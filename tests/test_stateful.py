"""Streams with timers, over restarts and late rows."""

from datetime import UTC, datetime, timedelta

import pytest

from engramic.streaming import stateful

START = datetime(2026, 3, 1, 12)
SCHEMA = "key string, id string, ts timestamp"


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fed(spark, tmp_path, schema, batches, of):
    """Rows that a query gives out, restarted from its checkpoint for each batch."""
    source, sink, checkpoint = (str(tmp_path / p) for p in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        of(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink).collect()


def test_writes_of_a_moment_go_together(store, tmp_path, monkeypatch):
    at = lambda ms: START + timedelta(milliseconds=ms)
    first = [("a", f"w{i:03d}", at(i % 90)) for i in range(260)] + [("b", "x", at(0))]
    got = fed(store, tmp_path, SCHEMA, [first, [("a", "late moment", at(400)), ("b", "y", at(99))], [("c", "end", at(60_000))], [("c", "over", at(120_000))]], stateful.gathered)
    base = int(START.replace(tzinfo=UTC).timestamp() * 1000)
    own = [r for r in got if r["key"] == "a" and r["id"].startswith("w")]
    assert len(own) == 260 and {r["flushed_at"] for r in own} == {base + 100} and sorted(r["chunk"] for r in own) == [0] * 250 + [1] * 10
    assert {(r["id"], r["flushed_at"]) for r in got if r["key"] == "b"} == {("x", base + 100), ("y", base + 100)}
    assert [(r["id"], r["flushed_at"]) for r in got if r["id"] == "late moment"] == [("late moment", base + 500)]


def test_the_newest_names_are_remembered(store, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[("a", n, at(i)) for i, n in enumerate("xyxz")], [("a", "w", at(5)), ("a", "x", at(6))], [("a", "w", at(200))]]
    got = fed(store, tmp_path, SCHEMA, batches, lambda s: stateful.retained(s, 3, 60_000))
    told = [(r["id"], r["event"]) for r in got]
    assert sorted(told) == sorted([("x", "new"), ("y", "new"), ("z", "new"), ("w", "new"), ("x", "evicted"), ("x", "new"), ("y", "evicted"), ("z", "expired"), ("x", "expired"), ("w", "expired"), ("w", "new")])


def test_daily_runs_keep_to_the_hour_of_their_zone(store, tmp_path):
    schema = "agent string, hour int, minute int, zone string, ts timestamp"
    spring = datetime(2026, 3, 28, 12)  # clocks go forward in Prague on the 29th at 01:00 UTC
    batches = [[("p", 9, 30, "Europe/Prague", spring)] * 3, [("p", 9, 30, "Europe/Prague", spring + timedelta(days=1))], [("q", 0, 0, "UTC", spring + timedelta(days=2))], [("q", 0, 0, "UTC", spring + timedelta(days=3))]]
    got = fed(store, tmp_path, schema, batches, stateful.daily_runs)
    at = lambda *x: int(datetime(*x, tzinfo=UTC).timestamp() * 1000)
    runs = sorted((r["run_at"], r["events"]) for r in got if r["agent"] == "p")
    assert runs[0] == (at(2026, 3, 29, 7, 30), 3) and runs[1] == (at(2026, 3, 30, 7, 30), 1)
    assert stateful.next_run(at(2026, 3, 27, 8, 29, 59), 9, 30, "Europe/Prague") == at(2026, 3, 27, 8, 30)
    assert stateful.next_run(at(2026, 3, 27, 8, 30), 9, 30, "Europe/Prague") == at(2026, 3, 28, 8, 30)
