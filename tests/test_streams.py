"""Streams against the same fold on tables, over several files and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from trailframe.streaming import lifecycle, sessions

T0 = 1_700_000_000_000


def by_definition(rows, now, idle=1800):
    """Ended records of (key, ms, order, name) rows, one event after the other."""
    out, alive = [], {}
    for k, t, _, name in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        r = alive.get(k)
        if r and t - r["last"] > idle * 1000:
            out.append((k, r))
            r = None
        if r is None:
            r = alive[k] = {"started": t, "last": t, "state": "", "steps": 0, "refused": 0}
        legal = {"init": r["state"] == "", "close": True, "step": r["state"] in ("ready", "running", "terminated")}
        legal["end"] = legal["fail"] = legal["step"]
        if not legal.get(name, False):
            r["refused"] += 1
            continue
        r["last"], r["steps"] = t, r["steps"] + (name == "step")
        r["state"] = {"init": "ready", "step": "running", "end": "terminated", "fail": "failed", "close": "closed"}[name]
    out += [(k, r) for k, r in alive.items() if r["last"] + idle * 1000 < now]
    return sorted((k, r["started"], r["last"], r["state"], r["steps"], r["refused"], "closed" if r["state"] == "closed" else "expired") for k, r in out)


def made_events(n, seed):
    rng = random.Random(seed)
    names = ["init", "init", "step", "step", "step", "end", "fail", "close", "odd", None]
    return [(rng.randrange(12), T0 + rng.randrange(40) * 600_000 + rng.choice([0, 0, 1]), o, rng.choice(names)) for o in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, ms long, event_id long, event string").withColumn("ts", F.timestamp_millis("ms"))


def told(df):
    return sorted(tuple(r) for r in df.select("k", F.unix_millis("started"), F.unix_millis("last"), "state", "steps", "refused", "ending").collect())


def test_expiry_is_strict(spark):
    idle = 1_800_000
    rows = [(1, T0, 0, "init"), (1, T0 + idle, 1, "step"), (1, T0 + 2 * idle + 1, 2, "step")]
    want = [(1, T0, T0 + idle, "running", 1, 0, "expired"), (1, T0 + 2 * idle + 1, T0 + 2 * idle + 1, "", 0, 1, "expired")]
    assert told(lifecycle.lifecycles(frame(spark, rows), T0 + 4 * idle, "k")) == want
    assert told(lifecycle.lifecycles(frame(spark, rows[:2]), T0 + 2 * idle, "k")) == []
    assert told(lifecycle.lifecycles(frame(spark, rows[:2]), T0 + 2 * idle + 1, "k")) == want[:1]


def test_refused_events_do_not_keep_alive(spark):
    minute = 60_000
    rows = [(1, T0, 0, "init"), (1, T0 + minute, 1, "fail"), (1, T0 + 20 * minute, 2, "step"), (1, T0 + 40 * minute, 3, "init"), (1, T0 + 41 * minute, 4, "close"), (1, T0 + 42 * minute, 5, "close")]
    want = [(1, T0, T0 + minute, "failed", 0, 1, "expired"), (1, T0 + 40 * minute, T0 + 42 * minute, "closed", 0, 0, "closed")]
    assert told(lifecycle.lifecycles(frame(spark, rows), T0 + 100 * minute, "k")) == want


def test_lifecycles_by_definition(spark):
    rows = made_events(600, 1)
    now = max(r[1] for r in rows)
    assert told(lifecycle.lifecycles(frame(spark, rows), now, "k")) == by_definition(rows, now)
    odd = frame(spark, rows + [(None, T0, 0, "init")]).withColumn("t", F.lit("clash")).withColumn("name", F.lit(1))
    assert told(lifecycle.lifecycles(odd.unionByName(odd.limit(3).withColumn("ts", F.lit(None).cast("timestamp"))), now, "k")) == by_definition(rows, now)
    assert told(lifecycle.lifecycles(frame(spark, []), now, "k")) == []


@pytest.fixture
def rocksdb(spark):
    with lifecycle.rocksdb_state(spark):
        yield


def parts(spark, tmp_path, rows, size, shuffle):
    """The rows as files that a stream takes one by one: in order of time, or locally shuffled."""
    rng = random.Random(7)
    rows = sorted(rows, key=lambda r: r[1] + (rng.randrange(3_000_000) if shuffle else 0))
    files = [rows[k : k + size] for k in range(0, len(rows), size)]
    where = str(tmp_path / "events")

    def add(some):
        for f in some:
            frame(spark, f).coalesce(1).write.mode("append").parquet(where)

    return files, where, add


@pytest.mark.parametrize("shuffle", [False, True])
def test_stream_over_a_restart(spark, tmp_path, rocksdb, shuffle):
    rows = made_events(400, 2 + shuffle)
    files, where, add = parts(spark, tmp_path, rows, 100, shuffle)
    late = "1 hour" if shuffle else "1 second"  # files end within a time, and what comes at the watermark is late

    def run():
        add(files[:1]) if not (tmp_path / "events").exists() else None
        source = spark.readStream.schema("k long, ms long, event_id long, event string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(where)
        out = lifecycle.lifecycle_stream(source, "k", late=late).writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out"))
        return out

    first = run().start()
    first.processAllAvailable()
    add(files[1:2])
    first.processAllAvailable()
    first.stop()  # with records, waiting events and timers in its state
    add(files[2:])
    run().trigger(availableNow=True).start().awaitTermination()
    now = max(r[1] for r in rows) - (3_600_000 if shuffle else 1_000)
    # a record that has ended by the watermark can't have events after it, so later events change nothing
    assert told(spark.read.parquet(str(tmp_path / "out"))) == by_definition([r for r in rows if r[1] < now], now)


def test_closed_once_on_a_stream(spark, tmp_path):
    rows = [(k % 5, T0 + k * 60_000, k, "close") for k in range(40)]
    files, where, add = parts(spark, tmp_path, rows, 10, False)
    add(files)
    source = spark.readStream.schema("k long, ms long, event_id long, event string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(where)
    sessions.closed_once(source, ["k"], late="2 hours").writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    found = [r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == [0, 1, 2, 3, 4]
