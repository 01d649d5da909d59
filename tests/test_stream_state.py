"""Streams over several runs: state from the checkpoint, late and repeated rows."""

import random
import statistics
import uuid
from datetime import datetime, timedelta

import pytest

from trackloom.session import shared_dir
from trackloom.streaming import live, state

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"


def arrive(spark, folder, rows, name):
    """Rows (event_id, hours after the start) as one file of events."""
    data = [(e, START + timedelta(hours=h), e % 3, "car", float(e * e % 17), f'{{"k": {e % 5}}}') for e, h in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, folder):
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    return live.stream_points(rows)


def test_multiset_median():
    r = random.Random(0)
    for _ in range(40):
        seen = [r.choice([1.0, 2.5, r.random(), r.randrange(9) * 1.0]) for _ in range(r.randint(0, 30))]
        steps = state.Steps({v: seen.count(v) for v in seen})
        for _ in range(60):
            assert steps.median() == (statistics.median(seen) if seen else None)
            seen.append(r.choice([r.random() * 9, 4.0, 0.0]))
            steps.add(seen[-1])
        assert steps.counts == {v: seen.count(v) for v in seen}


def test_state_goes_on_from_the_checkpoint(spark, folder):
    """Three runs of one query give what one pass gives; a late row goes on from the centre known when it came."""
    runs = [[(e, e) for e in range(1, 40)], [(e, e) for e in range(45, 70)] + [(70, 70)], [(41, 41)] + [(e, e) for e in range(71, 80)]]
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for n, rows in enumerate(runs):
        arrive(spark, folder, rows, f"f{n}")
        with state.stored(spark):
            table = live.run_to_table(state.track_states(source(spark, folder)), base)
    got = {r.event_id: (r.step, r.speed, r.change) for r in table.collect()}

    batch = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    at = {r.event_id: (r.sample_id, r.cx, r.cy) for r in live.stream_points(batch).collect()}
    want, last, past = {}, {}, {}
    for rows in runs:
        for e in sorted(e for e, _ in rows if e in at):
            track, x, y = at[e]
            step = speed = change = 0.0
            if track in last:
                px, py, before = last[track]
                step = ((x - px) ** 2 + (y - py) ** 2) ** 0.5
                speed = step / max(e - before, 1)
                earlier = past.setdefault(track, [])
                if earlier:
                    middle = statistics.median(earlier)
                    change = abs(step - middle) if middle <= 0 else abs(step / middle - 1)
                earlier.append(step)
            last[track] = (x, y, e)
            want[e] = (step, speed, change)
    assert set(got) == set(want)
    for e, values in want.items():
        assert got[e] == pytest.approx(values)


def test_state_with_time_to_live(spark, folder):
    """A stream whose state expires never ends by itself; its rows are those of the stream without expiry."""
    import time

    arrive(spark, folder, [(e, e) for e in range(1, 20)], "f")
    name = f"ttl_{uuid.uuid4().hex}"
    with state.stored(spark):
        same = live.run_to_table(state.track_states(source(spark, folder)))
        stream = state.track_states(source(spark, folder), ttl_ms=3_600_000)
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        end = time.time() + 90
        while spark.table(name).isEmpty() and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(spark.table(name).collect()) == sorted(same.collect()) != []


def test_mass_of_repeated_and_late_rows(spark, folder):
    """Repeated rows count once, rows within the watermark count, and the stream equals the table."""
    shares = spark.createDataFrame([("s0:0", 0.5), ("s1:1", 2.0)], "sample_id string, share double")
    rows = [(e, 6 * e) for e in range(1, 90)]
    arrive(spark, folder, rows[:60] + rows[10:20], "f0")
    arrive(spark, folder, rows[58:60] + rows[60:] + [(200, 6 * 57)], "f1")
    streamed = live.finished(source(spark, folder), lambda p: live.window_mass(p, shares, late="3 days"))
    batch = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    table = live.window_mass(live.stream_points(batch), shares, late=None)
    got, want = sorted(map(tuple, streamed.collect())), sorted(map(tuple, table.collect()))
    assert [g[:4] for g in got] == [w[:4] for w in want] != []
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
    assert {g[2] for g in got} == {"s0", "s1"}  # the third track has no share
