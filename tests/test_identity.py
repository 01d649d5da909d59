"""Group identity against a walk over the frames of a window."""

import random

import pytest

from trackloom.operators import identity, tracking


def walk(frames, threshold):
    """Frames in order, each a dict of smallest member -> members; ids and events by the rules, one group at a time."""
    ids, events, before, count = {}, [], {}, 0
    for f in sorted(frames):
        found, now = {}, {}
        for c in sorted(frames[f]):
            members = frames[f][c]
            options = []
            for g, others in before.items():
                overlap = len(members & others) / len(members | others)
                if overlap >= threshold:
                    options.append((-overlap, g))
            found[c] = sorted(options)
            free = [g for _, g in found[c] if g not in now.values()]
            if not free:
                count += 1
            now[c] = free[0] if free else f"g{count}"
            if len(options) > 1:
                events.append((f, "merge", tuple(sorted(g for _, g in options)), (now[c],)))
        for g in before:
            into = tuple(now[c] for c in sorted(frames[f]) if any(x == g for _, x in found[c]))
            if len(into) > 1:
                events.append((f, "split", (g,), into))
        ids.update({(f, c): g for c, g in now.items()})
        before = {now[c]: frames[f][c] for c in frames[f]}
    return ids, sorted(events)


def history(seed, n_frames, n_tracks, swap):
    """Groups that merge, split and swap members; many equal overlaps."""
    r = random.Random(seed)
    label = {t: r.randrange(4) for t in range(n_tracks)}
    frames = {}
    for f in range(n_frames):
        for t in label:
            if r.random() < swap:
                label[t] = r.randrange(n_tracks)
        seen = [t for t in label if r.random() < 0.95]
        groups = {}
        for t in seen:
            groups.setdefault(label[t], set()).add(f"t{t:02d}")
        if groups:
            frames[f * 2] = {min(g): g for g in groups.values()}
    return frames


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_equals_walk(spark, chunk, monkeypatch):
    """Chunks of any size give the ids of the walk, also past g9, where ids no longer sort by number."""
    histories = {f"w{k}": history(k, 60, 9, 0.02 + 0.08 * k) for k in range(6)}
    rows = [(w, f, t, c) for w, frames in histories.items() for f, groups in frames.items() for c, g in groups.items() for t in g]
    df = spark.createDataFrame(rows, "window_id string, frame_id int, track_id string, component string")
    overlaps = tracking.group_overlaps(df, 0.3)
    named = identity.named_groups(overlaps, chunk)
    got = {(r.window_id, r.frame_id, r.component): r.group_id for r in named.collect()}
    events = sorted((r.window_id, r.frame_id, r.event_type, tuple(r.sources), tuple(r.targets)) for r in identity.events_of(named, overlaps).collect())
    want, want_events = {}, []
    for w, frames in histories.items():
        ids, found = walk(frames, 0.3)
        want.update({(w, *k): g for k, g in ids.items()})
        want_events += [(w, *e) for e in found]
    assert got == want and events == sorted(want_events)
    assert any(int(g[1:]) > 9 for g in want.values()) and {e[2] for e in events} == {"merge", "split"}


def test_long_window_spreads(spark):
    """A window of 100,000 frames is settled in chunks; the pass over the skeleton sees a small share of the rows."""
    from pyspark.sql import functions as F

    n = 100_000
    frames = spark.range(n).select(F.lit("w").alias("window_id"), F.col("id").cast("int").alias("frame_id"))
    # two pairs; every 5,000th frame one of them is gone
    rows = frames.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("track_id"), F.lit(c).alias("component")) for t, c in zip("abcd", "aacc")])).alias("m"))
    rows = rows.select("window_id", "frame_id", "m.*").where((F.col("frame_id") % 5000 != 4999) | (F.col("component") == "a"))
    named = identity.named_groups(tracking.group_overlaps(rows))
    assert {(r.component, r.n) for r in named.groupBy("component").agg(F.countDistinct("group_id").alias("n")).collect()} == {("a", 1), ("c", 20)}
    assert named.count() == 2 * n - 20
    assert named.where("group_id = 'g20'").count() == 4999


def test_choice_between_equals_hangs_on_ids():
    assert identity.settled([("a", [("x", 0.5), ("y", 0.5)])]) is None
    assert identity.settled([("a", [("x", 0.5), ("y", 0.4)]), ("b", [("x", 0.9)])]) == {"a": "x", "b": None}
    assert identity.settled([("a", [("x", 0.6)]), ("b", [("x", 0.5), ("y", 0.5)])]) == {"a": "x", "b": "y"}
