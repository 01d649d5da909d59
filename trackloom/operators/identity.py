"""Identity of groups over time, without walking a window frame by frame in one task.

A group takes the id of its best free match in the frame before, ids count up in frame order, and of equally good matches the one with the
lesser id wins.  Only the last rule needs real ids.  So frames are settled chunk by chunk, in parallel: within a run of frames in which no
choice hangs on an id, every group leads back to a group of the frame that opened the run or to the n-th birth of the run.
What is left is a skeleton, the opening frame and the end of every run; one pass over it gives ids to the opening groups and the number of
earlier births to every run, and two joins name all groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.scale import CHUNK_FRAMES
from trackloom.session import materialize

RUN = ["window_id", "chunk", "run"]
Matches = Sequence[tuple[str, float]]

_GROUPS = pa.list_(pa.struct([("component", pa.string()), ("matches", pa.list_(pa.struct([("previous", pa.string()), ("overlap", pa.float64())])))]))
_ENDS = pa.list_(pa.struct([("component", pa.string()), ("entry", pa.string()), ("birth", pa.int64())]))
_PARTS = pa.schema(
    [("window_id", pa.string()), ("chunk", pa.int64()), ("run", pa.int64()), ("index", pa.int64()), ("frame_id", pa.int32()), ("component", pa.string()), ("entry", pa.string()), ("birth", pa.int64()), ("opening", _GROUPS), ("ending", _ENDS), ("births", pa.int64())]
)
_PARTS_SQL = """window_id string, chunk long, run long, index long, frame_id int, component string, entry string, birth long,
    opening array<struct<component string, matches array<struct<previous string, overlap double>>>>,
    ending array<struct<component string, entry string, birth long>>, births long"""
_NAMES = pa.schema([("window_id", pa.string()), ("chunk", pa.int64()), ("run", pa.int64()), ("component", pa.string()), ("group_id", pa.string()), ("base", pa.int64())])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def settled(frame: Sequence[tuple[str, Matches]]) -> dict[str, str | None] | None:
    """Previous group (or None: a birth) of every group of a frame; None where a choice between equals hangs on ids."""
    free_for: dict[str, str | None] = {}
    taken: set[str] = set()
    for component, matches in frame:
        left = [(o, p) for p, o in matches if p not in taken]
        if not left:
            free_for[component] = None
            continue
        top = max(left)[0]
        best = [p for o, p in left if o == top]
        if len(best) > 1:
            return None
        taken.add(best[0])
        free_for[component] = best[0]
    return free_for


class _Run:
    """The groups of the current frame as entries or births of the run that the last open frame began."""

    def __init__(self, number: int, frame: Sequence[tuple[str, Matches]]) -> None:
        self.number, self.births = number, 0
        self.where: dict[str, tuple[str | None, int | None]] = {c: (c, None) for c, _ in frame}

    def advance(self, links: dict[str, str | None]) -> None:
        now = {}
        for component, previous in links.items():
            if previous is None:
                self.births += 1
                now[component] = (None, self.births)
            else:
                now[component] = self.where[previous]
        self.where = now


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of frames in order: a row per group (its run, entry or birth), and two rows per run, its opening and its end."""
    key, index, frame_id, frame, run, out = None, None, None, [], None, []

    def close_run() -> None:
        ending = [{"component": c, "entry": e, "birth": b} for c, (e, b) in run.where.items()]
        out.append((*key, run.number, None, None, None, None, None, None, ending, run.births))

    def close_frame() -> None:
        nonlocal run
        links = settled(frame) if run is not None else None
        if links is None:
            if run is not None:
                close_run()
            run = _Run(0 if run is None else run.number + 1, frame)
            opening = [{"component": c, "matches": [{"previous": p, "overlap": o} for p, o in m]} for c, m in frame]
            out.append((*key, run.number, index, frame_id, None, None, None, opening, None, None))
        else:
            run.advance(links)
        out.extend((*key, run.number, index, frame_id, c, *run.where[c], None, None, None) for c, _ in frame)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("window_id", "chunk", "index", "frame_id", "component", "matches")]
        for window, chunk, i, f, component, matches in zip(*columns):
            if (window, chunk) != key or i != index:
                if frame:
                    close_frame()
                if (window, chunk) != key:
                    if run is not None:
                        close_run()
                    key, run = (window, chunk), None
                index, frame_id, frame = i, f, []
            frame.append((component, [(m["previous"], m["overlap"]) for m in matches or []]))
        yield _record(out, _PARTS)
        out = []
    if frame:
        close_frame()
        close_run()
        yield _record(out, _PARTS)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the opening groups of every run, and (without a component) the births before it."""
    window, count, before, opened = None, 0, {}, {}
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("window_id", "chunk", "run", "opening", "ending", "births")]
        for own, chunk, run, opening, ending, births in zip(*columns):
            if own != window:
                window, count, before, opened = own, 0, {}, {}
            if opening is None:
                before = {e["component"]: opened[e["entry"]] if e["birth"] is None else f"g{count + e['birth']}" for e in ending}
                count += births
                continue
            opened = {}
            for group in opening:
                ways = sorted((-m["overlap"], before[m["previous"]]) for m in group["matches"])
                names = [g for _, g in ways if g not in opened.values()] if ways else []
                if not names:
                    count += 1
                opened[group["component"]] = names[0] if names else f"g{count}"
            out.append((own, chunk, run, None, None, count))
            out.extend((own, chunk, run, c, g, count) for c, g in opened.items())
        yield _record(out, _NAMES)


def named_groups(overlaps: DataFrame, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """``group_id`` of every row of ``overlaps`` (window_id, index, frame_id, component, matches).

    Groups of a frame go by their smallest member.  A task holds one frame; the pass over the skeleton holds two.
    """
    key = ["window_id", "chunk"]
    rows = overlaps.select(
        "window_id", F.floor(F.col("index") / chunk).cast("long").alias("chunk"), F.col("index").cast("long").alias("index"), "frame_id", "component", "matches"
    )
    placed = rows.repartition(*key).sortWithinPartitions(*key, "index", "component")
    parts = materialize(placed.mapInArrow(_parts, _PARTS_SQL))
    skeleton = parts.where(F.col("component").isNull()).withColumn("_end", F.col("ending").isNotNull())
    skeleton = skeleton.repartition("window_id").sortWithinPartitions("window_id", "chunk", "run", "_end")
    names = materialize(
        skeleton.select(*RUN, "opening", "ending", "births").mapInArrow(
            _names, "window_id string, chunk long, run long, component string, group_id string, base long"
        )
    )
    groups = parts.where(F.col("component").isNotNull()).select(*RUN, "index", "frame_id", "component", "entry", "birth")
    opened = names.where(F.col("component").isNotNull()).select(*RUN, F.col("component").alias("entry"), "group_id")
    bases = names.where(F.col("component").isNull()).select(*RUN, "base")
    out = ["window_id", "index", "frame_id", "component", "group_id"]
    old = groups.where(F.col("entry").isNotNull()).join(opened, [*RUN, "entry"]).select(*out)
    new = groups.where(F.col("entry").isNull()).join(bases, RUN)
    new = new.withColumn("group_id", F.concat(F.lit("g"), (F.col("base") + F.col("birth")).cast("string")))
    return old.unionByName(new.select(*out))


def events_of(named: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Merges and splits: ``window_id``, ``frame_id``, ``event_type``, ``sources`` and ``targets`` (group ids).

    A group with several matches is a merge of their ids (sorted); an id that several groups match is split into theirs (in the order
    of the groups).
    """
    pairs = overlaps.select("window_id", F.col("index").cast("long").alias("index"), "component", F.explode("matches").alias("_m")).select(
        "window_id", "index", "component", F.col("_m.previous").alias("previous")
    )
    before = named.select("window_id", (F.col("index") + 1).alias("index"), F.col("component").alias("previous"), F.col("group_id").alias("source"))
    met = materialize(
        pairs.join(named.withColumnRenamed("group_id", "target"), ["window_id", "index", "component"]).join(before, ["window_id", "index", "previous"])
    )
    merges = (
        met.groupBy("window_id", "frame_id", "component", "target")
        .agg(F.sort_array(F.collect_set("source")).alias("sources"))
        .where(F.size("sources") > 1)
        .select("window_id", "frame_id", F.lit("merge").alias("event_type"), "sources", F.array("target").alias("targets"))
    )
    splits = (
        met.groupBy("window_id", "frame_id", "source")
        .agg(F.sort_array(F.collect_list(F.struct("component", "target"))).alias("_t"))
        .where(F.size("_t") > 1)
        .select("window_id", "frame_id", F.lit("split").alias("event_type"), F.array("source").alias("sources"), F.col("_t.target").alias("targets"))
    )
    return merges.unionByName(splits)
