"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists of words.

Two words one edit apart, the shorter of ``m`` code points, share their first or their last ``m // 2`` ones, so words meet in groups of
one half; the edit lies in the rest, the remainder.  A group is a sorted list of remainders.  Against one remainder the list is scanned with a band
of three cells of the edit matrix per row; rows stay valid through the common prefix of neighbours, and once a row exceeds one edit, all words with
that prefix are skipped by one binary search.

A group of more than ``SPLIT`` words is halved again by its remainder, down to one free code point, so that a group of a fixed alphabet is bounded.
A pair is taken only in the first of its groups: a group of a shared end wants a common prefix shorter (``cap``) than its sibling's.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, shuffle_partitions
from trackloom.llm.words import LOWER, bytes_of, chunks, hashes
from trackloom.session import materialize

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least this many times as frequent as its variant.
FACTOR = 5
#: One in so many runs (by checksum) loses a code point before it counts.
DAMAGE = 199
#: Words of a group from which it is halved again.
SPLIT = 4096
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Bytes of a run up to which its checksum is computed beside all others.
SHORT = 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LEAD = 0xC3  # of U+00C0 to U+00FF, and of nothing else


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings that go on from the checksums ``before``."""
    state = before ^ np.uint32(0xFFFFFFFF)
    at = np.flatnonzero(length <= SHORT)
    k = 0
    while len(at):
        c = state[at]
        state[at] = _CRC[(c ^ data[start[at] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        k += 1
        at = at[length[at] > k]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(before[i]))
    return out


def damaged_runs(ids: list[int | None], column: pa.Array, counts: dict[bytes, int]) -> None:
    """Add the words of a text column to ``counts``."""
    raw, offsets = bytes_of(column)
    if not len(raw):
        return
    lead = raw == _LEAD
    inside = _LETTER[raw] | lead
    inside[1:] |= lead[:-1]
    data = LOWER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    size = points[end] - points[start]
    long = size >= MIN_LENGTH  # shorter ones are no words, damaged or not
    start, end, size = start[long], end[long], size[long]
    if not len(start):
        return
    row = np.searchsorted(offsets, start, "right") - 1
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    check = checksums(data, start, end - start, before[row])
    hit = check % DAMAGE == 0
    for i in np.flatnonzero(hit & (size > MIN_LENGTH)).tolist():
        word = data[start[i] : end[i]].tobytes().decode()
        k = int(check[i]) % len(word)
        short = (word[:k] + word[k + 1 :]).encode()
        counts[short] = counts.get(short, 0) + 1
    start, end = start[~hit], end[~hit]
    _, first, n = np.unique(hashes(data, start, end - start), return_index=True, return_counts=True)
    for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
        word = data[a:b].tobytes()
        counts[word] = counts.get(word, 0) + k


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of every word with MIN_COUNT occurrences; counted in tasks before anything is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).where(F.col("_text").isNotNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        for batch in chunks(batches, "_text"):
            damaged_runs(batch.column("_id").to_pylist(), batch.column("_text"), counts)
            if len(counts) > HELD_WORDS:
                yield handed()
                counts.clear()
        yield handed()

    counted = rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.where(F.col("n") >= MIN_COUNT))


KEY = ["m", "p", "s", "cap", "head", "end"]


def keyed(rows: DataFrame) -> DataFrame:
    """The shared code points of each row's group."""
    return rows.withColumns(
        {"head": F.expr("substring(word, 1, p)"), "end": F.expr("if(s = 0, '', substring(word, -s))")}
    )


def halves(rows: DataFrame) -> DataFrame:
    """Every row of a group (m, p, s, cap) in its two halves; a half that its cap leaves empty goes."""
    t = F.expr("int((m - p - s) div 2)")
    both = F.explode(F.array(
        F.struct((F.col("p") + t).alias("p"), F.col("s").alias("s"), F.col("cap").alias("cap")),
        F.struct(F.col("p").alias("p"), (F.col("s") + t).alias("s"), F.least("cap", F.col("p") + t).alias("cap")),
    ))
    return keyed(rows.select("word", "n", "m", both.alias("_h")).select("word", "n", "m", "_h.*").where("p < cap"))


def grouped(words: DataFrame) -> DataFrame:
    """Words in their groups, none of which is larger than SPLIT unless it has one free code point only."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(lengths).alias("m")).where(F.col("m") >= MIN_LENGTH)
    rows = halves(rows.withColumns({"p": F.lit(0), "s": F.lit(0), "cap": F.col("m") + 1}))
    out: DataFrame | None = None
    while True:
        large = materialize(
            rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c")).where((F.col("_c") > SPLIT) & (F.expr("m - p - s") > 1)).drop("_c")
        )
        n = large.count()
        if not n:
            return rows if out is None else out.unionByName(rows)
        if n <= BROADCAST_ROWS:
            large = F.broadcast(large)
        rest = rows.join(large, KEY, "left_anti")
        out = rest if out is None else out.unionByName(rest)
        rows = materialize(halves(rows.join(large, KEY, "left_semi")))


def common_prefix(x: str, y: str) -> int:
    k = 0
    for a, b in zip(x, y):
        if a != b:
            break
        k += 1
    return k


def scan(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places (a < b) of a sorted list of different strings that are one edit apart."""
    n = len(texts)
    shared = [0] + [common_prefix(x, y) for x, y in zip(texts, texts[1:])]
    for a in range(n - 1):
        x = texts[a]
        size = len(x)
        # rows[j]: edits from the first j - 1, j, j + 1 code points of x to the first j of y; more than one counts as two
        rows = [(2, 0, 1 if size else 2)]
        b, keep = a + 1, 0
        while b < n:
            y = texts[b]
            del rows[keep + 1 :]
            low, mid, high = rows[keep]
            dead = 0
            for j in range(keep, len(y)):
                c = y[j]
                new_low = min(low + (x[j - 1] != c), mid + 1) if 0 < j <= size else mid + 1 if j <= size else 2
                new_mid = min(mid + (x[j] != c), high + 1, new_low + 1) if j < size else 2
                high = min(high + (x[j + 1] != c), new_mid + 1) if j + 1 < size else 2
                low, mid = min(new_low, 2), min(new_mid, 2)
                high = min(high, 2)
                rows.append((low, mid, high))
                if low > 1 and mid > 1 and high > 1:
                    dead = j + 1
                    break
            if dead:
                prefix = y[:dead]
                # the first text after all that begin with the prefix
                after = bisect_left(texts, prefix[:-1] + chr(ord(prefix[-1]) + 1), b + 1)
                keep = common_prefix(texts[after], y) if after < n else 0
                b = after
                continue
            gap = size - len(y)
            if -1 <= gap <= 1 and rows[len(y)][gap + 1] == 1:
                yield a, b
            b += 1
            keep = shared[b] if b < n else 0


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_of(m: int, p: int, s: int, cap: int, words: list[tuple[str, int]]) -> Iterator[tuple]:
    """Of the words of a group with a near one there: number of near words, and the most frequent of them."""
    members = sorted((w[p : len(w) - s], w, n) for w, n in words)
    texts = [t for t, _, _ in members]
    found: dict[int, list] = {}
    for a, b in scan(texts):
        x, y = members[a][1], members[b][1]
        if min(len(x), len(y)) != m or p + common_prefix(texts[a], texts[b]) >= cap:
            continue
        for i, j in ((a, b), (b, a)):
            _, word, n = members[j]
            got = found.get(i)
            if got is None:
                found[i] = [1, n, word]
            else:
                got[0] += 1
                if (-n, word) < (-got[1], got[2]):
                    got[1:] = n, word
    for i, got in found.items():
        yield (members[i][1], *got)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``best_n`` and ``best`` of every word that has a near one; pairs stay inside tasks."""
    rows = grouped(words)
    placed = rows.repartition(shuffle_partitions(words.sparkSession), *KEY).sortWithinPartitions(*KEY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[str, int]] = []

        def done() -> list[tuple]:
            return list(near_of(*key[:4], held)) if key and len(held) > 1 else []

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, NEAR)], schema=NEAR)

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (*KEY, "word", "n")]
            for *own, word, n in zip(*columns):
                if (own := tuple(own)) != key:
                    out += done()
                    key, held = own, []
                held.append((word, n))
            yield table(out)
        yield table(done())

    parts = placed.mapInArrow(work, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("_n"), F.col("best").alias("_w")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", (-F.col("_b._n")).alias("best_n"), F.col("_b._w").alias("best")
    )


def with_roots(words: DataFrame) -> DataFrame:
    """``root`` of every word with a ``form``: forms followed to the last, twice as far in each round.

    Every step multiplies the count by FACTOR at least, so there are few rounds.
    """
    links = materialize(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
        links = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))


def variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of ``docs``.

    A null text has no words; a null doc_id counts as an empty one in the checksum.  Repeated rows count again.  Runs of any length are words.  Of equally
    frequent near words the first in code-point order is the form.  Within a batch of texts 64-bit hashes stand for words.
    An empty table gives an empty result; other columns are not read.
    """
    words = vocabulary(docs)
    near = near_words(words)
    rows = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best_n") >= FACTOR * F.col("n"), F.col("best")).alias("form"),
            F.when(F.col("best_n") >= FACTOR * F.col("n"), F.col("best_n")).alias("form_n"),
        )
    )
    return with_roots(rows).select("word", "form", "root", "n", "n_near", "form_n")
