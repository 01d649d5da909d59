"""Line dedup by an exact set-similarity join over lines of all documents.

The set of words of a line is ordered by rarity (counts over the whole corpus, kept in a fixed number of hash
buckets; within a bucket by hash).  Two lines of Jaccard similarity t or more share one of their first pairs of
neighbouring words in that order (``signatures``), so lines meet where they share such a pair.  There the length
filter, the positional filter and a parity sketch of 64 bits (its Hamming distance never exceeds the symmetric
difference) leave few pairs; those are verified on the lines themselves.  A line goes if an earlier line of
the corpus is alike; documents are in order of their id, null last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import overlaps, shuffle_partitions
from trackloom.llm.common import BROADCAST_ROWS
from trackloom.llm.words import U64, chunks, mix, runs, words_of
from trackloom.session import materialize

SIMILARITY = 0.8
BUCKET_BITS = 16
#: A prefix word of which a bucket counts more occurrences is split into parts of about this size.
HOT_WORDS = 500_000
MAX_PARTS = 64
_LINE, _KNOWN = -1, -2
_EPS = 1e-9


def _table(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(_order_id("doc_id").alias("d"), _short_hash(text).alias("h"), text.alias("_text"))


def _order_id(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(2**63 - 1))


def _short_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))


def word_ranks(rows: DataFrame) -> np.ndarray:
    """Rank by count of each of the 2^16 buckets of word hashes, and the counts; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in chunks(batches, "_text"):
            found = words_of(batch.column("_text")).hash >> U64(64 - BUCKET_BITS)
            total += np.bincount(found.astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows.select("_text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[r[0]] = r[1]
    return counts


def _sorted_within(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each run of ``values`` sorted, by sorting the rows of padded matrices of like lengths."""
    out = values.copy()
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    for k in np.unique(size[length > 1]):
        which = np.flatnonzero((size == k) & (length > 1))
        at = begin[which, None] + np.arange(1 << int(k))
        inside = np.arange(1 << int(k)) < length[which, None]
        block = np.where(inside, values[np.minimum(at, len(values) - 1)], U64(2**64 - 1))
        block.sort(axis=1)
        out[at[inside]] = block[inside]
    return out


def line_sets(column: pa.Array, order: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct words of each line with a word: (row, line, begin, size, words), rarest word first by ``order``."""
    w = words_of(column, lines=True)
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (w.line[1:] != w.line[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(w.hash)))
    word = w.hash
    if order is not None:
        low = U64((1 << (64 - BUCKET_BITS)) - 1)
        word = (order[(word >> U64(64 - BUCKET_BITS)).astype(np.int64)] << U64(64 - BUCKET_BITS)) | (word & low)
    word = _sorted_within(word, begin, length)
    keep = np.ones(len(word), bool)
    keep[1:] = word[1:] != word[:-1]
    keep[begin] = True
    size = np.add.reduceat(keep, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    return w.row[begin], w.line[begin], np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size, word[keep]


def _line_members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and word of one-line texts, sorted by both."""
    row, _, _, size, word = line_sets(column)
    return np.repeat(row, size), word


def signatures(begin: np.ndarray, size: np.ndarray, word: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(set, place, token, first word) by which alike sets are sure to meet, of sets whose words are in the common order.

    Let x lack a and y lack b of the words of the other.  Of the pairs of neighbouring words of x at most 2a + b are not
    such pairs of y, and what both have comes in the same order: the first common pair is one of the first 2a + b + 1 of x
    and of the first a + 2b + 1 of y.  Two words in a row are far rarer than one, so few lines meet that are not alike.
    Below a similarity of 0.75 short sets have too few pairs for that; there a token is one word of the prefix.
    """
    if similarity >= 1:
        take = np.zeros(len(size), np.int64)
    elif similarity >= PAIRS_FROM:
        r = similarity / (1 - similarity)
        a = np.floor(size / (1 + r) + _EPS).astype(np.int64)
        b = np.floor((size - a * (1 + r)) / r + _EPS).astype(np.int64)
        take = np.where(a + b > 0, np.minimum(2 * a + b + 1, size - 1), 0)
    else:
        least = similarity / (1 - similarity) - _EPS
        take = np.where(size >= least, size - np.ceil(similarity * size - _EPS).astype(np.int64) + 1, 0)
    of = np.repeat(np.arange(len(size)), take)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take)
    at = begin[of] + pos
    first = word[at]
    token = mix(first + U64(7)) if similarity < PAIRS_FROM else mix(mix(first + U64(7)) ^ word[at + 1])
    return of, pos, token, first


def _hot_tokens(rows: DataFrame, order: np.ndarray, counts: np.ndarray, similarity: float, hot_words: int) -> np.ndarray:
    """Counts of tokens of all documents in 2^16 buckets; they only say into how many parts a hot token is dealt.

    Nothing is hot unless a bucket of words is.
    """
    if counts.max() <= hot_words:
        return np.zeros(1 << BUCKET_BITS, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in chunks(batches, "_text"):
            _, _, begin, size, word = line_sets(batch.column("_text"), order)
            token = signatures(begin, size, word, similarity)[2]
            total += np.bincount((token >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows.select("_text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


class Order:
    """What all tasks know of the corpus: the rank of each bucket of words, counts of tokens, number of groups of tokens."""

    def __init__(self, rows: DataFrame, similarity: float, hot_words: int, parts: int):
        counts = word_ranks(rows)
        self.rank = np.empty(len(counts), U64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts), dtype=U64)
        self.hot = _hot_tokens(rows, self.rank, counts, similarity, hot_words)
        self.similarity, self.hot_words = similarity, hot_words
        self.groups = int(np.clip(counts.sum() // GROUP_WORDS, 8 * parts, 1 << 16))


def _asked_cell(token: np.ndarray) -> np.ndarray:
    return (token & U64((1 << ASKED_BITS) - 1)).astype(np.int64)


def postings(rows: DataFrame, order: Order, role: int | None = None, asked: np.ndarray | None = None) -> DataFrame:
    """Postings of all lines, packed: ``bucket`` of tokens and ``rows``, see ``_packed``.

    One posting per line under the hash of its set, and one per token of it (``signatures``): token, ``d`` and ``sub`` (line and
    text hash) naming the line, size of the set, place, role and the parity sketch: ``b1`` of 64 bits, with ``b2`` of 128 for
    sets over 96 words, with ``b3`` and ``b4`` of 256 over 160.  The place is -1 for a whole set and -2 for a line that is known
    to repeat.  ``w`` are 32 bits of the hash of the set.  A hot token is salted: its lines meet earlier ones in one part (role 1) and are met in all of them (role 2).
    With ``role`` there are only tokens, and all have that role or, for 1, their own; ``sub`` is read if it is there.
    With ``asked`` only tokens of marked cells are posted.
    """
    named = "sub" in rows.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple] = []
        for batch in chunks(batches, "_text"):
            d = batch.column("d").to_numpy(zero_copy_only=False)
            h = batch.column("h").to_numpy(zero_copy_only=False)
            row, line, begin, size, word = line_sets(batch.column("_text"), order.rank)
            if not len(row):
                continue
            sub = batch.column("sub").to_numpy(zero_copy_only=False)[row] if named else (line << 31) | h[row]
            mixed = mix(word + U64(1))
            whole = mix(np.add.reduceat(mixed, begin) ^ size.astype(U64))
            bits = _sketch(mixed, begin, size)
            # the earliest line of each set in this chunk stands for the others; the same line of a repeated row is no other
            at = np.lexsort((sub, d[row], whole))
            lead = np.ones(len(at), bool)
            lead[1:] = whole[at][1:] != whole[at][:-1]
            first, again = np.zeros(len(at), bool), np.zeros(len(at), bool)
            first[at[lead]] = True
            head = at[lead][np.cumsum(lead) - 1]
            again[at] = ~lead & (d[row[at]] == d[row[head]]) & (sub[at] == sub[head])
            line_pos = np.where(first, _LINE, _KNOWN)
            line_token = np.where(first, whole, mix(sub.astype(U64) + mix(d[row].astype(U64)) + U64(3)))
            lines = np.flatnonzero(first)
            of, pos, token, _ = signatures(begin[lines], size[lines], word, order.similarity)
            of = lines[of]
            n = np.clip(-(-order.hot[(token >> U64(64 - BUCKET_BITS)).astype(np.int64)] // order.hot_words), 1, MAX_PARTS)
            own = (mix(token ^ bits[0][of] ^ sub[of].astype(U64)) % n.astype(U64)).astype(np.int64)
            spread = np.repeat(np.arange(len(of)), n)
            part = np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
            roles = np.where(part == own[spread], 3, 2)
            token = np.where(n[spread] > 1, mix(token[spread] + mix(part.astype(U64) + U64(5))), token[spread])
            of, pos = of[spread], pos[spread]
            if asked is not None:
                keep = np.flatnonzero(asked[_asked_cell(token)])
                of, pos, token, roles = of[keep], pos[keep], token[keep], roles[keep]
            if role is not None:
                keep = np.flatnonzero(roles & role)
                of, pos, token, roles = of[keep], pos[keep], token[keep], roles[keep] & role
            else:
                own_lines = np.flatnonzero(~again)
                of, pos = np.concatenate([own_lines, of]), np.concatenate([line_pos[own_lines], pos])
                token = np.concatenate([line_token[own_lines], token])
                roles = np.concatenate([np.full(len(own_lines), 3), roles])
            lines = {"d": d[row], "sub": sub, "size": size, "w": whole >> U64(32)} | {f"b{k + 1}": b for k, b in enumerate(bits)}
            wait.append((lines, of.astype(np.uint32), pos.astype(np.int32), roles.astype(np.uint8), token))
            if sum(len(w[1]) for w in wait) >= PACKED_ROWS:
                yield from _packed(wait, order.groups)
                wait = []
        yield from _packed(wait, order.groups)

    return rows.mapInArrow(emit, "bucket int, rows binary")


#: Least similarity at which tokens are pairs of words.
PAIRS_FROM = 0.75
#: Words of a group of tokens, about.
GROUP_WORDS = 1 << 18
#: Postings that a task packs at once, bits of the cells that mark the tokens of open lines, packed rows sent at once.
PACKED_ROWS = 1 << 19
ASKED_BITS = 22
PACKED_STEP = 256
_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _packed(parts: list[tuple], groups: int) -> Iterator[pa.RecordBatch]:
    """Postings as one row per group of tokens: columns one after the other, each in the narrowest type that holds it.

    ``parts`` are lines, and of postings line, place, role and token.  Of a token the group and 32 bits are kept (lines that
    meet by chance are told apart by the sketch), of a whole set all 64, in place of ``w``.  Sketches are as wide as the size of
    the set asks for.
    """
    if not sum(len(p[1]) for p in parts):
        return
    lines = {k: np.concatenate([p[0][k] for p in parts]) for k in parts[0][0]}
    before = np.cumsum([0] + [len(p[0]["d"]) for p in parts[:-1]])
    token = np.concatenate([p[4] for p in parts])
    bucket = ((token >> U64(32)) % U64(groups)).astype(np.uint16)
    at = np.argsort(bucket, kind="stable")
    bucket, token = bucket[at], token[at]
    of = np.concatenate([p[1] + np.uint32(n) for p, n in zip(parts, before)])[at]
    pos, role = (np.concatenate([p[k] for p in parts])[at] for k in (2, 3))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    least = lines["d"].min()
    whole = pos < 0
    planes, kinds = [], []
    for line, rows in (
        (lines["d"].view(U64) - least.astype(np.int64).view(U64), None), (lines["sub"] >> 31, None), (lines["size"], None),
        (None, pos + 2), (None, role),
    ):
        values = rows if line is None else line
        kind = next(t for t in _KINDS if int(values.max()) <= np.iinfo(t).max)
        kinds.append(_KINDS.index(kind))
        # a column's bytes of one place stand together: the upper ones are zeros, and vanish where the shuffle compresses
        values = values.astype(kind) if line is None else values.astype(kind)[of]
        planes.append(values.view(np.uint8).reshape(len(of), -1))
    high = np.where(whole, token >> U64(32), lines["w"][of]).astype(np.uint32)
    cols = [(token & U64(0xFFFFFFFF)).astype(np.uint32), lines["b1"][of], (lines["sub"] & 0x7FFFFFFF).astype(np.uint32)[of], high]
    size = lines["size"][of]
    wide, widest = size > WIDE, np.flatnonzero(size > WIDEST)
    rare = [
        (np.cumsum(np.append(0, mask))[cuts].tolist(), value)
        for mask, value in (
            (wide, lines["b2"][of[wide]]), (size > WIDEST, lines["b3"][of[widest]]), (size > WIDEST, lines["b4"][of[widest]]),
        )
    ]
    base = least.astype(np.int64).tobytes() + bytes(kinds) + bytes(3)
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        out.append(
            b"".join(
                [base, np.int32(b - a).tobytes(), *[c[a:b].tobytes("F") for c in planes], *[c[a:b].tobytes() for c in cols]]
                + [v[n[i] : n[i + 1]].tobytes() for n, v in rare]
            )
        )
    table = pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(out, pa.binary())], names=["bucket", "rows"])
    for a in range(0, len(table), PACKED_STEP):
        yield table.slice(a, PACKED_STEP)


def _unpacked(bucket: int, packed: bytes) -> dict:
    """The postings of one row of ``_packed``; tokens of groups differ, and whole sets from other tokens."""
    base, kinds, n = np.frombuffer(packed, np.int64, 1), np.frombuffer(packed, np.uint8, 5, 8), int(np.frombuffer(packed, np.int32, 1, 16)[0])
    at = 20

    def column(kind, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(packed, kind, count, at)
        at += out.nbytes
        return out

    def planes(width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = column(np.uint8, n * width).reshape(width, n).T
        return out.view(np.int64).ravel()

    d, line, size, pos, role = [planes(1 << k) for k in kinds.tolist()]
    token, b1 = column(np.uint32, n).astype(U64), column(U64, n)
    h, high = column(np.uint32, n).astype(np.int64), column(np.uint32, n).astype(U64)
    pos -= 2
    wide, widest = np.flatnonzero(size > WIDE), np.flatnonzero(size > WIDEST)
    token |= np.where(pos < 0, high, U64(bucket)) << U64(32)
    d = (d.view(U64) + base.view(U64)).view(np.int64)
    rows = {"token": token, "d": d, "sub": (line << 31) | h, "size": size, "pos": pos, "role": role, "w": high, "b1": b1}
    for name, which in (("b2", wide), ("b3", widest), ("b4", widest)):
        rows[name] = np.zeros(n, U64)
        rows[name][which] = column(U64, len(which))
    return rows


#: Sizes of sets from which the sketch has 128 and 256 bits.
WIDE, WIDEST = 96, 160


def _sketch(mixed: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Parities of the words in each of 256 cells, stored so that the folds to 64 and to 128 cells can be read off."""
    bit, cell = U64(1) << (mixed & U64(63)), (mixed >> U64(6)) & U64(3)
    q = [np.bitwise_xor.reduceat(np.where(cell == U64(k), bit, U64(0)), begin) for k in (1, 2, 3)]
    every = np.bitwise_xor.reduceat(bit, begin)
    zero = U64(0)
    return [every, np.where(size > WIDE, q[0] ^ q[2], zero), np.where(size > WIDEST, q[1], zero), np.where(size > WIDEST, q[2], zero)]


#: Rows of postings that are compared at a time; a longer group is compared block by block.
BLOCK = 1 << 16
#: Candidates per line and word that are sent on at once, and the share of the largest distance up to which one is enough.
NEAREST, NEAR = 3, 0.5
_BITS = ("b1", "b2", "b3", "b4")


def _passing(similarity: float):
    """Of pairs (rows i of x, rows j of y): which may be alike, and the distance of their sketches."""
    slack = (1 - similarity) / (1 + similarity)

    def passing(x: dict, i: np.ndarray, y: dict, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sx, sy = x["size"][i], y["size"][j]
        apart = np.bitwise_count(x["b1"][i] ^ y["b1"][j])
        keep = np.flatnonzero(apart <= (sx + sy) * slack + _EPS)
        i, j, sx, sy = i[keep], j[keep], sx[keep], sy[keep]
        total, small, large = sx + sy, np.minimum(sx, sy), np.maximum(sx, sy)
        d1, d2, d3, d4 = (x[b][i] ^ y[b][j] for b in _BITS)
        q1 = d2 ^ d4
        two = np.bitwise_count(d1 ^ d2).astype(np.int64) + np.bitwise_count(d2)
        four = np.bitwise_count(d1 ^ q1 ^ d3 ^ d4).astype(np.int64) + np.bitwise_count(q1) + np.bitwise_count(d3) + np.bitwise_count(d4)
        apart = np.where(small > WIDEST, four, np.where(small > WIDE, two, apart[keep]))
        px, py = x["pos"][i], y["pos"][j]
        need = np.ceil(total * similarity / (1 + similarity) - _EPS)
        left = np.minimum(sx - px, sy - py) + np.minimum(px, py)
        ok = (apart <= total * slack + _EPS) & (left >= need) & (small >= similarity * large - _EPS)
        ok &= _differ(x, i, y, j) & ((x["role"][i] & 1) > 0)
        return keep[ok], apart[ok]

    return passing


def _candidates(similarity: float, everything: bool, block: int):
    """Of postings sorted by word and line: lines that repeat an earlier set, and lines that may be like an earlier one."""
    passing = _passing(similarity)
    slack = (1 - similarity) / (1 + similarity)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # earlier blocks of the word that is still open
        for rows, last in _whole_groups(batches, block):
            new = np.ones(len(rows["token"]), bool)
            new[1:] = (rows["token"][1:] != rows["token"][:-1]) | ((rows["pos"][1:] < 0) != (rows["pos"][:-1] < 0))
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(new)))
            index = np.arange(len(new)) - np.repeat(begin, size)
            known = np.flatnonzero(rows["pos"] == _KNOWN)
            out = [_pairs(rows, known, rows, known, 0, 0, 1)]
            if held and (held[0]["token"][0] != rows["token"][0] or (held[0]["pos"][0] < 0) != (rows["pos"][0] < 0)):
                held = []
            if held:  # against the blocks held of an open word
                head = np.arange(size[0])
                if rows["pos"][0] < 0:
                    head = head[_differ(rows, head, held[0], np.zeros(len(head), np.int64))]
                    out.append(_pairs(rows, head, held[0], np.zeros(len(head), np.int64), 0, 0, 1))
                else:
                    asks = head[(rows["role"][head] & 1) > 0]
                    out.extend(_against({c: v[asks] for c, v in rows.items()}, np.arange(len(asks)), held, passing, everything))
            # inside the block: row i with row i - k
            whole = np.flatnonzero((rows["pos"] == _LINE) & (index > 0))
            whole = whole[_differ(rows, whole, rows, whole - index[whole])]
            out.append(_pairs(rows, whole, rows, whole - index[whole], 0, 0, 1))
            live = np.flatnonzero((rows["pos"] >= 0) & (index > 0) & ((rows["role"] & 1) > 0))
            best = [np.full(len(new), 999, np.int64) for _ in range(NEAREST)]
            near = [np.full(len(new), -1) for _ in range(NEAREST)]
            count = np.zeros(len(new), np.int64)
            k = 1
            while len(live):
                at, apart = passing(rows, live, rows, live - k)
                x = live[at]
                if everything:
                    out.append(_pairs(rows, x, rows, x - k, 1, apart, 1))
                else:
                    count[x] += 1
                    y = x - k
                    for b, m in zip(best, near):  # insert where it is nearer, push the rest on
                        old, other = b[x], m[x]
                        closer = apart <= old
                        b[x], m[x] = np.where(closer, apart, old), np.where(closer, y, other)
                        apart, y = np.where(closer, old, apart), np.where(closer, other, y)
                k += 1
                live = live[index[live] >= k]
            if not everything:
                # a near first candidate is almost surely alike, others follow only where it is not near
                far = best[0] > NEAR * 2 * slack * rows["size"]
                sent = np.where(far, np.minimum(count, NEAREST), np.minimum(count, 1))
                for r in range(NEAREST):
                    x = np.flatnonzero(sent > r)
                    out.append(_pairs(rows, x, rows, near[r][x], 1, best[r][x], count[x] - sent[x]))
            if last:
                held = []
            else:
                tail = np.arange(begin[-1], len(new))
                held = held if held and len(begin) == 1 else []
                held.append({c: v[tail if rows["pos"][-1] != _LINE else tail[:1]] for c, v in rows.items()})
            table = pa.Table.from_batches(out)
            if table.num_rows:
                yield from table.combine_chunks().to_batches()

    return found


def _differ(x: dict, i: np.ndarray, y: dict, j: np.ndarray) -> np.ndarray:
    """Which rows i of x and j of y are not the same line; a row that occurs twice never repeats itself."""
    return (x["d"][i] != y["d"][j]) | (x["sub"][i] != y["sub"][j])


def _against(rows: dict, head: np.ndarray, held: list[dict], passing, everything: bool) -> list[pa.RecordBatch]:
    """Rows of an open word against its earlier blocks, in tiles of bounded size."""
    out = []
    n = len(head)
    best, count = np.full(n, 999, np.int64), np.zeros(n, np.int64)
    near = {k: rows[k][head].copy() for k in ("d", "sub")}
    step = max(1, (1 << 20) // max(n, 1))
    for block in held:
        for a in range(0, len(block["token"]), step):
            m = min(step, len(block["token"]) - a)
            i, j = np.repeat(head, m), np.tile(np.arange(a, a + m), n)
            at, apart = passing(rows, i, block, j)
            i, j = i[at], j[at]
            if everything:
                out.append(_pairs(rows, i, block, j, 1, apart, 1))
                continue
            count += np.bincount(i, minlength=n)[:n]
            order = np.lexsort((apart, i))
            i, j, apart = i[order], j[order], apart[order]
            lead = np.ones(len(i), bool)
            lead[1:] = i[1:] != i[:-1]
            i, j, apart = i[lead], j[lead], apart[lead]
            closer = apart < best[i]
            best[i[closer]] = apart[closer]
            for key in ("d", "sub"):
                near[key][i[closer]] = block[key][j[closer]]
    some = np.flatnonzero(count > 0)
    out.append(_pairs(rows, head[some], near, some, 1, best[some], count[some] - 1))
    return out


def _pairs(x: dict, i: np.ndarray, y: dict, j: np.ndarray, kind: int, apart, count) -> pa.RecordBatch:
    """Kind 0: the line repeats a set; 1: a candidate near by sketch, and how many more there are under the word."""
    cols = {
        "xd": x["d"][i], "xs": x["sub"][i], "yd": y["d"][j], "ys": y["sub"][j],
        "kind": np.full(len(i), kind, np.int32),
        "apart": np.broadcast_to(np.asarray(apart, np.int32), (len(i),)),
        "n": np.broadcast_to(np.asarray(count, np.int64), (len(i),)),
    }
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))


def _together(rows: dict, at: np.ndarray) -> np.ndarray:
    """Which rows, taken in the order ``at``, have the token of the one before."""
    token, whole = rows["token"][at], rows["pos"][at] < 0
    same = np.zeros(len(at), bool)
    same[1:] = (token[1:] == token[:-1]) & (whole[1:] == whole[:-1])
    return same


def _met(same: np.ndarray) -> np.ndarray:
    return same | np.append(same[1:], False)


def _meeting(parts: list[dict]) -> dict:
    """Of the postings of a group of tokens those that meet another one, by token and line, and lines known to repeat.

    Under a token the earliest line of a set stands for the others, which are found under the whole set.
    """
    rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def sorted_by(keep: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        return keep[np.lexsort([*(k[keep] for k in keys), rows["token"][keep], rows["pos"][keep] < 0])]

    at = np.argsort(rows["token"])
    at = at[_met(_together(rows, at)) | (rows["pos"][at] == _KNOWN)]
    at = sorted_by(at, 1 - (rows["role"] & 1), rows["sub"], rows["d"], rows["w"])
    copy = _together(rows, at) & (rows["pos"][at] >= 0)
    for c in ("w", "size", "pos", *_BITS):
        copy[1:] &= rows[c][at][1:] == rows[c][at][:-1]
    at = at[~copy]
    at = at[_met(_together(rows, at)) | (rows["pos"][at] == _KNOWN)]
    at = sorted_by(at, rows["sub"], rows["d"])
    return {k: v[at] for k, v in rows.items()}


def _whole_groups(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[dict, bool]]:
    """Blocks of postings that end with a token where that is possible, and whether they do."""

    def groups() -> Iterator[dict]:
        wait: list[dict] = []
        held = None
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("rows")):
                if bucket != held and wait:
                    yield _meeting(wait)
                    wait = []
                held = bucket
                wait.append(_unpacked(bucket, packed.as_buffer()))
        if wait:
            yield _meeting(wait)

    def joined(parts: list[dict]) -> dict:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    wait: list[dict] = []
    size = 0
    for rows in groups():
        n = len(rows["token"])
        if not n:
            continue
        if size + n <= 2 * block:  # several groups make a block
            wait.append(rows)
            size += n
            continue
        if wait:
            yield joined(wait), True
            wait, size = [], 0
        edge = np.ones(n, bool)
        edge[1:] = (rows["token"][1:] != rows["token"][:-1]) | ((rows["pos"][1:] < 0) != (rows["pos"][:-1] < 0))
        edges = np.append(np.flatnonzero(edge), n)
        a = 0
        while a < n:
            b = int(edges[np.searchsorted(edges, a + block, "right") - 1])
            if b > a:
                yield {k: v[a:b] for k, v in rows.items()}, True
                a = b
                continue
            end = int(edges[np.searchsorted(edges, a, "right")])  # a token longer than a block
            while a < end:
                b = min(a + block, end)
                yield {k: v[a:b] for k, v in rows.items()}, b == end
                a = b
    if wait:
        yield joined(wait), True


def removed_lines(
    docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, hot_words: int = HOT_WORDS
) -> DataFrame:
    """Lines that are like an earlier one: ``d``, ``h`` (document), ``line`` and ``exact`` (same set of words).

    Lines are cut at newlines, words at ASCII white space.  Lines without a word are never removed.
    ``docs`` has ``doc_id`` and ``text``; null texts have no lines with words.  Rows equal in id and text
    are one document read twice: they lose the same lines, and none for being there twice; rows of one id with other texts count
    as one document whose lines are in order of line, then of text hash.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = _table(docs)
    order = Order(rows, similarity, hot_words, parts)

    def met(of: DataFrame, everything: bool) -> DataFrame:
        placed = of.repartition(2 * parts, "bucket").sortWithinPartitions("bucket")
        return placed.mapInArrow(
            _candidates(similarity, everything, block), "xd long, xs long, yd long, ys long, kind int, apart int, n long"
        )

    found = materialize(met(postings(rows, order), False))
    exact = materialize(found.where("kind = 0").select("xd", "xs").distinct())
    near = found.where("kind = 1").groupBy("xd", "xs").agg(
        F.min(F.struct("apart", "yd", "ys")).alias("best"), F.max("n").alias("n")
    )
    near = materialize(near.join(exact, ["xd", "xs"], "left_anti").select("xd", "xs", "best.yd", "best.ys", "n"))
    alike = _verified(rows, near.select("xd", "xs", "yd", "ys"), similarity)
    # Those whose nearest candidate is not alike: the nearest ones under their other words.
    left = materialize(near.join(alike, ["xd", "xs"], "left_anti"))
    others = found.where("kind = 1").join(left.select("xd", "xs"), ["xd", "xs"], "left_semi").select("xd", "xs", "yd", "ys")
    others = others.distinct().join(left, ["xd", "xs", "yd", "ys"], "left_anti")
    second = _verified(rows, others, similarity)
    alike = alike.unionByName(second)
    # And those with more candidates under a word, none of them alike so far: all of their candidates.
    open_ = materialize(left.where("n > 0").select("xd", "xs").join(second, ["xd", "xs"], "left_anti"))
    if open_.head(1):
        lines = materialize(_lines(rows, open_).withColumn("h", F.col("sub").bitwiseAND(F.lit(0x7FFFFFFF))))
        asked = _asked(lines, order)
        # all lines are met under the tokens of open lines, and only these ask
        all_ = met(postings(rows, order, 2, asked).unionByName(postings(lines, order, 1)), True)
        alike = alike.unionByName(_verified(rows, all_.select("xd", "xs", "yd", "ys").distinct(), similarity))
    gone = exact.withColumn("exact", F.lit(True)).unionByName(alike.distinct().withColumn("exact", F.lit(False)))
    return gone.select(
        F.col("xd").alias("d"),
        F.col("xs").bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"),
        F.shiftright("xs", 31).cast("int").alias("line"),
        "exact",
    )


def _asked(lines: DataFrame, order: Order) -> np.ndarray:
    """Which cells hold a token of ``lines``; a table of fixed size, gathered as words of 64 cells."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("rows")):
                cell = np.unique(_asked_cell(_unpacked(bucket, packed.as_buffer())["token"]))
                at = np.flatnonzero(np.diff(cell >> 6, prepend=-1))
                bits = np.bitwise_or.reduceat(np.int64(1) << (cell & 63), at)
                yield pa.RecordBatch.from_arrays([pa.array(cell[at] >> 6), pa.array(bits)], names=["word", "bits"])

    out = np.zeros(1 << ASKED_BITS - 6, np.int64)
    found = postings(lines, order, 1).mapInArrow(cells, "word long, bits long").groupBy("word").agg(F.bit_or("bits"))
    for r in found.collect():
        out[r[0]] = r[1]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _lines(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``d``, ``sub`` and ``_text`` of the lines (xd, xs) of ``wanted``; documents without such a line are passed over."""
    wanted = materialize(
        wanted.groupBy(F.col("xd").alias("wd"), F.col("xs").bitwiseAND(F.lit(0x7FFFFFFF)).alias("wh")).agg(F.collect_list("xs").alias("subs"))
    )
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS // 4 else wanted
    return (
        rows.join(few, (F.col("d") == F.col("wd")) & (F.col("h") == F.col("wh")))
        .select("d", F.split("_text", "\n").alias("all"), F.explode("subs").alias("sub"))
        .select("d", "sub", F.get("all", F.shiftright("sub", 31).cast("int")).alias("_text"))
    )


def _verified(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Lines x of ``pairs`` whose set of words is alike to that of y, on the lines themselves."""

    def name(d: str, s: str) -> Column:
        return F.concat_ws(":", F.col(d), F.col(s))

    pairs = materialize(pairs.select("xd", "xs", name("xd", "xs").alias("x"), name("yd", "ys").alias("y"), "yd", "ys").distinct())
    ends = pairs.select("xd", "xs").unionByName(pairs.select(F.col("yd").alias("xd"), F.col("ys").alias("xs"))).distinct()
    lines = _lines(rows, ends).select(name("d", "sub").alias("node"), "_text").dropDuplicates(["node"])
    both = overlaps(pairs.select("x", "y"), materialize(lines), _line_members, shuffle_partitions(rows.sparkSession))
    good = both.where(F.col("common") >= similarity * (F.col("nx") + F.col("ny") - F.col("common")) - _EPS)
    at = F.split("x", ":")
    return materialize(good.select(at[0].cast("long").alias("xd"), at[1].cast("long").alias("xs")).distinct())


def line_report(docs: DataFrame, similarity: float = SIMILARITY, **sizes: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_lines``, ``removed`` (sorted line numbers from 0), ``n_removed``, ``n_exact``."""
    gone = removed_lines(docs, similarity, **sizes).groupBy("d", "h").agg(
        F.sort_array(F.collect_set("line")).alias("removed"), F.sum(F.col("exact").cast("long")).alias("n_exact")
    )
    text = F.col("text").cast("string")
    own = docs.select(
        F.col("doc_id"),
        _order_id("doc_id").alias("d"),
        _short_hash(F.coalesce(text, F.lit(""))).alias("h"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    return own.join(gone, ["d", "h"], "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
    )


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with those lines taken out of ``text`` (a text that had words and lost them all is empty); other columns as they were."""
    gone = materialize(
        removed_lines(docs, similarity).groupBy("d", "h").agg(F.collect_set("line").alias("removed"))
    )
    whole = docs.select(
        _order_id("doc_id").alias("_d"),
        _short_hash(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_h"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
    )
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 4 else gone
    joined = whole.join(few, (F.col("_d") == F.col("d")) & (F.col("_h") == F.col("h")), "left")
    lines = F.filter(F.split(F.col("_doc.text"), "\n"), lambda _, i: ~F.array_contains(F.col("removed"), i))
    text = F.when(F.col("removed").isNull(), F.col("_doc.text")).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
