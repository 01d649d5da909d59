"""Encoding to and decoding from sentence pieces: Viterbi driven by an Aho-Corasick automaton over the pieces.

The automaton reads UTF-8 bytes; at every position the pieces that end there (the state and its output links, longest
first) relax the best score.  A space is a byte of its own, ``0xFF``, so a literal U+2581 in a text stays apart
from it and every text survives the round trip.  Bytes that no piece covers become byte pieces.

A cut between two bytes that stand beside each other in no piece separates the problem, so equal
segments of a chunk of text are solved once, and segments of like length advance together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import bytes_of, chunks, hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0xFF
#: Cells (segments x positions) that advance together; fewer segments than LONE go one by one.
CELLS = 1 << 20
LONE = 8


@dataclass(frozen=True)
class Model:
    """Bytes and scores of pieces by id (None: not used in encoding), and the ids of the 256 byte pieces."""

    pieces: tuple[bytes | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def load(path: str = MODEL) -> Model:
    """The pieces of a model file.

    A unigram model brings log probabilities.  A byte-pair model brings merge ranks only; by Zipf's law the
    log probability of rank r is taken as ``-ln(r + 1)``.  A byte piece costs 10 more than the worst piece.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    plain = [not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(len(names))]
    own = np.array([p.get_score(i) for i in range(len(names))])
    ranks = len(own) > 1 and own[plain].max() >= 0 and np.all(own[plain] == np.round(own[plain]))
    scores = np.where(plain, -np.log1p(np.maximum(-own, 0) + 1) if ranks else own, 0.0)
    worst = float(scores[plain].min())
    pieces = [
        n.encode().replace("▁".encode(), bytes([SPACE])) if ok else None for n, ok in zip(names, plain)
    ]
    byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
    for b, i in enumerate(byte_ids):
        scores[i] = worst - 10
    return Model(tuple(pieces), tuple(scores.tolist()), tuple(byte_ids))


class Automaton:
    """Dense transitions, output links, and piece, length and score of terminal states."""

    def __init__(self, model: Model) -> None:
        edges: list[dict[int, int]] = [{}]
        piece = [-1]
        words = [(w, i) for i, w in enumerate(model.pieces) if w] + [
            (bytes([b]), i) for b, i in enumerate(model.byte_ids)
        ]
        for w, i in words:
            at = 0
            for b in w:
                if b not in edges[at]:
                    edges[at][b] = len(edges)
                    edges.append({})
                    piece.append(-1)
                at = edges[at][b]
            if piece[at] < 0 or model.scores[i] > model.scores[piece[at]]:
                piece[at] = i
        n = len(edges)
        go = np.zeros((n, 256), np.int32)
        fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = list(edges[0].values())
        for b, to in edges[0].items():
            go[0, b] = to
        for at in queue:  # grows while it is read: breadth first
            go[at] = go[fail[at]]
            for b, to in edges[at].items():
                fail[to] = go[fail[at], b]
                link[to] = fail[to] if piece[fail[to]] >= 0 else link[fail[to]]
                go[at, b] = to
                queue.append(to)
        depth = np.zeros(n, np.int32)
        for at in [0, *queue]:
            for to in edges[at].values():
                depth[to] = depth[at] + 1
        self.go, self.piece, self.length = go, np.array(piece, np.int32), depth
        self.first = np.where(self.piece >= 0, np.arange(n), link).astype(np.int32)  # longest piece that ends in a state
        self.next = link
        self.score = np.where(self.piece >= 0, np.array(model.scores)[self.piece], 0.0)
        self.inside = np.zeros((256, 256), bool)
        for w, _ in words:
            for a, b in zip(w, w[1:]):
                self.inside[a, b] = True
        # decoding
        spelled = [w or b"" for w in model.pieces]
        for b, i in enumerate(model.byte_ids):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.width = np.array([len(w) for w in spelled], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)[:-1]])

    def best(self, block: np.ndarray, length: int) -> np.ndarray:
        """Piece that ends the best segmentation at each position (positions x segments) of equally long rows of bytes."""
        n = block.shape[0]
        score = np.full((length + 1, n), -np.inf)
        score[0] = 0
        choice = np.full((length + 1, n), -1, np.int32)
        state = np.zeros(n, np.int32)
        columns = np.arange(n)
        for p in range(1, length + 1):
            state = self.go[state, block[:, p - 1]]
            node, at = self.first[state], columns
            while len(at):
                value = score[p - self.length[node], at] + self.score[node]
                better = value > score[p, at]
                score[p, at[better]] = value[better]
                choice[p, at[better]] = self.piece[node[better]]
                node = self.next[node]
                live = node > 0
                node, at = node[live], at[live]
        return choice

    def lone(self, segment: bytes) -> np.ndarray:
        """Pieces of one segment, position by position."""
        go, first, nxt, length, points = self.go, self.first, self.next, self.length, self.score
        score, choice, state = [0.0], [-1], 0
        for p, b in enumerate(segment, 1):
            state = go[state, b]
            node = int(first[state])
            top, pick = -np.inf, -1
            while node:
                value = score[p - length[node]] + points[node]
                if value > top:
                    top, pick = value, node
                node = int(nxt[node])
            score.append(top)
            choice.append(pick)
        out, p = [], len(segment)
        while p:
            out.append(int(self.piece[choice[p]]))
            p -= int(length[choice[p]])
        return np.array(out[::-1], np.int32)

    def solve(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all segments, one after the other, and their numbers."""
        order = np.argsort(length, kind="stable")
        number = np.zeros(len(begin), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(order):
            size = int(length[order[a]])
            end = int(np.searchsorted(length[order], size, "right"))
            end = min(end, a + max(1, CELLS // (size + 1)))
            which = order[a:end]
            a = end
            if len(which) < LONE:
                for k in which:
                    got = self.lone(data[begin[k] : begin[k] + size].tobytes())
                    number[k] = len(got)
                    parts.append((np.array([k]), got))
                continue
            choice = self.best(data[begin[which, None] + np.arange(size)], size)
            back = np.full((size, len(which)), -1, np.int32)
            p, k = np.full(len(which), size), 0
            live = np.arange(len(which))
            while len(live):
                piece = choice[p[live], live]
                back[k, live] = piece
                p[live] -= self.width[piece]
                live = live[p[live] > 0]
                k += 1
            used = (back >= 0).sum(0)
            number[which] = used
            forward = back.T[:, ::-1]
            parts.append((which, forward[forward >= 0]))
        begin_out = np.concatenate([[0], np.cumsum(number)[:-1]])
        out = np.zeros(int(number.sum()), np.int32)
        for which, got in parts:
            n = number[which]
            out[np.repeat(begin_out[which] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return out, number

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of prepared bytes, and the offsets of rows in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(data)))
        _, lead, same = np.unique(hashes(data, begin, length), return_index=True, return_inverse=True)
        if (length != length[lead][same]).any():  # two segments of one hash
            lead = same = np.arange(len(begin))
        solved, number = self.solve(data, begin[lead], length[lead])
        start = np.concatenate([[0], np.cumsum(number)[:-1]])
        n = number[same]
        ids = solved[np.repeat(start[same] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prepared bytes of all rows of ids, and the offsets of rows in them."""
        n = self.width[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.spelled[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return data, ends[offsets]


def prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with spaces as SPACE and one SPACE before every text that isn't empty."""
    data, offsets = bytes_of(column)
    some = offsets[1:] > offsets[:-1]
    out = np.insert(np.where(data == 0x20, np.uint8(SPACE), data), offsets[:-1][some], np.uint8(SPACE))
    return out, offsets + np.concatenate([[0], np.cumsum(some)])


def restored(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    out = []
    for a, b in zip(offsets, offsets[1:]):
        own = data[a:b]
        own = own[1:] if len(own) and own[0] == SPACE else own
        out.append(np.where(own == SPACE, np.uint8(0x20), own).tobytes().decode("utf-8", "replace"))
    return out


_AUTOMATA: dict[Model, Automaton] = {}


def automaton(model: Model) -> Automaton:
    """The automaton of a model, built once in each worker."""
    if model not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[model] = Automaton(model)
    return _AUTOMATA[model]


def encoded(docs: DataFrame, model: str | Model = MODEL, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` and ``n_tokens``, ``tokens`` and ``round_trip`` (decoding gives the text back) of every row.

    A null text has null tokens and counts 0; an empty one has none.  An empty table gives an empty result.  A row
    needs memory for its own text; equal rows are encoded alike.
    """
    model = load(model) if isinstance(model, str) else model
    rows = docs.select(*[F.col(f"`{c}`").alias(c) for c in columns], F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model)
        for batch in chunks(batches, "_text"):
            column = batch.column("_text")
            data, offsets = prepared(column)
            ids, at = auto.encode(data, offsets)
            again, back = auto.decode(ids, at)
            good = np.diff(back) == np.diff(offsets)
            if len(again) == len(data):
                wrong = np.concatenate([[0], np.cumsum(again != data)])
                good &= wrong[offsets[1:]] == wrong[offsets[:-1]]
            else:
                good = np.array([np.array_equal(again[a:b], data[c:d]) for a, b, c, d in zip(back, back[1:], offsets, offsets[1:])])
            null = pa.array(column.is_null().to_numpy(zero_copy_only=False))
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=null)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(np.diff(at)), tokens, pa.array(good)],
                names=[*columns, "n_tokens", "tokens", "round_trip"],
            )

    return rows.mapInArrow(work, f"{kinds}, n_tokens long, tokens array<int>, round_trip boolean")


def decoded(rows: DataFrame, model: str | Model = MODEL, tokens: str = "tokens", columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` and the ``text`` that ``tokens`` spell; null tokens give a null text."""
    model = load(model) if isinstance(model, str) else model
    rows = rows.select(*[F.col(f"`{c}`").alias(c) for c in columns], F.col(tokens).cast("array<int>").alias("_tokens"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model)
        for batch in batches:
            held = batch.column("_tokens")
            null = held.is_null().to_numpy(zero_copy_only=False)
            filled = pa.array(held.to_pylist(), pa.list_(pa.int32())) if held.null_count == 0 else pa.array(
                [x or [] for x in held.to_pylist()], pa.list_(pa.int32())
            )
            ids = filled.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = restored(*auto.decode(ids, filled.offsets.to_numpy().astype(np.int64)))
            out = pa.array([None if n else t for t, n in zip(text, null)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], out], names=[*columns, "text"])

    return rows.mapInArrow(work, f"{kinds}, text string")
