"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (if it is frequent in the training texts) and the mean of the vectors of its character
trigrams.  The network reads overlapping windows of words in both directions, pools its states by attention and scores every
window; the score of a text is that of its worst window, calibrated to a probability.

Only a text has a label, not a window.  Training therefore starts from the window of each text whose words tell
most, then goes on with the windows that the network itself finds worst.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import ALNUM, LOWER, U64, Words, chunks, words_of

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 12, 8, 4096
#: Labelled texts that the network is fitted on, at most, of either label.
SAMPLE = 1500
MIN_TEXTS = 3
#: Steps of training at least, in either turn.
MIN_STEPS = (120, 40)
THRESHOLD = 0.7
_STEP = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Inputs:
    """Distinct words of some texts (0 is padding), and the windows of word indices."""

    vocabulary: np.ndarray
    trigram: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    windows: np.ndarray
    filled: np.ndarray
    row: np.ndarray


def inputs(w: Words, known: np.ndarray) -> Inputs:
    unique, lead, same = np.unique(w.hash, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
    index = np.where(known[at] == unique, at + 1, 0) if len(known) else np.zeros(len(unique), np.int64)
    # trigrams of bytes with a border on both sides
    start, size = w.start[lead], w.end[lead] - w.start[lead]
    n = np.maximum(size, 1)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - first[of] + start[of]
    data = w.data.astype(np.int64)

    def byte(shift: int) -> np.ndarray:
        p = place + shift
        inside = (p >= start[of]) & (p < start[of] + size[of])
        return np.where(inside, data[np.clip(p, 0, max(len(data) - 1, 0))], 0)

    code = ((byte(-1) * 257 + byte(0)) * 257 + byte(1)) if len(of) else np.zeros(0, np.int64)
    trigram = (code.astype(np.uint64) * U64(0x9E3779B97F4A7C15) >> U64(40)).astype(np.int64) % TRIGRAMS
    # windows
    count = np.bincount(w.row, minlength=w.n_rows)
    base = np.cumsum(count) - count
    k = np.where(count > 0, np.maximum(-(-(count - WINDOW) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(w.n_rows), k)
    offset = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
    filled = np.minimum(count[row] - offset, WINDOW)
    cell = (base[row] + offset)[:, None] + np.arange(WINDOW)
    padded = np.arange(WINDOW) < filled[:, None]
    words = np.where(padded, same[np.minimum(cell, max(len(same) - 1, 0))] + 1 if len(same) else 0, 0)
    return Inputs(index, trigram, first, n, words.astype(np.int32), filled, row)


@dataclass
class Network:
    known: np.ndarray
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, known: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float | None = None) -> np.ndarray:
            return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        d = WORD_DIM + CHAR_DIM
        p = {"word": init(len(known) + 1, WORD_DIM, scale=0.3), "char": init(TRIGRAMS, CHAR_DIM, scale=0.3)}
        p["word"][0] = 0
        for s in "fb":
            p |= {f"W{s}": init(d, 3 * HIDDEN), f"U{s}": init(HIDDEN, 3 * HIDDEN), f"c{s}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": init(2 * HIDDEN, HIDDEN), "v": init(HIDDEN), "u": init(2 * HIDDEN), "o": np.zeros(1, np.float32)}
        return cls(known, p)

    def table(self, x: Inputs) -> np.ndarray:
        """Input vector of each distinct word; row 0 is padding."""
        total = np.add.reduceat(self.p["char"][x.trigram], x.begin, axis=0) if len(x.begin) else np.zeros((0, CHAR_DIM))
        out = np.zeros((len(x.vocabulary) + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[1:, :WORD_DIM] = self.p["word"][x.vocabulary]
        out[1:, WORD_DIM:] = total / x.length[:, None]
        return out

    def _read(self, s: str, pre: np.ndarray, windows: np.ndarray, mask: np.ndarray, trace: list | None) -> np.ndarray:
        """States (positions x windows x HIDDEN) of one direction."""
        n = len(windows)
        states = np.zeros((WINDOW, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(WINDOW) if s == "f" else range(WINDOW - 1, -1, -1):
            x, g = pre[windows[:, t]], h @ self.p[f"U{s}"]
            gate = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            r, z = gate[:, :HIDDEN], gate[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = h + mask[:, t, None] * ((1 - z) * (c - h))
            if trace is not None:
                trace.append((t, h, r, z, c, g[:, 2 * HIDDEN :]))
            h = new
            states[t] = h
        return states

    def forward(self, x: Inputs, table: np.ndarray, which: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of the windows ``which``."""
        windows = x.windows[which]
        mask = (np.arange(WINDOW) < x.filled[which, None]).astype(np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        both = [
            self._read(s, table @ self.p[f"W{s}"] + self.p[f"c{s}"], windows, mask, trace[s] if keep is not None else None) for s in "fb"
        ]
        h = np.concatenate(both, axis=2)
        a = np.tanh(h @ self.p["A"])
        e = np.where(mask.T > 0, a @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        if keep is not None:
            keep |= {"windows": windows, "mask": mask, "trace": trace, "h": h, "a": a, "w": w, "pooled": pooled}
        return pooled @ self.p["u"] + self.p["o"]

    def gradients(self, x: Inputs, which: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows and its gradient in every parameter."""
        p, k, table = self.p, {}, self.table(x)
        logit = self.forward(x, table, which, k)
        prob = _sigmoid(logit)
        loss = float(-np.mean(label * np.log(prob + 1e-9) + (1 - label) * np.log(1 - prob + 1e-9)))
        d = ((prob - label) / len(which)).astype(np.float32)
        g = {"o": np.array([d.sum()], np.float32), "u": k["pooled"].T @ d}
        d_pooled = d[:, None] * p["u"]
        h, w, a = k["h"], k["w"], k["a"]
        d_w = np.einsum("nh,tnh->tn", d_pooled, h)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_a = d_e[:, :, None] * p["v"] * (1 - a * a)
        g["v"] = np.einsum("tn,tnh->h", d_e, a)
        g["A"] = np.einsum("tni,tnj->ij", h, d_a)
        d_h = w[:, :, None] * d_pooled + d_a @ p["A"].T
        d_table = np.zeros_like(table)
        for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            d_pre = np.zeros((len(table), 3 * HIDDEN), np.float32)
            d_u = np.zeros_like(p[f"U{s}"])
            carry = np.zeros((len(which), HIDDEN), np.float32)
            for t, before, r, z, c, gc in reversed(k["trace"][s]):
                out = carry + d_h[t][:, part]
                m = k["mask"][:, t, None]
                d_c = out * m * (1 - z) * (1 - c * c)
                d_z = out * m * (before - c) * z * (1 - z)
                d_r = d_c * gc * r * (1 - r)
                pre = np.concatenate([d_r, d_z, d_c], axis=1)
                inner = np.concatenate([d_r, d_z, d_c * r], axis=1)
                np.add.at(d_pre, k["windows"][:, t], pre)
                d_u += before.T @ inner
                carry = out * (1 - m * (1 - z)) + inner @ p[f"U{s}"].T
            g[f"U{s}"], g[f"W{s}"], g[f"c{s}"] = d_u, table.T @ d_pre, d_pre.sum(0)
            d_table += d_pre @ p[f"W{s}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], x.vocabulary, d_table[1:, :WORD_DIM])
        g["word"][0] = 0
        share = d_table[1:, WORD_DIM:] / x.length[:, None]
        np.add.at(g["char"], x.trigram, np.repeat(share, x.length, axis=0))
        return loss, g

    def logits(self, x: Inputs) -> np.ndarray:
        """Logits of all windows."""
        table = self.table(x)
        parts = [self.forward(x, table, np.arange(a, min(a + _STEP, len(x.windows)))) for a in range(0, len(x.windows), _STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def scores(self, w: Words) -> np.ndarray:
        """Probability of each text: its worst window, calibrated; texts without words get 0."""
        out = np.zeros(w.n_rows)
        if self.constant is not None:
            return np.where(np.bincount(w.row, minlength=w.n_rows) > 0, self.constant, 0.0)
        x = inputs(w, self.known)
        top = np.full(w.n_rows, -np.inf)
        np.maximum.at(top, x.row, self.logits(x))
        some = np.isfinite(top)
        out[some] = _sigmoid(self.slope * top[some] + self.shift)
        return out


def _adam(p: dict, g: dict, state: dict, rate: float) -> None:
    state["n"] = state.get("n", 0) + 1
    for k, v in g.items():
        m, s = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
        m += 0.1 * (v - m)
        s += 0.001 * (v * v - s)
        p[k] -= rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(s / (1 - 0.999 ** state["n"])) + 1e-8)


def train(texts: list[str], label: np.ndarray, epochs: tuple[int, int] = (6, 4), seed: int = 7, batch: int = 256) -> Network:
    """A network fitted on whole texts and their labels; a constant one if a label is missing."""
    label = np.asarray(label, np.float32)
    if not len(label) or label.min() == label.max():
        return Network(np.zeros(0, U64), {}, constant=float(label.mean()) if len(label) else 0.0)
    w = words_of(pa.array(texts, pa.string()), ALNUM, LOWER)
    pairs = np.unique(np.stack([w.hash, w.row.astype(U64)]), axis=1)
    unique, index = np.unique(pairs[0], return_inverse=True)
    in_toxic = np.bincount(index, weights=label[pairs[1].astype(np.int64)], minlength=len(unique))
    in_all = np.bincount(index, minlength=len(unique))
    known = unique[in_all >= MIN_TEXTS]
    odds = np.log((in_toxic + 0.5) / (label.sum() + 1)) - np.log((in_all - in_toxic + 0.5) / (len(label) - label.sum() + 1))
    odds = np.where(in_all >= MIN_TEXTS, odds, 0.0)
    x = inputs(w, known)
    rng = np.random.default_rng(seed)
    per_word = np.concatenate([[0.0], np.maximum(odds, 0)])  # unique words of w in the same order
    telling = per_word[x.windows].max(1) + 1e-6 * per_word[x.windows].sum(1)
    net, state = Network.fresh(known, seed), {}
    net.p["word"][1:, 0] = np.clip(odds[in_all >= MIN_TEXTS], -3, 3)

    def worst(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, x.row))
        lead = np.ones(len(order), bool)
        lead[1:] = x.row[order][1:] != x.row[order][:-1]
        return order[lead]

    for turn, rounds in enumerate(epochs):
        value = telling if turn == 0 else net.logits(x)
        picked = worst(value)
        clean = np.flatnonzero(label[x.row] == 0)
        rounds = max(rounds, -(-MIN_STEPS[turn] * batch // (2 * len(picked))))
        for k in range(rounds):
            more = rng.choice(clean, min(len(clean), len(picked)), replace=False)
            which = rng.permutation(np.concatenate([picked, more]))
            rate = 0.01 if turn == 0 else 0.004 * (1 - k / rounds)
            for a in range(0, len(which), batch):
                part = which[a : a + batch]
                _, g = net.gradients(_only(x, part), np.arange(len(part)), label[x.row[part]])
                _adam(net.p, g, state, rate)
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, x.row, net.logits(x))
    some = np.isfinite(top)
    net.slope, net.shift = _calibrated(top[some], label[some])
    return net


def _only(x: Inputs, which: np.ndarray) -> Inputs:
    """The words of some windows only."""
    used, windows = np.unique(np.append(x.windows[which].ravel(), 0), return_inverse=True)
    own = used[1:] - 1
    n = x.length[own]
    trigram = x.trigram[np.repeat(x.begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    return Inputs(x.vocabulary[own], trigram, np.cumsum(n) - n, n, windows[:-1].reshape(len(which), WINDOW), x.filled[which], x.row[which])


def _calibrated(top: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with a weak pull to slope 1 (Newton steps)."""
    beta = np.array([1.0, 0.0])
    design = np.stack([top, np.ones(len(top))], 1).astype(np.float64)
    for _ in range(30):
        p = _sigmoid(design @ beta)
        grad = design.T @ (p - label) + 1e-2 * (beta - [1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta - np.linalg.solve(hess, grad)
    return float(max(beta[0], 1e-3)), float(beta[1])


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on at most ``sample`` texts of either label that are not held out.

    Of the labelled rows those of smallest hash are taken; only they are read from ``docs`` (a bounded broadcast) and
    brought to the driver.  Ids with several labels count as toxic if one says so; null labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).dropna()
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).where(F.crc32(F.col("_id").cast("string")) % 3 != 1)
    order = [F.xxhash64("_id", F.lit("toxicity")), F.col("_id")]
    picked = known.where("_y = 1").orderBy(*order).limit(sample).unionByName(known.where("_y <> 1").orderBy(*order).limit(sample))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
        .join(F.broadcast(picked), "_id")
        .collect()
    )
    rows.sort(key=lambda r: (r._id, r._text))
    return train([r._text for r in rows], np.array([int(r._y == 1) for r in rows]))


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row.

    Null and empty texts and texts without words score 0; the id ``null`` is never held out.  All windows of whole texts
    are scored.  Equal texts score alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    parameters = rows.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parameters.value
        for batch in chunks(batches, "_text", 1 << 20):
            score = np.clip(model.scores(words_of(batch.column("_text"), ALNUM, LOWER)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = rows.mapInArrow(work, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
