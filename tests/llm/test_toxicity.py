import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import toxicity as T
from trackloom.llm.words import ALNUM, LOWER, words_of

BAD = ["idiotx", "scumy", "morone", "trashq"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 150))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def tokens(texts):
    return words_of(pa.array(texts, pa.string()), ALNUM, LOWER)


def test_windows_cover_all_words():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 200)]
    w = tokens(texts)
    x = T.inputs(w, np.zeros(0, np.uint64))
    order = np.unique(w.hash, return_inverse=True)[1] + 1
    count = np.bincount(w.row, minlength=len(texts))
    at = np.cumsum(count) - count
    for r, n in enumerate(count):
        own = x.windows[x.row == r]
        seen = set()
        for k, window in enumerate(own):
            f = int(x.filled[x.row == r][k])
            assert window[f:].sum() == 0
            assert window[:f].tolist() == order[at[r] + k * T.STRIDE : at[r] + k * T.STRIDE + f].tolist()
            seen |= set(range(k * T.STRIDE, k * T.STRIDE + f))
        assert seen == set(range(n))


def test_gradients_equal_differences():
    w = tokens(["one two three idiotx four", "five six " * 20])
    known = np.sort(np.unique(w.hash)[:4])
    net = T.Network.fresh(known, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, label = T.inputs(w, known), np.array([1.0, 0.0, 1.0])[: len(T.inputs(w, known).row)]
    which = np.arange(len(label))
    _, g = net.gradients(x, which, label)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        picks = rng.choice(len(flat), min(4, len(flat)), replace=False)
        if name in ("word", "char"):
            picks = np.flatnonzero(g[name].reshape(-1))[:4]
        for i in picks:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up, _ = net.gradients(x, which, label)
            flat[i] = old - step
            down, _ = net.gradients(x, which, label)
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), name


def test_held_out_accuracy_and_shuffled_batches(spark, documents):
    rows = corpus(450)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    docs = documents([(i, t) for i, t, _ in rows])
    net = T.fitted(docs, labels)
    out = T.scored(docs, net).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    again = {r.doc_id: r.score for r in T.scored(docs.repartition(5), net).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-5 for r in out)


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    rows = corpus(60)
    docs = documents([(i, t) for i, t, _ in rows])
    flip = [(i, 1, 1 - y if T.is_held_out(i) else y) for i, _, y in rows]
    schema = "doc_id long, quality int, toxic int"
    one = T.fitted(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], schema))
    two = T.fitted(docs, spark.createDataFrame(flip, schema))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def test_odd_rows(spark, documents, odd_rows):
    schema = "doc_id long, quality int, toxic int"
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 1), (8, 0, 0), (None, 1, 1), (10, None, None), (6, 1, 0), (999, 1, 1)], schema)
    out = T.scored(docs, T.fitted(docs, labels)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0 for r in out if r.doc_id in (1, 2, 3, 9))
    nothing = T.fitted(docs, labels.limit(0))
    assert {r.score for r in T.scored(docs, nothing).collect()} == {0.0}
    assert T.scored(documents([]), nothing).count() == 0
