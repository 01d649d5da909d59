import os

import numpy as np
import pytest

from trackloom.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def model():
    return P.load()


def brute(model, text):
    """Best score by trying every piece at every position of the bytes."""
    if not text:
        return 0.0
    data = bytes([P.SPACE]) + text.encode().replace(b" ", bytes([P.SPACE]))
    by = {}
    for i, w in enumerate(model.pieces):
        if w:
            by[w] = max(by.get(w, -1e18), model.scores[i])
    for b, i in enumerate(model.byte_ids):
        by[bytes([b])] = max(by.get(bytes([b]), -1e18), model.scores[i])
    longest = max(map(len, by))
    best = [0.0]
    for p in range(1, len(data) + 1):
        best.append(max(best[q] + by[data[q:p]] for q in range(max(0, p - longest), p) if data[q:p] in by))
    return best[-1]


TEXTS = [
    "Hello  world, the quick   brown fox", "a", " ", "\n", "tab\tand\nline \r\n", "literal ▁ sign and▁x", "日本語 \U0001f600\U0001f601 é ß", "x" * 300,
    "thonre is was anly hend\nEnti a wherer!!", "=" * 70 + "    " * 9, "\x00 \x01 \xff",
]


def test_scores_equal_brute_force(model, documents):
    rows = P.encoded(documents(list(enumerate(TEXTS))), model).collect()
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.tokens)
        assert abs(sum(model.scores[i] for i in r.tokens) - brute(model, TEXTS[r.doc_id])) < 1e-6


def test_one_by_one_equals_together(model):
    auto = P.automaton(model)
    words = [b"\xffhello", b"\xffthing", b"\xffwater", b"\xffa\xe9\xff\xff\xff"] * 5
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    ids, number = auto.solve(data, np.cumsum(length) - length, length)
    assert ids.tolist() == [int(i) for w in words for i in auto.lone(w)]
    assert number.sum() == len(ids)


def test_odd_rows_round_trip(model, documents, odd_rows):
    docs = documents(odd_rows)
    out = P.encoded(docs, model)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all(r.round_trip for r in rows)
    assert all((r.tokens is None) == (t is None) for r, (_, t) in zip(rows, odd_rows))
    back = P.decoded(out, model).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in back) == sorted((i or -1, t or "") for i, t in odd_rows)


def test_empty_table(model, documents):
    assert P.encoded(documents([]), model).count() == 0
    assert P.decoded(P.encoded(documents([]), model), model).count() == 0


def test_whole_table_round_trip(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = P.decoded(P.encoded(docs, model), model)
    assert back.join(docs, ["doc_id", "text"]).count() == docs.count()
