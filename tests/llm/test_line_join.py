import random

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import line_join as L

SPACES = str.maketrans("\t\x0b\x0c\r", "    ")


def brute(rows, similarity=0.8):
    """(row index, line) of removed lines, by comparing each line with all earlier ones."""
    lines = []
    for i, (doc_id, text, *_) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in line.translate(SPACES).split(" ") if w)
            if words:
                lines.append(((doc_id is None, doc_id or 0), k, i, words))
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for a, (_, k, i, words) in enumerate(lines):
        for _, _, _, other in lines[:a]:
            if len(words & other) >= similarity * len(words | other) - 1e-9:
                gone.add((rows[i][0], k))
                break
    return gone


def found(docs, **more):
    out = L.line_report(docs, **more).collect()
    return {(r.doc_id, k) for r in out for k in r.removed}


def families(seed, n):
    rng = random.Random(seed)
    common, vocab = [f"c{i}" for i in range(8)], [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocab + common * 20) for _ in range(rng.choice([2, 5, 9, 20, 60]))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(12)]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_removed_lines_equal_brute_force(documents, similarity):
    rows = families(3, 60)
    assert found(documents(rows), similarity=similarity) == brute(rows, similarity)


@pytest.mark.parametrize("sizes", [{"block": 8}, {"block": 8, "hot_words": 20}])
def test_small_blocks_and_hot_words(documents, sizes):
    # a group longer than a block, and words split over parts
    rows = families(4, 50)
    assert found(documents(rows), **sizes) == brute(rows)


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"block": 4}, {"block": 8, "hot_words": 20}])
def test_repeated_rows_keep_their_first_lines(documents, sizes):
    rows = families(6, 40)
    twice = rows + rows[::3] + rows[::3] + [(None, "a line of words without id"), (None, "a line of words without id")]
    # a row that occurs again takes no line from itself, in one task or in several
    expected = brute(rows)
    assert found(documents(twice).coalesce(1), **sizes) == expected
    docs = documents(twice).repartition(5)
    assert found(docs, **sizes) == expected
    if not sizes:
        kept = {(r.doc_id, r.text) for r in L.without_repeated_lines(docs).collect()}
        assert kept == {(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in expected)) for i, t in twice}


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    report = L.line_report(docs).collect()
    assert len(report) == len(odd_rows)
    by_id = {r.doc_id: r for r in report if r.doc_id is not None}
    assert by_id[1].n_lines == 0 and by_id[1].removed == [] and by_id[3].removed == []
    assert by_id[4].removed == [] and by_id[5].removed == [0]
    assert by_id[7].removed == [0] and by_id[8].removed == [4]
    out = L.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType.simpleString() == "string"
    text = {}
    for r in out.collect():
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[8] == ["\n\n\nline\n"] and text[1] == [None] and text[5] == ["", ""] and text[2] == [""]


def test_empty_table(documents):
    assert L.line_report(documents([])).count() == 0
    assert L.without_repeated_lines(documents([])).count() == 0


def flat(sets):
    size = np.array([len(x) for x in sets], np.int64)
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size, np.array([w for x in sets for w in sorted(x)], np.uint64)


def tokens_of(sets, similarity):
    of, _, token, _ = L.signatures(*flat(sets), similarity)
    out = [set() for _ in sets]
    for i, t in zip(of.tolist(), token.tolist()):
        out[i].add(t)
    return out


@pytest.mark.parametrize("similarity", [0.6, 0.75, 0.8, 0.9])
def test_alike_sets_share_a_token(similarity):
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 3000:
        x = set(rng.sample(range(400), rng.randrange(2, 60)))
        y = set(x) - set(rng.sample(sorted(x), min(len(x) - 1, rng.randrange(0, 1 + len(x) // 4))))
        y |= set(rng.sample(range(400), rng.randrange(0, 2 + len(x) // 5)))
        if x != y and len(x & y) >= similarity * len(x | y) - 1e-9:
            pairs += [x, y]
    found = tokens_of(pairs, similarity)
    assert all(a & b for a, b in zip(found[::2], found[1::2]))


def test_lines_that_are_not_alike_rarely_meet():
    # words of one prefix made a group of lines grow with the corpus, and its pairs with the square
    rng = random.Random(12)
    found = tokens_of([set(rng.sample(range(2000), 40)) for _ in range(1500)], 0.8)
    size = {}
    for tokens in found:
        for t in tokens:
            size[t] = size.get(t, 0) + 1
    assert sum(n * (n - 1) // 2 for n in size.values()) < 0.02 * 1500 * 1499 / 2


def test_packed_postings_come_back():
    rng = np.random.default_rng(13)
    n, m = 200, 1000
    lines = {
        "d": rng.integers(-5, 2**40, n), "sub": rng.integers(0, 2**50, n), "size": rng.integers(1, 400, n),
        "w": rng.integers(0, 2**32, n).astype(np.uint64), **{b: rng.integers(0, 2**63, n).astype(np.uint64) for b in L._BITS},
    }
    lines["d"][0] = 2**63 - 1
    lines["b2"][lines["size"] <= L.WIDE] = 0
    lines["b3"][lines["size"] <= L.WIDEST] = lines["b4"][lines["size"] <= L.WIDEST] = 0
    of, pos, token = rng.integers(0, n, m).astype(np.uint32), rng.integers(-2, 90, m).astype(np.int32), rng.integers(0, 2**63, m).astype(np.uint64)
    role = rng.integers(1, 4, m).astype(np.uint8)
    rows = [
        L._unpacked(b, p.as_buffer())
        for batch in L._packed([(lines, of, pos, role, token)], 7) for b, p in zip(batch.column("bucket").to_pylist(), batch.column("rows"))
    ]
    names = ("d", "sub", "size", *L._BITS)
    got = sorted(zip(*[np.concatenate([r[k] for r in rows]).tolist() for k in (*names, "pos", "role")]))
    assert got == sorted(zip(*[lines[k][of].tolist() for k in names], pos.tolist(), role.tolist()))
    whole = sorted(np.concatenate([r["token"][r["pos"] < 0] for r in rows]).tolist())
    assert whole == sorted(token[pos < 0].tolist())


def test_hot_tokens_are_counted_on_all_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "COUNTED", 10, raising=False)  # once the words above which a share of the documents was counted
    rows = L._table(documents([(i, " ".join(f"a{(i * k) % 17}" for k in range(1, 9))) for i in range(60)]))
    order = L.Order(rows, 0.8, 1, 2)
    texts = pa.array([r._text for r in rows.collect()])
    _, _, begin, size, word = L.line_sets(texts, order.rank)
    token = L.signatures(begin, size, word, 0.8)[2]
    assert len(token) > 60
    assert (order.hot == np.bincount((token >> L.U64(64 - L.BUCKET_BITS)).astype(np.int64), minlength=1 << L.BUCKET_BITS)).all()
