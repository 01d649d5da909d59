import random
import re
import zlib
from collections import Counter

import pytest

from trackloom.llm import spelling as S


def edits(x, y):
    """The whole edit matrix."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(n_of):
    """Every pair of words by the whole matrix."""
    near = {w: [] for w in n_of}
    words = sorted(n_of)
    for i, x in enumerate(words):
        for y in words[i + 1 :]:
            if abs(len(x) - len(y)) < 2 and edits(x, y) == 1:
                near[x].append(y)
                near[y].append(x)
    form = {}
    for w in words:
        best = min(near[w], key=lambda y: (-n_of[y], y), default=None)
        form[w] = best if best is not None and n_of[best] >= 5 * n_of[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n_of[w], len(near[w]), n_of[form[w]] if form[w] else None))
    return out


def found(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def family(r, n, alphabet="abc", base=""):
    """Words that are near to many others, with counts that make chains of forms."""
    words = set()
    while len(words) < n:
        w = base + "".join(r.choice(alphabet) for _ in range(r.randint(6, 8)))
        words |= {w, w[:3] + w[4:] if len(w) > 6 else w, w[:2] + r.choice(alphabet) + w[2:], w[:-1] + r.choice(alphabet)}
    return [(w, 5 ** r.randint(1, 4) + r.randint(0, 3)) for w in sorted(words)]


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_matrix(seed):
    r = random.Random(seed)
    texts = sorted({"".join(r.choice("abé"[: 2 + seed % 2]) for _ in range(r.randint(0, 7))) for _ in range(150)})
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if edits(texts[a], texts[b]) == 1}
    got = list(S.scan(texts))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("split", [3, 20, 4096])
def test_groups_of_any_size(spark, monkeypatch, split):
    """Splitting hot groups again and again loses no pair and finds none twice."""
    monkeypatch.setattr(S, "SPLIT", split)
    r = random.Random(split)
    words = family(r, 250) + family(r, 120, "abcdé", "prefix") + [("x" * 500, 5), ("x" * 501, 40), ("y" + "x" * 500, 7)]
    near = S.near_words(spark.createDataFrame(words, "word string, n long"))
    want = {}
    n_of = dict(words)
    for w in n_of:
        own = [y for y in n_of if abs(len(y) - len(w)) < 2 and edits(w, y) == 1]
        if own:
            best = min(own, key=lambda y: (-n_of[y], y))
            want[w] = (len(own), n_of[best], best)
    assert {t.word: (t.n_near, t.best_n, t.best) for t in near.collect()} == want


def test_equals_brute_force(spark, documents, odd_rows):
    r = random.Random(5)
    rows = [(1000 + k, t) for k, t in enumerate([None, "", "ÀÉÎõçñ×÷ Straße STRASSE naïveté naÏvetÉ ß" * 6, "a1bcdefg_hijklmĀnopqrst uvwxyz " * 5])]
    bag = [w for w, n in family(r, 60, "abcé") for _ in range(n)]
    r.shuffle(bag)
    rows += [(k, " ".join(w.title() if r.random() < 0.3 else w for w in bag[50 * k : 50 * k + 50])) for k in range(len(bag) // 50 + 1)]
    rows += odd_rows + [(None, "nullable nullable nullables nullable nullable nullable")] * 3
    got = found(S.variants(documents(rows)))
    assert len(got) == len(set(got)) and set(got) == brute(counted(rows))
    assert any(g[1] and g[2] != g[1] for g in got)  # a chain of forms


def test_checksums_of_long_runs():
    import numpy as np

    words = [b"a" * 63, b"b" * 64, b"c" * 65, b"d" * 1000, b"xyz"]
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    before = np.array([zlib.crc32(b"7:")] * len(words), np.uint32)
    assert S.checksums(data, np.cumsum(length) - length, length, before).tolist() == [zlib.crc32(b"7:" + w) for w in words]


def test_empty_table(documents):
    assert S.variants(documents([])).count() == 0
    assert S.variants(documents([(1, None), (2, "short words only")])).count() == 0


def test_registered_query(spark, sf):
    from trackloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = found(QUERIES["op11_spelling_variants"](spark, sf))
    assert len(got) == len(set(got)) and set(got) == brute(counted(rows))
