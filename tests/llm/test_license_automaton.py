import random
import re

import numpy as np

from trackloom.llm import license_automaton as A
from trackloom.llm.license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOW))
    places, labels = [], set()
    for label, phrase in PHRASES:
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def digest(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    templates = [[rng.randrange(5) for _ in range(rng.randrange(3, 30))] for _ in range(6)]
    phrases = [[0, 1], [1, 1, 2], [3], [0, 1, 2]]
    auto = A.SuffixAutomaton(templates, phrases)
    assert auto.vocabulary.tolist() == sorted({w for t in templates + phrases for w in t})
    text = [rng.randrange(5) for _ in range(600)]
    ids = np.searchsorted(auto.vocabulary, np.array(text, np.uint64))
    begin, length = np.array([0, 200, 203]), np.array([200, 3, 397])
    state, run = auto.statistics(ids, begin, length)
    for a, n in zip(begin, length):
        for i in range(a, a + n):
            best = 0
            for t in templates + phrases:
                for e in range(len(t)):
                    k = 0
                    while k <= e and i - k >= a and text[i - k] == t[e - k]:
                        k += 1
                    best = max(best, k)
            assert run[i] == best
            ends = {(k, e) for k, t in enumerate(templates) for e in range(best - 1, len(t)) if t[e - best + 1 : e + 1] == text[i - best + 1 : i + 1]}
            assert set(auto.ends[state[i]]) == ends
            for k, p in enumerate(phrases):
                stands = i - len(p) + 1 >= a and text[i - len(p) + 1 : i + 1] == p
                assert (bool(auto.here[state[i], k]) and run[i] >= len(p)) == stands


def test_base_columns_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = A.scanned(docs).collect()
    assert len(out) == len(text)
    assert all(digest(r) == brute(text[r.doc_id]) for r in out)
    assert sum(r.n_base for r in out) > 0


def test_templates_give_their_labels(documents):
    rows = [(i, f"before some words {t} and after") for i, (_, t) in enumerate(TEMPLATES)]
    rows.append((100, "the mit license and gnu general public license, CC BY or apache\nlicense; the end of the term"))
    rows.append((101, "you may not use of this work in the hope that a copy of it is free"))
    body = TEMPLATES[5][1].split()
    rows.append((102, " ".join(w if i % 25 else "changed" for i, w in enumerate(body))))
    out = {r.doc_id: r for r in A.scanned(documents(rows)).collect()}
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in out[i].labels.split(",") and out[i].score == 1.0
        assert [(s.first, s.covered) for s in out[i].spans if s.label == label][0] == (3, 1.0)
    assert out[100].labels == out[100].base_labels == "apache,cc-by,gpl,mit" and out[100].score >= 0.5
    assert out[101].labels == "" and out[101].score < 0.5
    assert out[102].labels == "mit" and 0.75 <= out[102].score < 1


def test_a_quotation_inside_a_template_keeps_the_label(documents):
    quote = {"mit": "free of charge to any person", "bsd": "redistributions of source code must retain"}
    rows, wanted = [], {}
    for i, (label, t) in enumerate(TEMPLATES):
        body = t.split()
        if label in quote and len(body) > 60:
            middle = len(body) // 2
            rows.append((i, " ".join([*body[:middle], f"[{quote[label]}]", *body[middle:]])))
            wanted[i] = label
    assert set(wanted.values()) == set(quote)
    out = {r.doc_id: r for r in A.scanned(documents(rows)).collect()}
    for i, label in wanted.items():
        assert label in out[i].labels.split(",") and out[i].score > 0.95
        assert [s.first for s in out[i].spans if s.label == label] == [0]


def test_chains_are_the_best_ones():
    rng = random.Random(8)
    for _ in range(300):
        end, begin, matches, ends = 0, 0, [], []
        for k in range(rng.randrange(1, 8)):
            end += rng.randrange(1, 6)
            begin = rng.randrange(begin, end)
            matches.append((end, end - begin + 1, k))
            ends.append([(t, rng.randrange(end - begin, end - begin + 12)) for t in range(2) for _ in range(rng.randrange(3))])

        def longest(t, at, place):  # of chains that end with run `at` at `place`, over all ways
            e, n, k = matches[at]
            ways = [n]
            for j in range(at):
                if e - n + 1 - matches[j][0] <= 4:
                    ways += [longest(t, j, p) + min(n, e - matches[j][0], place - p) for u, p in ends[j] if u == t and p < place]
            return max(ways)

        got = A.chains(matches, ends, 3)
        for t in range(2):
            every = [longest(t, i, p) for i in range(len(matches)) for u, p in ends[i] if u == t]
            mine = [c for c in got if c[0] == t]
            assert max((c[3] for c in mine), default=0) == max(every, default=0)
            assert all(a[2] < b[1] for a, b in zip(mine, mine[1:]))


def test_odd_rows(documents, odd_rows):
    out = A.scanned(documents(odd_rows + [(20, "Cc\tbY"), (21, "mit license " * 3000)])).collect()
    assert len(out) == len(odd_rows) + 2
    by = {r.doc_id: r for r in out}
    assert digest(by[1]) == digest(by[2]) == digest(by[3]) == (0, 0, None, None, "") and by[1].score == 0
    assert digest(by[20]) == (2, 1, 0, 0, "cc-by")
    assert digest(by[21]) == (6000, 3000, 0, 5998, "mit")
    assert A.scanned(documents([])).count() == 0
