import random

import numpy as np

from trackloom.llm import probminhash as P


def shingle_set(text, width=5):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, similarity=0.8):
    """cluster id of every row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return sorted(sorted((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in groups.values())


def clusters(found):
    groups = {}
    for r in found.collect():
        groups.setdefault((r.cluster_id, r._th if r.cluster_size == 1 else 0), []).append((r._id is None, r._id or 0))
    return sorted(sorted(g) for g in groups.values())


def test_clusters_equal_brute_force(spark, documents):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(len(base) // 60):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert clusters(P.near_duplicates(documents(rows))) == brute(rows)


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert clusters(P.near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark, documents, odd_rows):
    found = {(r._id, r._th): r for r in P.near_duplicates(documents(odd_rows)).collect()}
    assert len(found) == len(set(odd_rows))
    by_id = {k[0]: r for k, r in found.items() if k[0] is not None}
    assert all(by_id[i].kept and by_id[i].cluster_size == 1 for i in (1, 2, 3, 9, 10))
    assert by_id[4].cluster_size == 3 and by_id[5].copy_of == 4 and not by_id[5].kept
    assert by_id[7].cluster_id == 6
    kept = P.one_of_each(documents(odd_rows))
    assert kept.columns == documents([]).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 10]  # once each


def test_empty_table(documents):
    assert P.near_duplicates(documents([])).count() == 0
    assert P.one_of_each(documents([])).count() == 0


def test_a_member_that_fails_the_leader_still_links(documents):
    words = [f"t{i}" for i in range(104)]

    def changed(*at):
        return " ".join(f"u{i}" if i in at else w for i, w in enumerate(words))

    # 0-1 and 1-2 are alike, 0-2 are not
    rows = [(0, changed()), (1, changed(20)), (2, changed(20, 60, 80)), (3, changed(1, 20, 40, 60, 80))]
    assert clusters(P.near_duplicates(documents(rows))) == brute(rows)


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    member = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    exact = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(60)) for i in range(60))
    row = np.repeat([0, 1], 60)
    found = P.registers(row, np.concatenate([member, member]), np.concatenate([a, b]), 2, 4000)
    assert abs((found[0] == found[1]).mean() - exact) < 0.03


def test_pairs_with_repeated_passages_share_a_band():
    rng = np.random.default_rng(3)
    for often in (1, 2, 5, 10, 20, 50, 1000):
        for both in (False, True):
            rows, members, counts = [], [], []
            for t in range(1000):  # pairs of set similarity 0.8; one text, or each, repeats half of what is shared
                member = rng.integers(1, 2**63, 100).astype(np.uint64)
                for side, own in enumerate((member[:90], np.concatenate([member[:80], member[90:]]))):
                    count = np.ones(90)
                    if side == 0:
                        count[:40] = often
                    elif both:
                        count[40:80] = often
                    order = np.argsort(own)
                    rows.append(np.full(90, 2 * t + side))
                    members.append(own[order])
                    counts.append(count[order])
            key = P.band_keys(np.concatenate(rows), np.concatenate(members), np.concatenate(counts), 2000)
            assert (key[::2] == key[1::2]).any(axis=1).mean() >= 0.99


def test_equal_sets_meet_whatever_their_counts():
    member = np.sort(np.random.default_rng(4).integers(1, 2**63, 50).astype(np.uint64))
    row = np.repeat([0, 1, 2], [50, 50, 49])
    count = np.concatenate([np.ones(50), np.full(50, 100.0), np.ones(49)])
    key = P.band_keys(row, np.concatenate([member, member, member[1:]]), count, 3)
    assert key[0, -1] == key[1, -1] != key[2, -1]


def test_a_text_that_repeats_a_passage_links_to_one_that_does_not(documents):
    rows = []
    for k in range(40):
        words = [f"p{k}x{i}" for i in range(60)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[:30] * 20 + words[30:])))
    found = clusters(P.near_duplicates(documents(rows)))
    assert found == brute(rows) and sum(len(g) == 2 for g in found) == 40
