import hashlib
import re

from pyspark.sql import functions as F

from trackloom.llm import mixing as M


def brute(rows):
    """taken words by row, and targets by source, by running the queue one copy after the other."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    target, open_, left = {}, set(sources), float(sum(size))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level >= 3 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    copies = []
    for s in sources:
        key = lambda i: hashlib.md5(f"{M.SEED}:{'null' if rows[i][0] is None else rows[i][0]}:{hashlib.md5((rows[i][1] or '').encode()).hexdigest()}".encode()).hexdigest()
        own, at = sorted((key(i), i) for i in range(len(rows)) if rows[i][2] == s), 0
        for k, i in own:
            at += size[i]
            for e in range(3):
                if size[i] and target[s] and e <= target[s] // total[s]:
                    copies.append(((e * total[s] + at) / target[s], s is None, s or "", k, at, i))
    taken, spent = [0] * len(rows), 0
    for *_, i in sorted(copies):
        spent += size[i]
        if spent > sum(size):
            break
        taken[i] += size[i]
    return size, taken, target


def test_mix_equals_brute_force(documents):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "c", "é", None, "hot"][min(5, i % 9)]) for i in range(400)]
    size, taken, target = brute(rows)
    out = {r.doc_id: r for r in M.mixed(documents(rows)).collect()}
    assert [out[i].taken for i in range(400)] == taken and [out[i].size for i in range(400)] == size
    assert all(abs(out[i].target - target[rows[i][2]]) < 1e-6 for i in range(400))
    for s, aim in target.items():
        got = sum(t for t, r in zip(taken, rows) if r[2] == s)
        assert abs(got - aim) <= 50 and all(t <= 3 * n for t, n in zip(taken, size))


def test_reruns_and_partitions_agree(documents):
    rows = [(i, "w " * (i % 11), f"s{i % 5}") for i in range(200)]
    once = sorted(map(tuple, M.mixed(documents(rows)).select("doc_id", "taken").collect()))
    again = sorted(map(tuple, M.mixed(documents(rows[::-1]).repartition(7)).select("doc_id", "taken").collect()))
    assert once == again


def test_odd_rows_and_rows_of_the_mixture(documents, odd_rows):
    rows = [(i, t, "ab"[k % 2] if k % 5 else None) for k, (i, t) in enumerate(odd_rows)]
    docs = documents(rows)
    out = M.mixed(docs).collect()
    assert len(out) == len(rows) and all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in out)
    assert all(r.taken == 0 for r in out if r.size == 0)
    mix = M.mixture(docs)
    assert mix.columns == docs.columns
    words = mix.select(F.explode(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").count()
    assert words == sum(r.taken for r in out)


def test_given_weights(documents, spark):
    rows = [(i, "w w w w", "ab"[i % 2]) for i in range(200)]
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    out = M.mixed(documents(rows), weights=weights, share=0.5).collect()
    assert abs(sum(r.taken for r in out if r._s == "0a") - 300) <= 4 and abs(sum(r.taken for r in out if r._s == "0b") - 100) <= 4


def test_empty_table(documents):
    assert M.mixed(documents([])).count() == 0 and M.mixture(documents([])).count() == 0
    assert M.mixed(documents([(1, None, None)])).collect()[0].taken == 0
    mixed = M.mixed(documents([(1, "", "empty"), (2, "some words", "full"), (3, None, None)])).collect()
    assert {r.doc_id: r.taken for r in mixed} == {1: 0, 2: 2, 3: 0}
