import re

import pytest

from compare import compare, duck
from trackloom.llm import host_rules as H
from trackloom.llm.queries import ORACLES, QUERIES


def brute(text):
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures_of_odd_rows(documents, odd_rows):
    rows = odd_rows + [(20, "a b c a b c a b"), (21, "x x x x"), (22, "#*$ %&|<> é\nq\nq\n q\n"), (23, "\v\f\rw\tw")]
    out = H.judged(documents(rows)).collect()
    assert sorted((r.doc_id or -1, *(r[m] for m in H.MEASURES)) for r in out) == sorted((i or -1, *brute(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert not any(r.kept and r.base_failed for r in out)


def test_bad_hosts_lose_what_fails_and_keep_what_does_not(documents):
    def text(i, bad):
        words = [f"word{i}x{k}" for k in range(80)]
        return " ".join(w + " ##" if bad and k % 3 == 0 else w for k, w in enumerate(words))

    rows = [(i, text(i, i % 10 != 0), "junk") for i in range(60)]
    rows += [(100 + i, text(100 + i, i % 10 == 0), f"good{i % 4}") for i in range(200)]
    rows += [(400, text(400, True), None), (401, text(401, False), "junk"), (401, text(401, False), "junk")]
    out = H.judged(documents(rows)).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] == (i % 10 == 0) for i in range(60)) and all(kept[100 + i] for i in range(200))
    assert kept[400] and kept[401]  # one document of an unknown host proves nothing
    docs = documents(rows)
    left = H.passing(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, _ in rows if kept[i])


def test_a_host_well_above_the_others_is_condemned_below_one_half(documents):
    def text(i, bad):
        return " ".join(f"word{i}x{k}" + (" ##" if bad and k % 3 == 0 else "") for k in range(80))

    # nine ordinary hosts fail 2 documents in 100, one fails 30: far from one half, far above what is usual
    rows = [(100 * h + i, text(100 * h + i, i < (30 if h == 9 else 2)), f"h{h}") for h in range(10) for i in range(100)]
    rows += [(2000 + i, text(2000 + i, i == 0), "small") for i in range(3)]  # one of three proves little
    kept = {r.doc_id: r.kept for r in H.judged(documents(rows)).collect()}
    gone = {i for i, k in kept.items() if not k}
    assert gone == {900 + i for i in range(30)}
    assert {r.doc_id for r in H.passing(documents(rows)).collect()} == set(kept) - gone


def test_empty_table(documents):
    assert H.judged(documents([])).count() == 0 and H.passing(documents([])).count() == 0


@pytest.mark.parametrize("name", ["op1_host_quality_rules", "op2_source_mixing", "op3_embedding_near_dedup"])
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name]) is None
