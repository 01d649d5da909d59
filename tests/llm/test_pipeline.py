import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_host_rules import brute as measures  # noqa: E402
from test_line_join import brute as repeated_lines  # noqa: E402
from test_mixing import brute as mix  # noqa: E402
from test_probminhash import brute as clusters  # noqa: E402


def corpus():
    text = {}
    for i in range(40):
        text[i] = "\n".join(" ".join(f"d{i}l{k}w{j}" for j in range(30)) for k in range(4))
    text[40] = text[3].replace("d3l0w5", "other")  # near copy: its lines are removed as repeats
    text[41] = "too short"
    text[42] = "again and " * 60
    text[43] = None
    text[44] = text[7] + "\n" + " ".join(f"new{j}" for j in range(60))
    return [(i, t, f"s{i % 4}" if i % 11 else None) for i, t in text.items()] + [(5, text[5], "s1"), (None, text[9] + " tail", "s9")]


def test_stages_equal_brute_force(spark, documents):
    rows = corpus()
    docs = documents(rows)
    columns = docs.columns
    names, stages = zip(*corpus_pipeline.STAGES)

    def triples(df):
        assert df.columns == columns
        return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)

    passed = stages[0](spark, docs, "")
    expected = []
    for i, t, s in rows:
        n, _, _, _, _, repeat = measures(t)
        if n >= 50 and 100 * repeat <= 50 * n:
            expected.append((i, t, s))
    assert triples(passed) == sorted(expected, key=str)

    lined = stages[1](spark, passed, "")
    gone = repeated_lines(expected)
    after = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), s) for i, t, s in expected]
    got = triples(lined)
    # rows equal in id and text lose the same lines
    own = {(i, t) for i, t, _ in got if i != 5}
    assert own == {(i, t) for i, t, _ in after if i != 5} and len(got) == len(after)

    single = stages[2](spark, lined, "")
    kept = triples(single)
    groups = [g for g in clusters([(i, t) for i, t, _ in got])]
    assert len(kept) <= len(groups) and {i for i, _, _ in kept if i is not None} >= {g[0][1] for g in groups if not g[0][0]} - {5}

    mixed = triples(stages[3](spark, single, ""))
    size, taken, _ = mix(kept)
    assert mixed == sorted((r for r, n, t in zip(kept, size, taken) for _ in range(t // n if n else 0)), key=str)

    last = stages[4](spark, spark.createDataFrame(mixed, "doc_id long, text string, source string").selectExpr("*", "'en' as lang"), "").collect()
    assert len(last) == len(mixed) and all(r.round_trip for r in last)


def test_a_row_that_occurs_twice_stays(spark, documents):
    rows = corpus()
    docs = documents(rows)
    out = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        out.append([r.text for r in docs.where("doc_id = 5").collect()])
    text = dict(r[:2] for r in rows)[5]
    # both rows keep the first occurrence of their lines; the near dedup leaves one of them
    assert out == [[text, text], [text, text], [text]]


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, sf).collect()
    assert out and all(r.round_trip and r.n_tokens > 0 for r in out)


def test_odd_and_empty_tables(spark, documents, odd_rows):
    for rows in (odd_rows, [], [(1, None)]):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
