import re

import numpy as np
import pyarrow as pa

from trackloom.llm import words as W

TEXTS = ["a bb  ccc\n dddd eight888 nine99999 \t", None, "", "\n", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", "é ü\nline two\n\nfour", " lead", "trail ", "abcdefgh abcdefghi abcdefgh\x00"]


def test_words_rows_lines_and_hashes():
    for cut in (0, 2):
        column = pa.array(["zz"] * cut + TEXTS).slice(cut)
        w = W.words_of(column, lines=True)
        expected = []
        for r, t in enumerate(TEXTS):
            for k, line in enumerate((t or "").split("\n")):
                expected += [(r, k, x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        assert [(int(r), int(k), w.text(i)) for i, (r, k) in enumerate(zip(w.row, w.line))] == expected
        by = {}
        for (_, _, x), h in zip(expected, w.hash.tolist()):
            assert by.setdefault(x, h) == h
        assert len(set(by.values())) == len(by)


def test_equal_words_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 40, 3000)]
    one = W.words_of(pa.array([" ".join(vocabulary)]))
    two = W.words_of(pa.array(["  \n ".join(vocabulary[::-1])]))
    assert one.hash.tolist() == two.hash.tolist()[::-1]
    assert len(set(one.hash.tolist())) == len(set(vocabulary))


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)))], names=["text", "i"])
    for limit in (1, 10, 10**6):
        parts = list(W.chunks(iter([batch, batch.slice(0, 0)]), limit=limit))
        assert sum((p.column("i").to_pylist() for p in parts), []) == list(range(len(TEXTS)))
