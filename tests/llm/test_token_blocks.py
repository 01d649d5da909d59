import os
import random
import uuid
import zlib

import numpy as np
import pytest

from trackloom.llm import token_blocks as B
from trackloom.session import shared_dir

pytestmark = pytest.mark.skipif(not os.path.exists(B.TOKENIZER), reason="no tokenizer file")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.TOKENIZER)


def expected(tokenizer, rows):
    """Straight through the library: one list of all ids, then every document's place and checksum."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 4096])
@pytest.mark.parametrize("high", [1, 2, 700, 49_408, 2**32])
def test_blocks_round_trip(n, high):
    r = random.Random(n * high)
    ids = np.array([r.randrange(high) if r.random() < 0.9 else high - 1 for _ in range(n)], np.int64)
    half = n // 3
    opened = B.TokenFile.open(B.file_of(ids, [5, None], [half, n - half]))
    assert opened.ids().tolist() == ids.tolist()
    assert opened.doc_ids == [5, None] and opened.lengths.tolist() == [half, n - half]
    for _ in range(20):
        a, b = sorted((r.randint(0, n), r.randint(0, n)))
        assert opened.ids(a, b).tolist() == ids[a:b].tolist()


def test_outliers_are_patched_not_widened():
    ids = np.array([100 + k % 8 for k in range(B.BLOCK)], np.int64)
    ids[[7, 200]] = 49_000
    data, _ = B.packed_blocks(ids)
    assert len(data) == B.HEAD + B.BLOCK * 3 // 8 + 2 * 5


def test_damage_is_noticed():
    content = bytearray(B.file_of(np.arange(1000), [1], [1000]))
    content[300] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        B.TokenFile.open(bytes(content))
    with pytest.raises(ValueError):
        B.TokenFile.open(b"short")


ODD = [
    "it's WE'LL ''s 's x's <|endoftext|> a<|startoftext|>b <|EndOfText|> <b>", "tab\tand\x0bfeed\x0c\r\n\x85next\xa0nbsp sep　wide",
    "ÀÉÎ Straße ΣΑΣ ΟΔΟΣ. İstanbul KK", "é ́x ́", "日本語 \U0001f600\U0001f601 ½ ² Ⅷ ٣", "a1b22c333 4,5.6 !!??..-- a-b_c #$%^&*()", "\x00\x01 \x1c\x1f\x7f z", "﻿bom ﬁ ａｂ",
    "WORD word Word wOrD,word;word", "=" * 700 + "q" * 900, "",
]


def test_words_equal_whole_texts(tokenizer):
    import pyarrow as pa

    r = random.Random(2)
    alphabet = "abcABC019'<|>.,!-_ \t\n\xa0\x85éÉßı́̀Σσς日\U0001f600²½‍"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    ids, at = B.Encoder(B.TOKENIZER).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "KNOWN_WORDS", 8)
    enc = B.Encoder(B.TOKENIZER)
    for t in ODD * 2:
        assert enc.encode(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_odd_rows(spark, documents, odd_rows, tokenizer):
    from pyspark.sql import functions as F

    docs = documents(odd_rows + [(20 + k, t) for k, t in enumerate(ODD)])
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("t"))
    want = expected(tokenizer, [(r.doc_id, r.t) for r in ordered.collect()])
    assert found(B.round_trip(docs)) == want


def test_many_files_and_leftovers(spark, documents, tokenizer):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["alpha", "Beta.", "x9", "é"]) for _ in range(r.randint(0, 30)))) for k in range(300)]
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = B.written(documents(rows[::-1]), folder, file_ids=100)
    assert manifest.count() > 20
    path = folder.removeprefix("file://")
    with open(f"{path}/tokens-000000-000000-stray.pfor", "wb") as f:  # of a task that ran twice
        f.write(B.file_of(np.arange(9), [1], [9]))
    with open(f"{path}/tokens-000000-000001-cut.pfor.unfinished", "wb") as f:
        f.write(b"half")
    assert found(B.read(manifest, folder)) == expected(tokenizer, rows)


def test_empty_table(documents):
    assert B.round_trip(documents([])).count() == 0


def test_registered_query(spark, sf, tokenizer):
    from trackloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert found(QUERIES["op12_token_blocks"](spark, sf)) == expected(tokenizer, [tuple(r) for r in rows])
