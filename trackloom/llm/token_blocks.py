"""Token ids on disk: files of patched frame-of-reference blocks, written in document order and read back.

A file is the magic bytes, the blocks, and a footer: start of every block, documents (id, null mark, number of ids), numbers of the three, checksum, magic.
A block holds ``BLOCK`` ids (the last one of a file fewer): minimum (u32), bit width (u8), number of exceptions (u16), the low bits of every id less the
minimum, places of the exceptions (u8 each), and their high bits (u32 each).  The width is that of the ``PERCENTILE`` of the block, so a few large
ids don't widen the rest.  Block starts make any range of ids readable without the blocks before it.

Equal words of a task are encoded once.  A run of ASCII letters, one digit, or a run of other printable ASCII characters is a unit of its own for the
tokenizer; a word that holds anything else (also an apostrophe or a ``<``, which may begin a contraction or a special token) goes to it whole.
Neither its normalisation nor its pre-tokens reach over white space.  64-bit hashes stand for words within a task.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, running_sums, shuffle_partitions
from trackloom.llm.words import LOWER, bytes_of, chunks, hashes
from trackloom.session import materialize, shared_dir

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2
MAGIC = b"PFORTOK1"
BLOCK = 256
#: Share of a block's ids that its width must hold, in hundredths.
PERCENTILE = 90
#: Ids after which a file is closed at the end of a document.
FILE_IDS = 1 << 20
#: Different words that a task remembers.
KNOWN_WORDS = 1 << 20
HEAD = 7
TRAILER = np.dtype([("ids", "<u8"), ("blocks", "<u8"), ("docs", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("magic", "S8")])


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bit length of non-negative integers."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64) * (values > 0)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned integers as rows of bytes, ``width`` bits each, low bits first."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(*values.shape, 4), axis=-1, bitorder="little")
    return np.packbits(bits[..., :width].reshape(len(values), -1), axis=-1, bitorder="little")


def unpacked(rows: np.ndarray, count: int, width: int) -> np.ndarray:
    """The inverse of ``packed`` for rows of ``count`` integers."""
    bits = np.unpackbits(rows, axis=-1, bitorder="little")[:, : count * width].reshape(len(rows), count, width)
    full = np.zeros((len(rows), count, 32), np.uint8)
    full[..., :width] = bits
    return np.packbits(full, axis=-1, bitorder="little").view("<u4")[..., 0]


def packed_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all blocks of ``ids`` and the start of every block in them."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    count = np.full(n_blocks, BLOCK)
    if n_blocks:
        count[-1] = n - BLOCK * (n_blocks - 1)
    grid = np.full(n_blocks * BLOCK, -1, np.int64)
    grid[:n] = ids
    grid = grid.reshape(n_blocks, BLOCK)
    there = grid >= 0
    low = np.where(there, grid, np.iinfo(np.int64).max).min(axis=1) if n_blocks else np.zeros(0, np.int64)
    delta = np.where(there, grid - low[:, None], 0)
    place = BLOCK - count + (PERCENTILE * count + 99) // 100 - 1  # the filler zeros sort first
    width = bits_of(np.sort(delta, axis=1)[np.arange(n_blocks), place])
    high = delta >> width[:, None]
    odd_block, odd_place = np.nonzero(high)
    odd = np.bincount(odd_block, minlength=n_blocks)
    body = (count * width + 7) // 8
    size = HEAD + body + 5 * odd
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros(n_blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2")]))
    head["low"], head["width"], head["odd"] = low, width, odd
    out[start[:-1, None] + np.arange(HEAD)] = head.view(np.uint8).reshape(n_blocks, HEAD)
    for w in np.unique(width[width > 0]):
        for full in (True, False):
            which = np.flatnonzero((width == w) & ((count == BLOCK) == full))
            if len(which):
                own = delta[which, : count[which[0]]] & ((1 << int(w)) - 1)
                data = packed(own, int(w))
                out[start[which, None] + HEAD + np.arange(data.shape[1])] = data
    nth = np.arange(len(odd_block)) - (np.cumsum(odd) - odd)[odd_block]
    at = (start[:-1] + HEAD + body)[odd_block]
    out[at + nth] = odd_place
    value = high[odd_block, odd_place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(at + odd[odd_block] + 4 * nth)[:, None] + np.arange(4)] = value
    return out, start[:-1]


def file_of(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A whole file."""
    data, start = packed_blocks(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    body = b"".join(
        [MAGIC, data.tobytes(), start.astype("<u8").tobytes(), keys.tobytes(), nulls.tobytes(), np.array(lengths, "<u8").tobytes()]
    )
    trailer = np.array([(len(ids), len(start), len(keys), BLOCK, zlib.crc32(body), MAGIC)], TRAILER)
    return body + trailer.tobytes()


@dataclass
class TokenFile:
    """An opened file: documents and any range of ids."""

    data: np.ndarray
    starts: np.ndarray
    doc_ids: list[int | None]
    lengths: np.ndarray
    n_ids: int
    size: int

    @classmethod
    def open(cls, content: bytes) -> TokenFile:
        raw = np.frombuffer(content, np.uint8)
        if len(raw) < len(MAGIC) + TRAILER.itemsize:
            raise ValueError("not a token file: too short")
        end = len(raw) - TRAILER.itemsize
        t = raw[end:].view(TRAILER)[0]
        if raw[: len(MAGIC)].tobytes() != MAGIC or t["magic"] != MAGIC:
            raise ValueError("not a token file: no magic bytes")
        if zlib.crc32(raw[:end]) != int(t["crc"]):
            raise ValueError("damaged token file: checksum")
        blocks, docs = int(t["blocks"]), int(t["docs"])
        a = end - 17 * docs - 8 * blocks
        starts = raw[a : a + 8 * blocks].tobytes()
        keys = raw[a + 8 * blocks : a + 8 * (blocks + docs)].tobytes()
        nulls = raw[a + 8 * (blocks + docs) : a + 8 * (blocks + docs) + docs]
        lengths = np.frombuffer(raw[end - 8 * docs : end].tobytes(), "<u8").astype(np.int64)
        ids = [None if n else k for k, n in zip(np.frombuffer(keys, "<i8").tolist(), nulls.tolist())]
        return cls(raw[len(MAGIC) : a], np.frombuffer(starts, "<u8").astype(np.int64), ids, lengths, int(t["ids"]), int(t["size"]))

    def ids(self, begin: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``stop``; only the blocks that hold them are read."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // self.size, (stop - 1) // self.size
        start = self.starts[first : last + 1]
        n = len(start)
        head = self.data[start[:, None] + np.arange(HEAD)].view(np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2")]))[:, 0]
        width, odd = head["width"].astype(np.int64), head["odd"].astype(np.int64)
        count = np.minimum(self.size, self.n_ids - self.size * np.arange(first, last + 1))
        grid = np.zeros((n, self.size), np.uint32)
        for w in np.unique(width[width > 0]):
            for full in (True, False):
                which = np.flatnonzero((width == w) & ((count == self.size) == full))
                if len(which):
                    c = int(count[which[0]])
                    rows = self.data[start[which, None] + HEAD + np.arange((c * int(w) + 7) // 8)]
                    grid[which, :c] = unpacked(rows, c, int(w))
        block = np.repeat(np.arange(n), odd)
        nth = np.arange(len(block)) - (np.cumsum(odd) - odd)[block]
        at = (start + HEAD + (count * width + 7) // 8)[block]
        value = self.data[(at + odd[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        grid[block, self.data[at + nth]] |= value << width[block].astype(np.uint32)
        grid += head["low"][:, None]
        return grid.reshape(-1)[begin - first * self.size :][: stop - begin]


_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x27, 0x3C]] = _ODD


class Encoder:
    """Ids of text columns; remembers the ids of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # sorted
        self.begin = self.count = np.zeros(0, np.int64)
        self.flat: list[np.ndarray] = []
        self.total = 0

    def learn(self, hash_: np.ndarray, words: list[bytes], whole: np.ndarray) -> None:
        model, lists = self.tokenizer.model, []
        rest = [w.decode() for w, odd in zip(words, whole.tolist()) if odd]
        encoded = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False))
        for w, odd in zip(words, whole.tolist()):
            lists.append(next(encoded).ids if odd else [t.id for t in model.tokenize(w.decode())])
        count = np.array([len(x) for x in lists], np.int64)
        begin = self.total + np.cumsum(count) - count
        self.flat.append(np.array([i for x in lists for i in x], np.uint32))
        self.total += int(count.sum())
        at = np.searchsorted(self.hash, hash_)
        self.hash = np.insert(self.hash, at, hash_)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the offsets of rows in them."""
        raw, offsets = bytes_of(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _CLASS[raw]
        inside = kind != _SPACE
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
        begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        whole = odd[end] > odd[begin]
        flag = np.zeros(len(raw) + 1, np.int8)
        flag[begin[whole]] += 1
        flag[end[whole]] -= 1
        in_whole = np.cumsum(flag[:-1]).astype(bool)
        kind[in_whole] = _ODD
        data = np.where(in_whole, raw, LOWER[raw])
        change = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)])
        start = np.flatnonzero(inside & (~before | change))
        stop = np.minimum(np.append(start[1:], len(raw)), end[np.searchsorted(begin, start, "right") - 1])
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        word = hashes(data, start, stop - start)
        unique, lead, same = np.unique(word, return_index=True, return_inverse=True)
        if len(self.hash) + len(unique) > KNOWN_WORDS:
            self.forget()
        at = np.searchsorted(self.hash, unique)
        new = np.ones(len(unique), bool)
        if len(self.hash):
            new = self.hash[np.minimum(at, len(self.hash) - 1)] != unique
        if new.any():
            own = lead[new]
            words = [data[a:b].tobytes() for a, b in zip(start[own].tolist(), stop[own].tolist())]
            self.learn(unique[new], words, kind[start[own]] == _ODD)
            at = np.searchsorted(self.hash, unique)
        flat = self.flat[0] if len(self.flat) == 1 else np.concatenate(self.flat)
        self.flat = [flat]
        n = self.count[at][same]
        first = self.begin[at][same]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first - total[:-1], n) + np.arange(int(total[-1]))]
        return ids, total[np.searchsorted(start, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with END_ID after it."""
    return np.insert(ids, offsets[1:], END_ID), offsets + np.arange(len(offsets))


MANIFEST = "file string, part int, nth int, n_docs long, n_ids long"


def written(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of ``docs`` to files of ``folder``, in ascending doc_id order (null first), and return the manifest.

    Documents of one id are ordered by the hash of their text and the text.  A file appears under its name only when complete, and only
    files of the manifest count: what a lost or repeated task leaves behind is never read.  The manifest is a written
    table (file, part, nth, n_docs, n_ids); files follow each other by part and nth.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_th")]
    placed = (
        rows.withColumn("_tie", F.monotonically_increasing_id())  # lets a range end between equal rows
        .repartitionByRange(shuffle_partitions(spark), *keys, "_tie")
        .withColumn("_part", F.spark_partition_id())
        .sortWithinPartitions(*keys, "_text")
        .select("doc_id", "_text", "_part")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part, nth, held = 0, 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal nth, held
            name = f"tokens-{part:06d}-{nth:06d}-{uuid.uuid4().hex}.pfor"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}.unfinished") as out:
                out.write(file_of(np.concatenate(ids), doc_ids, lengths))
            fs.move(f"{root}/{name}.unfinished", f"{root}/{name}")
            row = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(doc_ids)]), pa.array([held])],
                names=["file", "part", "nth", "n_docs", "n_ids"],
            )
            nth, held = nth + 1, 0
            ids.clear(), doc_ids.clear(), lengths.clear()
            return row

        for batch in chunks(batches, "_text"):
            got, offsets = with_end(*encode.encode(batch.column("_text")))
            keys_, part = batch.column("doc_id").to_pylist(), batch.column("_part")[0].as_py()
            a = 0
            while a < len(keys_):  # rows up to the one that fills the file
                b = int(np.searchsorted(offsets, offsets[a] + file_ids - held))
                b = min(max(b, a + 1), len(keys_))
                ids.append(got[offsets[a] : offsets[b]])
                doc_ids += keys_[a:b]
                lengths += np.diff(offsets[a : b + 1]).tolist()
                held += int(offsets[b] - offsets[a])
                if held >= file_ids:
                    yield close()
                a = b
        if doc_ids:
            yield close()

    return materialize(placed.mapInArrow(work, MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files of a manifest."""
    spark = manifest.sparkSession
    starts = running_sums(manifest, ["part", "nth"], "n_ids", out="_until").select(
        F.col("file").alias("_name"), (F.col("_until") - F.col("n_ids")).cast("long").alias("_start")
    )
    starts = materialize(starts)
    n = starts.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("_file"), batch.column("content")):
                opened = TokenFile.open(content.as_buffer())
                ids = opened.ids().astype("<u4")
                at = np.concatenate([[0], np.cumsum(opened.lengths)])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(opened.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(opened.lengths), pa.array(crc, pa.int64()), pa.array([name.as_py()] * len(crc))],
                    names=["doc_id", "within", "n_tokens", "ids_crc32", "_file"],
                )

    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("_file"), "content").mapInArrow(
        work, "doc_id long, within long, n_tokens long, ids_crc32 long, _file string"
    )
    if n <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    out = rows.join(starts, F.col("_file") == F.col("_name"))
    return out.select("doc_id", (F.col("_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents as they stand in freshly written files of the shared folder.

    A null text is an empty one and has the end id only; null ids come first; repeated rows stand beside each other.  A very long text is one document
    of one file and needs memory for its own ids.  An empty table writes nothing and gives an empty result; other columns are not read.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(written(docs, folder, tokenizer), folder)
