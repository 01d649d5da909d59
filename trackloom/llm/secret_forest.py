"""Secret scan with a random forest that removes false positives.

Candidates are words with a digit, values of assignments, and long words of unusual transitions.  Each is described by its length, the
likelihood of its character transitions in ordinary words of the corpus, the share that dictionary words cover, its path (the
source of the document) and the words beside it.  A random forest, fitted on labelled findings, gives the
probability that a candidate is a secret.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import SPACED, U64, chunks, hashes, words_of
from trackloom.session import materialize

MIN_LENGTH = 8
THRESHOLD = 0.5
#: Labelled findings the forest is fitted on, at most, of either label; and its size.
SAMPLE, TREES, DEPTH, SEED = 4000, 20, 8, 11
#: Cells of hashed word counts; words in cells of more than 1/4096 of all words form the dictionary (at most 4,096 cells).
CELLS, HEAVY = 1 << 18, 4096
CLASSES = 40
_EDGE = "\"'`.,;:!?()[]{}<>|$%&*#"
# Names that announce a secret, and formats of findings that are labelled without doubt.
KEYWORDS = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login", re.I)
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|api_key|token)[=:][0-9A-Za-z+/_-]{12,}")
HARMLESS = re.compile(r"[0-9]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{3}-[0-9]{4}|[^@\s]+@[^@\s]+\.[a-z]+")
#: Words of hex digits are harmless only beside a name of what they digest.
DIGEST = re.compile(r"[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}")
DIGESTED = re.compile(r"commit|sha-?[0-9]*|digest|checksum|hash|revision|rev|tree|parent|blob|etag|fingerprint", re.I)
_SIGNS = "=:>"
#: Words are cut here, so that each assignment of a query string, of JSON or of a list is one candidate.
_PIECE = re.compile(r"[^\"'`&,;{}?]+")
#: From this length on a word without a digit is a candidate if its transitions are less likely than letters drawn evenly.
LONG, EVEN = 16, -float(np.log(26))
NUMBERS = [
    "length", "digits", "uppers", "distinct", "entropy", "transitions", "switches", "hex", "coverage", "assigned",
    "keyword", "before", "after", "path",
]


def _class(b: np.ndarray) -> np.ndarray:
    """Character classes: letters without case, digits as one per value, other signs, other bytes."""
    out = np.full(b.shape, 39, np.int64)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    out[(low >= 97) & (low <= 122)] = low[(low >= 97) & (low <= 122)] - 97
    out[(b >= 48) & (b <= 57)] = b[(b >= 48) & (b <= 57)] - 48 + 26
    out[(b < 128) & (out == 39)] = 38
    out[b == 95] = 36
    out[b == 45] = 37
    return out


def _rows(docs: DataFrame, path: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(path).cast("string").alias("_path"), F.col("text").cast("string").alias("_text")
    )


def corpus_counts(docs: DataFrame, path: str = "source") -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of character transitions over all words, and hashed word counts (tables of fixed size)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, cells = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(CELLS, np.int64)
        for batch in chunks(batches, "_text"):
            w = words_of(batch.column("_text"))
            cells += np.bincount((w.hash >> U64(46)).astype(np.int64), minlength=CELLS)
            c = _class(w.data)
            inside = SPACED[w.data]
            pair = np.flatnonzero(inside[:-1] & inside[1:])
            steps += np.bincount(c[pair] * CLASSES + c[pair + 1], minlength=len(steps))
        for kind, table in ((0, steps), (1, cells)):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(table[at])], names=["kind", "at", "n"]
            )

    sums = _rows(docs, path).mapInArrow(count, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    steps, cells = np.ones((CLASSES, CLASSES)), np.zeros(CELLS, np.int64)
    for kind, at, n in sums.collect():
        if kind:
            cells[at] = n
        else:
            steps[at // CLASSES, at % CLASSES] += n
    return np.log(steps / steps.sum(1, keepdims=True)), cells


def candidates(docs: DataFrame, counts: tuple[np.ndarray, np.ndarray] | None = None, path: str = "source") -> DataFrame:
    """``doc_id``, ``path``, ``start``, ``end`` (characters of the text), ``finding``, ``label`` (by format, else null) and the features.

    A candidate is a word cut free of brackets, quotes and stops, of MIN_LENGTH characters or more, with a digit,
    the value of an assignment, or long and of unusual transitions.  Each assignment of a word is one candidate.  Of
    an assignment (``name=value``, ``name: value``, ``name = "value"``) the features describe the value; name and value
    make the label.  Null texts have none.
    """
    spark = docs.sparkSession
    steps, cells = counts or corpus_counts(docs, path)
    shared = spark.sparkContext.broadcast((steps, cells * HEAVY > max(int(cells.sum()), 1)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, heavy = shared.value
        digit, sign = np.zeros(256, bool), np.zeros(256, bool)
        digit[0x30:0x3A] = True
        sign[[0x3A, 0x3D]] = True
        for batch in chunks(batches, "_text"):
            w = words_of(batch.column("_text"))
            number = np.concatenate([[0], np.cumsum(digit[w.data])])
            signs = np.concatenate([[0], np.cumsum(sign[w.data])])
            c = _class(w.data)
            likely = np.concatenate([[0.0], np.cumsum(steps[c[:-1], c[1:]]), [0.0]])
            size = w.end - w.start
            odd = (size >= LONG) & (likely[w.end - 1] - likely[w.start] < EVEN * (size - 1))
            has_sign = signs[w.end] > signs[w.start]
            follows = np.zeros(len(size), bool)  # '=' and '>' stand alone or end the word before
            follows[1:] = has_sign[:-1]
            follows[2:] |= has_sign[:-2]
            picked = np.flatnonzero(((number[w.end] > number[w.start]) | odd | has_sign | follows) & (size >= MIN_LENGTH))
            passed = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # characters before each byte
            first = np.searchsorted(w.row, np.arange(w.n_rows + 1))
            ids, paths = batch.column("doc_id"), batch.column("_path")
            out: list[tuple] = []
            for i in picked.tolist():
                row = int(w.row[i])
                around = [w.text(j).decode("utf-8", "replace") if first[row] <= j < first[row + 1] else "" for j in range(i - 2, i + 3)]
                raw, offset = around[2], int(passed[w.start[i]] - passed[w.offsets[row]])
                own = list(_PIECE.finditer(raw))
                left, right = [[m[0] for x in part for m in _PIECE.finditer(x)] for part in (around[:2], around[3:])]
                line = ["", "", *left, *[m[0] for m in own], *right, "", ""]
                for k, m in enumerate(own, 2 + len(left)):
                    free = m[0].strip(_EDGE)
                    if len(free) < MIN_LENGTH:
                        continue
                    name, value, before, after = _context(m[0], free, [line[k - 2], line[k - 1], line[k + 1], line[k + 2]])
                    if not any(x in "0123456789" for x in free) and not _worth(name, value, steps):
                        continue
                    label = _label(free, name, value, before)
                    start = offset + m.start() + m[0].index(free)
                    out.append((ids[row].as_py(), paths[row].as_py(), start, start + len(free), free, label, *_features(name, value, before, after, steps, heavy)))
            names = ["doc_id", "path", "start", "end", "finding", "label", *NUMBERS[:-1]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * (len(NUMBERS) - 1)]
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    numbers = ", ".join(f"`{n}` double" for n in NUMBERS[:-1])
    return _rows(docs, path).mapInArrow(find, f"doc_id long, path string, start long, end long, finding string, label int, {numbers}")


def _context(raw: str, free: str, near: list[str]) -> tuple[str | None, str, str, str]:
    """Name (None if nothing is assigned), value and the words beside them, signs of assignment passed over.

    ``near`` are the two words before and the two after.  Name, sign and value are one word or up to three.
    """
    two, one, after, later = near
    sign = lambda x: bool(x) and not x.strip(_SIGNS)
    after = later if sign(after) else after
    body = free.rstrip("=")  # base64 ends with '='
    name, glued, value = body.rpartition("=")
    if not glued:
        name, glued, value = body.rpartition(":")
    value += free[len(body) :]
    if name and value:
        return name.strip(_EDGE), value.strip(_EDGE), two if sign(one) else one, after
    value = (value or free).strip(_EDGE)
    left = raw[: raw.index(free)] + (free[: free.index(value)] if value else "")
    if sign(one):
        return two.strip(_EDGE + _SIGNS), value, two, after
    if one.strip("\"'`").endswith(("=", ":")) or any(x in left for x in "=:"):
        return one.strip(_EDGE + _SIGNS), value, one, after
    return None, value, one, after


def _worth(name: str | None, value: str, steps: np.ndarray) -> bool:
    """Whether a word without a digit is a candidate: the value of an assignment, or long and of unusual transitions."""
    if name is not None and len(value) >= MIN_LENGTH:
        return True
    c = _class(np.frombuffer(value.encode(), np.uint8))
    return len(c) >= LONG and float(np.mean(c < 36)) >= 0.5 and float(steps[c[:-1], c[1:]].mean()) < EVEN


def _label(free: str, name: str | None, value: str, before: str) -> int | None:
    """1 or 0 where format and context leave no doubt.  A harmless format under a name that announces a secret has no label."""
    if HARMLESS.fullmatch(value):
        return None if KEYWORDS.search(name or "") else 0
    if value.isalpha() and (value[1:].islower() or value.isupper()):  # may be prose: "the secret: understanding"
        return None
    if SECRET.fullmatch(free) or SECRET.fullmatch(value) or name is not None and SECRET.fullmatch(f"{name}={value}"):
        return 1
    if DIGEST.fullmatch(value) and DIGESTED.fullmatch((before if name is None else name).strip(_EDGE + _SIGNS)):
        return 0
    return None


def _features(name: str | None, value: str, before: str, after: str, steps: np.ndarray, heavy: np.ndarray) -> tuple[float, ...]:
    b = np.frombuffer(value.encode(), np.uint8)
    c = _class(b)
    n = len(b)
    share = np.bincount(b, minlength=256)[np.unique(b)] / n
    kind = np.where(c < 26, np.where((b >= 65) & (b <= 90), 1, 0), np.where(c < 36, 2, 3))
    low = np.frombuffer(value.lower().encode(), np.uint8)
    edges = np.zeros(len(low) + 1, np.int64)
    for size in range(3, min(12, len(low)) + 1):
        at = np.arange(len(low) - size + 1)
        at = at[heavy[(hashes(low, at, np.full(len(at), size)) >> U64(46)).astype(np.int64)]]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return (
        float(n), float(np.mean(kind == 2)), float(np.mean(kind == 1)), len(share) / n, float(-(share * np.log2(share)).sum()),
        float(steps[c[:-1], c[1:]].mean()) if n > 1 else 0.0, float(np.mean(kind[1:] != kind[:-1])) if n > 1 else 0.0,
        float(all(x in "0123456789abcdefABCDEF" for x in value)), float(covered.mean()) if len(low) else 0.0, float(name is not None),
        float(bool(KEYWORDS.search(name or ""))), float(bool(KEYWORDS.search(before))), float(bool(KEYWORDS.search(after))),
    )


def fitted(findings: DataFrame, sample: int = SAMPLE) -> tuple[RandomForestClassificationModel | None, DataFrame]:
    """A forest from labelled findings (at most ``sample`` of either label, those of smallest hash), and the rate of each path.

    Without findings of both labels there is no forest.
    """
    order = [F.xxhash64("finding", "doc_id", "start"), F.col("doc_id"), F.col("start")]
    parts = [findings.where(F.col("label") == y).orderBy(*order).limit(sample) for y in (1, 0)]
    known = materialize(parts[0].unionByName(parts[1]))
    rates = materialize(
        known.groupBy("path").agg(((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("_rate"))
    )
    if known.select("label").distinct().count() < 2:
        return None, rates
    forest = RandomForestClassifier(featuresCol="_f", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_assembled(known, rates)), rates


def _assembled(findings: DataFrame, rates: DataFrame) -> DataFrame:
    """Paths of labelled findings are as many as the bounded sample at most, hence the broadcast."""
    rates = rates.select(F.coalesce("path", F.lit("")).alias("_p"), F.col("path").isNull().alias("_n"), "_rate")
    on = (F.coalesce("path", F.lit("")) == F.col("_p")) & (F.col("path").isNull() == F.col("_n"))
    joined = findings.join(F.broadcast(rates), on, "left").withColumn("_path_rate", F.coalesce("_rate", F.lit(0.5)))
    assembler = VectorAssembler(inputCols=[*NUMBERS[:-1], "_path_rate"], outputCol="_f")
    return assembler.transform(joined)


def secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """Every candidate with its probability: ``doc_id``, ``path``, ``start``, ``end``, ``finding``, ``label``, ``score`` and ``secret``.

    ``findings`` (doc_id, start, label) are the labelled ones; without them those that a format tells apart are
    the labels.  ``start`` and ``end`` count characters.  Without both labels the score is 0.5 and nothing is a secret.  Repeated rows
    are found as often as they occur; null ids and paths are kept.  An empty table gives an empty result.
    """
    found = materialize(candidates(docs, None, path))
    if findings is not None:
        given = findings.select(F.col("doc_id").cast("long").alias("_i"), F.col("start").cast("long").alias("_s"), F.col("label").cast("int").alias("_y"))
        given = given.groupBy("_i", "_s").agg(F.max("_y").alias("_y"))
        found = found.drop("label").join(given, (F.col("doc_id").eqNullSafe(F.col("_i"))) & (F.col("start") == F.col("_s")), "left")
        found = found.withColumnRenamed("_y", "label").drop("_i", "_s")
    forest, rates = fitted(found)
    if forest is None:
        scored = found.withColumns({"score": F.lit(0.5), "secret": F.lit(False)})
    else:
        scored = forest.transform(_assembled(found, rates))
        scored = scored.withColumn("score", vector_to_array("probability")[1]).withColumn("secret", F.col("score") >= threshold)
    return scored.select("doc_id", "path", "start", "end", "finding", "label", F.round("score", 6).alias("score"), "secret")


def report(docs: DataFrame, threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_candidates``, ``n_secrets``, ``max_score`` and ``spans`` (start, end, score) of the secrets.

    Rows of one id share their counts (each finding counts as often as its row occurs).
    """
    spans = F.sort_array(F.collect_list(F.when(F.col("secret"), F.struct("start", "end", "score"))))
    found = secrets(docs, None, threshold, path).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum(F.col("secret").cast("long")).alias("n_secrets"), F.max("score").alias("max_score"), spans.alias("spans")
    )
    found = found.withColumnRenamed("doc_id", "_i")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    return own.join(found, _same("doc_id", "_i"), "left").select(
        "doc_id", zero("n_candidates", "long"), zero("n_secrets", "long"), zero("max_score", "double"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint, score: double>>")).alias("spans"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
