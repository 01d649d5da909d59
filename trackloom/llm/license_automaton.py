"""Licence scan: matching statistics from a generalised suffix automaton of licence words, chained into template spans.

The automaton holds all runs of words of all templates.  Streaming a text through it gives, at every word, the
longest run that ends there and occurs in a template.  Long runs that cannot be extended are chained by dynamic
programming, in order of text and of template, into spans; a template whose words a chain covers to a large share gives its label.
Phrases are templates too; where one is a suffix of the current run, it stands in the text.
"""

from __future__ import annotations

from bisect import bisect
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.license_texts import PHRASES, TEMPLATES
from trackloom.llm.words import ALNUM, LOWER, chunks, words_of

#: Words of a run that counts as long, words between runs of one chain, and share of a template that gives its label.
MIN_RUN = 4
GAP = 20
COVERAGE = 0.75
#: Score of a text that only names a licence.
NAMED = 0.5


def words(text: str) -> list[int]:
    """Hashes of the lower-cased words of a template."""
    return words_of(pa.array([text]), ALNUM, LOWER).hash.tolist()


class SuffixAutomaton:
    """Of several word sequences.  ``step[state, word]`` and ``kept[state, word]``: next state, and how much of the run survives."""

    def __init__(self, templates: Sequence[Sequence[int]], phrases: Sequence[Sequence[int]]) -> None:
        sequences = [list(s) for s in [*templates, *phrases]]
        self.vocabulary = np.array(sorted({w for s in sequences for w in s}), np.uint64)
        number = {w: i for i, w in enumerate(self.vocabulary.tolist())}
        edges: list[dict[int, int]] = [{}]
        link, size, ends = [-1], [0], [[]]

        def state(length: int) -> int:
            edges.append({})
            link.append(0)
            size.append(length)
            ends.append([])
            return len(edges) - 1

        def split(p: int, c: int, q: int) -> int:
            """The class of the longest run of ``q`` that ends like ``p`` with ``c``."""
            clone = state(size[p] + 1)
            edges[clone] = dict(edges[q])
            link[clone], link[q] = link[q], clone
            while p >= 0 and edges[p].get(c) == q:
                edges[p][c] = clone
                p = link[p]
            return clone

        for t, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                c, p = number[word], last
                if c in edges[p]:
                    q = edges[p][c]
                    last = q if size[q] == size[p] + 1 else split(p, c, q)
                else:
                    last = state(size[p] + 1)
                    while p >= 0 and c not in edges[p]:
                        edges[p][c] = last
                        p = link[p]
                    if p >= 0:
                        q = edges[p][c]
                        link[last] = q if size[q] == size[p] + 1 else split(p, c, q)
                ends[last].append((t, place))
        n, v = len(edges), len(number)
        order = np.argsort(size, kind="stable")
        self.step, self.kept = np.zeros((n, v), np.int32), np.zeros((n, v), np.int32)
        self.here = np.zeros((n, len(phrases)), bool)
        for s in order:
            if link[s] >= 0:
                self.step[s], self.kept[s] = self.step[link[s]], self.kept[link[s]]
            for c, to in edges[s].items():
                self.step[s, c], self.kept[s, c] = to, size[s] + 1
        # a run ends where it ends in a template, and wherever a longer run that it is a suffix of ends
        for s in order[::-1]:
            if link[s] > 0:
                ends[link[s]].extend(ends[s])
        for k in range(len(phrases)):
            for s in range(n):
                if (len(templates) + k, len(phrases[k]) - 1) in ends[s] and size[s] >= len(phrases[k]):
                    self.here[s, k] = True
        for s in order:
            if link[s] > 0:
                self.here[s] |= self.here[link[s]]
        self.ends = [[(t, p) for t, p in e if t < len(templates)] for e in ends]

    def statistics(self, word: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest run ending at each word of the given runs of vocabulary words."""
        state, run = np.zeros(len(word), np.int32), np.zeros(len(word), np.int32)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        s, size = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, "left"))
            at = begin[:n] + k
            c = word[at]
            size[:n] = np.minimum(size[:n] + 1, self.kept[s[:n], c])
            s[:n] = self.step[s[:n], c]
            state[at], run[at] = s[:n], size[:n]
        return state, run


def chains(matches: list[tuple[int, int, int]], ends, gap: int) -> list[tuple[int, int, int, int]]:
    """Chains (template, first word, last word, covered words) of runs (end, length, state), in order of the text.

    Per template and place the best chain that ends there is found by dynamic programming: a run follows any earlier one
    that ends before it in the text, at most ``gap`` words before its begin, and before it in the template; what overlaps
    counts once.  Runs between two of a chain, such as a quotation of another place, are passed over.  Of chains that share
    text the best covered stays.  Runs begin in order of the text, so only those within the gap are held.
    """
    held: dict[int, deque] = {}  # template -> runs (end, place, covered, root) within the gap
    best: dict[tuple[int, int], tuple[int, int]] = {}  # template, begin of a chain -> covered, -end
    for end, length, state in matches:
        begin = end - length + 1
        for t, place in ends[state]:
            earlier = held.setdefault(t, deque())
            while earlier and begin - earlier[0][0] > gap + 1:
                earlier.popleft()
            covered, root = length, begin
            for at, before, so_far, of in earlier:
                if at < end and before < place:
                    more = so_far + min(length, end - at, place - before)
                    if more > covered:
                        covered, root = more, of
            earlier.append((end, place, covered, root))
            best[t, root] = max(best.get((t, root), (0, 0)), (covered, -end))
    out = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for (t, root), (covered, end) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
        spans = taken.setdefault(t, [])
        k = bisect(spans, (root, -end))
        if (k == 0 or spans[k - 1][1] < root) and (k == len(spans) or spans[k][0] > -end):
            spans.insert(k, (root, -end))
            out.append((t, root, -end, covered))
    return sorted(out, key=lambda x: (x[2], x[0]))


def scanned(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Sequence[tuple[str, str]] = tuple(PHRASES),
    coverage: float = COVERAGE,
    min_run: int = MIN_RUN,
    gap: int = GAP,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word``, ``last_word`` (their
    smallest and largest start), ``base_labels``, ``labels``, ``score`` and ``spans`` (label, first and last word, covered share).

    Words are lower-cased runs of letters, digits and non-ASCII characters.  A null text is empty: counts 0, no labels,
    score 0, null first and last words.  ``score`` is the largest covered share of a template, at least 0.5 where a
    phrase stands.  Equal rows are scanned alike; an empty table gives an empty result.
    """
    sequences = [words(t) for _, t in templates]
    base = [words(p) for _, p in phrases]
    names, base_names = [n for n, _ in templates], [n for n, _ in phrases]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = SuffixAutomaton(sequences, base)
        size = np.array([len(p) for p in base])
        for batch in chunks(batches, "_text"):
            w = words_of(batch.column("_text"), ALNUM, LOWER)
            n = batch.num_rows
            count = np.bincount(w.row, minlength=n)
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            at = np.minimum(np.searchsorted(auto.vocabulary, w.hash), len(auto.vocabulary) - 1)
            known = np.flatnonzero(auto.vocabulary[at] == w.hash)
            word, row, place = at[known], w.row[known], known - start[w.row[known]]
            new = np.ones(len(known), bool)
            new[1:] = (np.diff(known) > 1) | (np.diff(row) > 0)
            begin = np.flatnonzero(new)
            state, run = auto.statistics(word, begin, np.diff(np.append(begin, len(known))))
            here = auto.here[state] & (run[:, None] >= size)
            hit, which = np.nonzero(here)
            n_base = np.bincount(row[hit], minlength=n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            begins = place[hit] - size[which] + 1
            np.minimum.at(first, row[hit], begins)
            np.maximum.at(last, row[hit], begins)
            labels: dict[int, set[str]] = {}
            for r, k in set(zip(row[hit].tolist(), which.tolist())):
                labels.setdefault(r, set()).add(base_names[k])
            base_labels = [",".join(sorted(labels.get(i, ()))) for i in range(n)]
            # runs that the next word does not extend
            long = run >= min_run
            if len(run) > 1:
                long[:-1] &= new[1:] | (run[1:] != run[:-1] + 1)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for i in np.flatnonzero(long).tolist():
                found.setdefault(int(row[i]), []).append((int(place[i]), int(run[i]), int(state[i])))
            score = np.where(n_base > 0, NAMED, 0.0)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for r, matches in found.items():
                for t, a, b, covered in chains(matches, auto.ends, gap):
                    share = min(1.0, covered / len(sequences[t]))
                    score[r] = max(score[r], share)
                    if share >= coverage:
                        labels.setdefault(r, set()).add(names[t])
                        spans[r].append({"label": names[t], "first": a, "last": b, "covered": share})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(count.astype(np.int64)),
                    pa.array(n_base.astype(np.int64)),
                    pa.array(np.where(n_base > 0, first, 0).astype(np.int64), mask=n_base == 0),
                    pa.array(last.astype(np.int64), mask=n_base == 0),
                    pa.array(base_labels),
                    pa.array([",".join(sorted(labels.get(i, ()))) for i in range(n)]),
                    pa.array(score),
                    pa.array(spans, _SPANS),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return rows.mapInArrow(
        work,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first: long, last: long, covered: double>>",
    )


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
