"""Quality rules at host level, in DataFrame functions only.

Every document is measured and held against rules.  Failures are summed by host, the rate of each rule in each
host is shrunk by a beta prior fitted to the rates of all hosts (moments), and the hosts' verdicts return to
the documents: a document goes if it fails a base rule, or another rule on which its host is condemned.  A host is
condemned on a rule if its rate is, with confidence, a multiple of what is usual, within a least and a most bar.
Documents that fail no rule stay whatever their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, SPACE, host_key
from trackloom.session import materialize

#: A host is condemned on a rule if the lower bound of its shrunk failure rate (CONFIDENCE standard deviations of the posterior below
#: its mean) reaches the bar: RELATIVE times the rate of all documents, at least FLOOR (rarer faults say little of a host) and at most CONDEMNED.
RELATIVE, FLOOR, CONDEMNED = 2.0, 0.05, 0.5
CONFIDENCE = 1.645
#: Weight of the prior in documents: its least (a few documents of a host prove little), and its most where hosts differ by chance only.
PRIOR_MIN, PRIOR_MAX = 10.0, 1e6
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE = ["short", "repetitive"]


def measured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with MEASURES of the column ``text`` (null: empty) and without the helpers.

    Repeated windows are found by a 64-bit hash of their three words within one text.
    """
    keep = [c for c in rows.columns]
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))
    empty = F.array().cast("array<string>")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    out = rows.withColumns(
        {
            "_w": F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(empty),
            "_l": lines,
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            "word_chars": F.length(F.regexp_replace(trimmed, SPACE, "")).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    )
    gram = F.transform(
        F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)),
    )
    out = out.withColumn("_g", gram)
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    placed = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("_s", F.when(repeats, placed))
    again = F.filter(
        F.transform(
            "_s",
            lambda x, i: F.when(
                (x["g"] == F.get("_s", i - 1)["g"]) | (x["g"] == F.get("_s", i + 1)["g"]), x["i"]
            ),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.array_sort(again),
        start,
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.select(*keep, *MEASURES)


def host_rates(measures: DataFrame, condemned: float = CONDEMNED) -> DataFrame:
    """Per ``_host``: documents, the shrunk failure rate of every rule, and whether the host is condemned on it.

    The beta prior of a rule has the mean of all documents; its weight comes from the spread of the hosts' rates
    beyond what chance gives (method of moments), within PRIOR_MIN and PRIOR_MAX documents.
    """
    counts = measures.groupBy("_host").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.expr(f"{e}").cast("long")).alias(f"_f_{r}") for r, e in RULES.items()]
    )
    counts = materialize(counts)
    moments = counts.agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        *[F.sum(f"_f_{r}").alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(f"_f_{r}") * F.col(f"_f_{r}") / F.col("_n")).alias(f"q_{r}") for r in RULES],
    ).first()
    rates = []
    for r in RULES:
        n, k = moments["n"] or 0, moments["k"] or 0
        mean = moments[f"f_{r}"] / n if n else 0.0
        spread = moments[f"q_{r}"] / n - mean * mean if n else 0.0
        chance = mean * (1 - mean)
        between = spread - chance * k / n if n else 0.0
        weight = (chance - spread) / between if between > 0 else PRIOR_MAX
        weight = min(max(weight, PRIOR_MIN), PRIOR_MAX)
        held = F.col("_n") + F.lit(weight)
        rate = (F.col(f"_f_{r}") + F.lit(weight * mean)) / held
        low = rate - F.lit(CONFIDENCE) * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (held + 1))
        bar = min(max(RELATIVE * mean, FLOOR), condemned)
        rates += [rate.alias(f"_r_{r}"), (low >= F.lit(bar)).alias(f"_c_{r}")]
    return counts.select("_host", "_n", *rates)


def _verdict() -> Column:
    gone = F.lit(False)
    for r, rule in RULES.items():
        gone = gone | (F.expr(rule) & F.col(f"_c_{r}"))
    return gone


def judged(docs: DataFrame, host: str = "source", condemned: float = CONDEMNED) -> DataFrame:
    """One row per document: ``doc_id``, MEASURES, ``base_failed``, ``host_fail_rate`` and ``kept``.

    ``docs`` has ``doc_id``, ``text`` and the column ``host``.  A null text is empty (and fails as short); a null
    host is a host of its own.  Repeated rows count and return as often as they occur.  An empty table gives an
    empty result.  ``host_fail_rate`` is the largest shrunk rate among the rules that the document fails, else 0;
    it is rounded to six places, the verdict uses the whole figures.
    """
    return _judge(_measures(docs, host), condemned).select(
        "doc_id", *MEASURES, "base_failed", "host_fail_rate", "kept"
    )


def _measures(docs: DataFrame, host: str) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("_body"), host_key(host).alias("_host"))
    rows = rows.withColumn("_th", F.xxhash64(F.coalesce("_body", F.lit("")), "_host"))
    return materialize(measured(rows, "_body").drop("_body"))


def _judge(measures: DataFrame, condemned: float) -> DataFrame:
    rates = host_rates(measures, condemned)
    rated = measures.join(rates, "_host")
    base = F.expr(" or ".join(f"({RULES[r]})" for r in BASE))
    worst = F.greatest(*[F.when(F.expr(rule), F.col(f"_r_{r}")).otherwise(F.lit(0.0)) for r, rule in RULES.items()])
    return rated.withColumns(
        {
            "base_failed": base,
            "host_fail_rate": F.round(worst, 6),
            "kept": ~base & ~_verdict(),
        }
    )


def passing(docs: DataFrame, host: str = "source", condemned: float = CONDEMNED) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    gone = _judge(_measures(docs, host), condemned).where("not kept")
    gone = materialize(gone.select(F.col("doc_id").cast("long").alias("_id"), "_th").distinct())
    whole = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), host_key(host)).alias("_th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
    )
    few = gone.select(
        F.coalesce("_id", F.lit(0)).alias("_k"), F.col("_id").isNull().alias("_null"), F.col("_th").alias("_t")
    )
    few = F.broadcast(few) if gone.count() <= BROADCAST_ROWS else few
    on = (F.coalesce("_id", F.lit(0)) == F.col("_k")) & (F.col("_id").isNull() == F.col("_null")) & (F.col("_th") == F.col("_t"))
    return whole.join(few, on, "left_anti").select("_doc.*")


def oracle() -> str:
    """The query in DuckDB's SQL, for tables whose ids are unique."""
    space = r"[\x20\x09-\x0D]+"
    stats, priors, rates, gone, worst = [], [], [], [], []
    for r, rule in RULES.items():
        m, q = f"(t.f_{r} / n)", f"(t.q_{r} / n)"
        c, spread = f"({m} * (1 - {m}))", f"({q} - {m} * {m})"
        b = f"({spread} - {c} * k / n)"
        stats.append(f"sum(f_{r})::DOUBLE AS f_{r}, sum(f_{r}::DOUBLE * f_{r} / hn) AS q_{r}")
        priors.append(
            f"h.f_{r} AS f_{r}, {m} AS m_{r}, CASE WHEN {b} > 0 THEN least(greatest(({c} - {spread}) / {b}, {PRIOR_MIN}), {PRIOR_MAX}) ELSE {PRIOR_MAX} END AS w_{r}"
        )
        rates.append(f"(f_{r} + w_{r} * m_{r}) / (hn + w_{r}) AS r_{r}")
        bar = f"least(greatest({RELATIVE} * m_{r}, {FLOOR}), {CONDEMNED})"
        gone.append(f"(({rule}) AND r_{r} - {CONFIDENCE} * sqrt(greatest(r_{r} * (1 - r_{r}), 0) / (hn + w_{r} + 1)) >= {bar})")
        worst.append(f"CASE WHEN {rule} THEN r_{r} ELSE 0 END")
    base = " OR ".join(f"({RULES[r]})" for r in BASE)
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(list_filter(string_split_regex(t, '{space}'), lambda x: x <> '')) AS w,
             generate_subscripts(list_filter(string_split_regex(t, '{space}'), lambda x: x <> ''), 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)),
h AS (SELECT source, count(*) AS hn, {", ".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS f_{r}" for r, rule in RULES.items())} FROM m GROUP BY source),
t AS (SELECT sum(hn)::DOUBLE AS n, count(*) AS k, {", ".join(stats)} FROM h),
p AS (SELECT h.source, hn, {", ".join(priors)} FROM h, t),
v AS (SELECT *, {", ".join(rates)} FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
       round(greatest({", ".join(worst)}), 6) AS host_fail_rate, NOT ({base}) AND NOT ({" OR ".join(gone)}) AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""
