"""Summary and reporting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most common value per key; ties go to the smallest value."""
    counts = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(*keys).agg(
        F.min_by(column, F.struct(-F.col("votes"), F.col(column))).alias(column),
        F.max("votes").alias("votes"),
    )


# --------------------------------------------------------------------------- labels and scores
def labels_by_sample(labels: DataFrame) -> DataFrame:
    """Window labels per sample: largest label, frame span, windows, first anomaly type."""
    positive = F.col("label") == 1
    typed = F.when(positive & (F.col("anomaly_type") != "normal"), F.col("anomaly_type"))
    return labels.groupBy("sample_id").agg(
        F.max("label").alias("label"),
        F.min("frame_start").alias("frame_start"),
        F.max("frame_end").alias("frame_end"),
        F.count(F.lit(1)).alias("num_windows"),
        F.count(F.when(positive, F.lit(1))).alias("positive_windows"),
        F.coalesce(
            F.min_by(typed, F.when(typed.isNotNull(), F.struct("frame_start", "window_id"))), F.lit("normal")
        ).alias("anomaly_type"),
    )


def best_rows(scores: DataFrame, tie: str = "window_id") -> DataFrame:
    """The best score row of every sample; ties go to the smaller tie key."""
    rest = [c for c in scores.columns if c not in ("sample_id", "score", tie)]
    key = F.struct(-F.col("score"), F.col(tie))
    best = scores.groupBy("sample_id").agg(F.min_by(F.struct("score", tie, *rest), key).alias("r"))
    return best.select("sample_id", "r.*")


def label_distribution(labels: DataFrame) -> DataFrame:
    """Rows per anomaly type and in total (type ``*``)."""
    return (
        labels.rollup("anomaly_type")
        .agg(F.count(F.lit(1)).alias("num_rows"), F.sum(F.col("label").cast("long")).alias("num_positive"))
        .withColumn("anomaly_type", F.coalesce("anomaly_type", F.lit("*")))
    )


def field_coverage(rows: DataFrame) -> DataFrame:
    """Present and missing values of every column (empty text counts as missing)."""
    names = sorted(rows.columns)

    def present(c: str):
        text = F.col(c).cast("string")
        return F.count(F.when(text.isNotNull() & (text != ""), F.lit(1)))

    counted = rows.agg(F.count(F.lit(1)).alias("_n"), *[present(c).alias(f"_p_{c}") for c in names])
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_p_{c}").alias("present")) for c in names])
    return counted.select("_n", F.explode(items).alias("i")).select(
        "i.field", "i.present", (F.col("_n") - F.col("i.present")).alias("missing")
    )


def diagnostic_warnings(report: DataFrame, label_fields: DataFrame, score_fields: DataFrame) -> DataFrame:
    """Warnings from one alignment report row and the two coverage tables."""
    partial = (F.col("present") > 0) & (F.col("missing") > 0)
    flags = label_fields.agg(F.max(partial).alias("_lp"), F.lit(1).alias("_one")).join(
        score_fields.agg(F.max(partial).alias("_sp"), F.lit(1).alias("_one")), "_one"
    )
    checks = [
        ("missing_score_keys", F.col("num_missing_score_keys") > 0),
        ("extra_score_keys", F.col("num_extra_score_keys") > 0),
        ("duplicate_label_keys", F.col("num_duplicate_label_keys") > 0),
        ("duplicate_score_keys", F.col("num_duplicate_score_keys") > 0),
        ("partial_label_field_coverage", F.col("_lp")),
        ("partial_score_field_coverage", F.col("_sp")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    joined = report.withColumn("_one", F.lit(1)).join(F.broadcast(flags), "_one")
    return joined.select(
        F.concat_ws(",", found).alias("warnings"),
        F.when(F.size(found) > 0, F.lit("warning")).otherwise(F.lit("ok")).alias("status"),
    )


# --------------------------------------------------------------------------- method tables
def anomaly_type_hits(ranked: DataFrame, aligned: DataFrame, k: int) -> DataFrame:
    """Per method and anomaly type: positives among the k best, recall, mean score.

    ``aligned`` has method, sample_id, label, anomaly_type, score; ``ranked`` its top k.
    """
    hits = ranked.where(F.col("rank") <= k).select("method", "sample_id", F.lit(1).alias("_hit"))
    return (
        aligned.where(F.col("label") > 0)
        .join(hits, ["method", "sample_id"], "left")
        .groupBy("method", "anomaly_type")
        .agg(
            F.count("_hit").alias("hits_at_k"),
            F.count(F.lit(1)).alias("total_positive"),
            (F.count("_hit") / F.count(F.lit(1))).alias("recall_at_k"),
            F.avg("score").alias("mean_positive_score"),
        )
    )


def case_rows(aligned: DataFrame, k: int, limit: int = 12) -> DataFrame:
    """First true and false positives by rank and the lowest-scored missed positives.

    The ranks come from one range sort per method; row_number <= limit prunes
    before its shuffle.
    """
    from trackloom.operators.scale import row_positions

    placed = row_positions(aligned, ["method"], [("score", False), ("sample_id", True)], out="_pos")
    rank = (F.col("_pos") + 1).alias("rank")
    rows = placed.select("method", "sample_id", "label", "anomaly_type", "score", rank)
    missed = rows.where((F.col("label") > 0) & (F.col("rank") > k)).withColumn("case_type", F.lit("false_negative"))
    named = rows.withColumn(
        "case_type", F.when(F.col("label") > 0, F.lit("true_positive")).otherwise(F.lit("false_positive"))
    )
    order = F.when(F.col("case_type") == "false_negative", F.col("score"))
    w = Window.partitionBy("method", "case_type").orderBy(order.asc(), F.col("rank").asc(), "sample_id")
    return (
        named.unionByName(missed).withColumn("case_rank", F.row_number().over(w)).where(F.col("case_rank") <= limit)
    )


def leaderboard(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Metrics with the method's profile, best AUROC first."""
    return metrics.join(profiles, "method", "left").orderBy(F.col("auroc").desc_nulls_last(), "method")


def rank_rows(rows: DataFrame, metric: str = "auprc", tie: str = "method") -> DataFrame:
    """Rows by a metric (or its mean over seeds), missing values last."""
    columns = [F.col(c) for c in (metric, f"{metric}_mean") if c in rows.columns]
    return rows.orderBy(F.coalesce(*columns).desc_nulls_last(), tie)


def seed_summary(runs: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for one run) of each metric over seeds."""
    aggregates = []
    for m in metrics:
        aggregates += [
            F.avg(m).alias(f"{m}_mean"),
            F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std"),
        ]
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_runs"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("seed")), lambda s: s.cast("string"))).alias("seeds"),
        *aggregates,
    )


def best_by_metric(summary: DataFrame, metrics: list[str], tie: str = "method") -> DataFrame:
    """The best row for each metric."""
    items = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")
            )
            for m in metrics
        ]
    )
    long = summary.select(tie, "num_runs", F.explode(items).alias("i")).select(tie, "num_runs", "i.*")
    key = F.struct(-F.col("mean"), F.col(tie))
    return (
        long.where(F.col("mean").isNotNull())
        .groupBy("metric")
        .agg(F.min_by(F.struct(tie, "num_runs", "mean", "std"), key).alias("r"))
        .select("metric", "r.*")
    )


def report_table(summary: DataFrame, metrics: list[str], digits: int = 4) -> DataFrame:
    """``mean +/- std`` text per metric."""
    return summary.select(
        "method",
        *[
            F.format_string(f"%.{digits}f +/- %.{digits}f", F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m)
            for m in metrics
        ],
    )


# Words that give away the level of a method.
LEVEL_TOKENS = {
    "individual": ("individual", "person", "single"),
    "group": ("group", "graph", "collective", "team"),
}


def infer_level(task: Column, method: Column, source: Column) -> Column:
    """Level by task, then by method name, then by the only level named anywhere."""
    t, m = F.lower(F.coalesce(task, F.lit(""))), F.lower(F.coalesce(method, F.lit("")))
    text = F.concat_ws(" ", t, m, F.replace(F.lower(F.coalesce(source, F.lit(""))), F.lit("\\"), F.lit("/")))
    names = {level: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0 for level, words in LEVEL_TOKENS.items()}
    out = F.when(t.rlike("^individual|_individual"), "individual").when(t.rlike("^group|_group"), "group")
    out = out.when(m.rlike("^individual_|_individual_"), "individual").when(m.rlike("^group_|_group_"), "group")
    return out.when(names["individual"] & ~names["group"], "individual").when(
        names["group"] & ~names["individual"], "group"
    )


# --------------------------------------------------------------------------- maps and timelines
def heat_grid(points: DataFrame, scores: DataFrame, width: float, height: float, columns: int, rows: int) -> DataFrame:
    """Score mass per grid cell and sequence; a track spreads its score over its points."""
    sized = points.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    weights = scores.join(sized, "sample_id").select("sample_id", (F.col("score") / F.col("_n")).alias("weight"))

    def cell(value: str, size: float, cells: int):
        clamped = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(size - 1.0))
        return F.least(F.floor(clamped / size * cells), F.lit(cells - 1)).cast("int")

    return (
        points.join(weights, "sample_id")
        .groupBy("sequence", cell("cx", width, columns).alias("grid_x"), cell("cy", height, rows).alias("grid_y"))
        .agg(F.sum("weight").alias("mass"), F.count(F.lit(1)).alias("points"))
    )


def sequence_mass(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("sequence")
        .agg(
            F.count(F.lit(1)).alias("num_tracks"),
            F.sum("score").alias("total_mass"),
            F.avg("score").alias("mean_score"),
        )
        .orderBy(F.col("total_mass").desc(), F.col("num_tracks").desc(), "sequence")
    )


def top_tracks(scores: DataFrame, n: int | None = None) -> DataFrame:
    """The n best-scored tracks of every sequence with their rank (all of them without n)."""
    w = Window.partitionBy("sequence").orderBy(F.col("score").desc(), "sample_id")
    if n is None:
        from trackloom.operators.scale import row_positions

        placed = row_positions(scores, ["sequence"], [("score", False), ("sample_id", True)], out="rank")
        return placed.select(*scores.columns, (F.col("rank") + 1).cast("int").alias("rank"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def frame_mass(points: DataFrame, scores: DataFrame, n: int | None = None) -> DataFrame:
    """Score mass per frame of all tracks of each sequence, or of the n best."""
    best = (scores if n is None else top_tracks(scores, n)).select("sample_id", "score")
    mine = points.join(best, "sample_id")
    sized = mine.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        mine.join(sized, "sample_id")
        .groupBy("sequence", "frame_id")
        .agg(F.sum(F.col("score") / F.col("_n")).alias("mass"))
    )


def playback_stats(steps: DataFrame, scores: DataFrame, n: int | None = None) -> DataFrame:
    """Path, speed, confidence and offset figures of all tracks, or of the n best per sequence.

    ``scores`` has sample_id, sequence, score, used_sources.
    """
    top = scores.groupBy("sequence").agg(F.max("score").alias("_max"))
    best = top_tracks(scores, n).join(top, "sequence")
    stats = steps.groupBy("sample_id").agg(
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"),
        F.avg(F.round("confidence", 4)).alias("avg_confidence"),
        (F.max(F.round("confidence", 4)) - F.min(F.round("confidence", 4))).alias("confidence_drop"),
        F.max("modal_offset").alias("max_modal_offset"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed"),
    )
    used = F.col("used_sources")
    both = F.contains(used, F.lit("individual")) & F.contains(used, F.lit("group"))
    return best.join(stats, "sample_id").select(
        "sample_id",
        "sequence",
        "rank",
        "score",
        (F.col("score") / F.greatest("_max", F.lit(1e-6))).alias("score_ratio"),
        "first_frame",
        "last_frame",
        (F.col("last_frame") - F.col("first_frame") + 1).alias("duration"),
        "avg_confidence",
        "confidence_drop",
        "max_modal_offset",
        "path_length",
        "avg_speed",
        "max_speed",
        F.when(both, F.lit(1.0)).when(used != "", F.lit(0.58)).otherwise(F.lit(0.0)).alias("source_coverage"),
        (F.col("max_speed") / (F.col("max_speed") + 6.0)).alias("motion"),
        (F.col("max_modal_offset") / (F.col("max_modal_offset") + 8.0)).alias("modal"),
        F.least(F.col("confidence_drop") * 2.0, F.lit(1.0)).alias("confidence"),
    )


def modality_audit(observations: DataFrame) -> DataFrame:
    """Coverage of each sequence by sensor and its status."""
    has = lambda m: F.col(f"{m}_cx").isNotNull()
    n = F.count(F.lit(1))
    tracks = observations.groupBy("sequence", "sample_id").agg(
        n.alias("_p"),
        F.count(F.when(has("rgb"), 1)).alias("_r"),
        F.count(F.when(has("thermal"), 1)).alias("_t"),
        F.count(F.when(has("rgb") | has("thermal"), 1)).alias("_f"),
    )
    table = tracks.groupBy("sequence").agg(
        n.alias("track_count"),
        F.sum("_p").alias("point_count"),
        F.sum("_f").alias("fused_points"),
        F.sum("_r").alias("rgb_points"),
        F.sum("_t").alias("thermal_points"),
    )
    p = F.col("point_count")
    return table.select(
        "*",
        F.round(F.col("fused_points") / p, 6).alias("fused_coverage"),
        F.round(F.col("rgb_points") / p, 6).alias("rgb_coverage"),
        F.round(F.col("thermal_points") / p, 6).alias("thermal_coverage"),
        F.when((F.col("rgb_points") < p) | (F.col("thermal_points") < p), F.lit("partial_modality"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )


def convergence(history: DataFrame, requested: int, patience: int = 5, min_delta: float = 1e-3) -> DataFrame:
    """Best epoch, epochs since and status of every run; ``history`` has run, epoch, value.

    An epoch improves when it beats the best so far by both the relative and the absolute delta.  Only finite values count for the
    best; the final epoch is that of all rows, and a run without a finite value has the status
    ``no-loss-history``.  A run's epochs are numbered, and ``requested`` bounds them.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    runs = history.groupBy("run").agg(
        F.sort_array(F.collect_list(F.when(finite, F.struct("epoch", "value")))).alias("_h"), F.max("epoch").alias("final_epoch")
    )
    start = F.struct(F.get("_h", F.lit(0))["epoch"].alias("epoch"), F.get("_h", F.lit(0))["value"].alias("value"))

    def fold(best, row):
        target = F.least(best["value"] * (1.0 - min_delta), best["value"] - min_delta)
        return F.when(
            row["value"] < target, F.struct(row["epoch"].alias("epoch"), row["value"].alias("value"))
        ).otherwise(best)

    table = runs.select("run", "final_epoch", F.aggregate("_h", start, fold).alias("_b"), (F.size("_h") == 0).alias("_none"))
    since = F.col("final_epoch") - F.col("_b.epoch")
    return table.select(
        "run",
        "final_epoch",
        F.col("_b.epoch").alias("best_epoch"),
        F.col("_b.value").alias("best_value"),
        since.alias("epochs_since_best"),
        F.when(F.col("_none"), F.lit("no-loss-history"))
        .when(F.col("final_epoch") < requested, F.lit("early-stopped"))
        .when(since >= patience, F.lit("converged"))
        .otherwise(F.lit("max-budget-not-converged"))
        .alias("status"),
    )

def summarize_top(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Among the k best mean scores: count and mean scores per group."""
    best = rows.orderBy(F.col("mean_score").desc(), "sample_id").limit(k)
    return best.groupBy(by).agg(
        F.count(F.lit(1)).alias("top_k_count"),
        F.avg("mean_score").alias("mean_of_mean_score"),
        F.avg("max_score").alias("mean_of_max_score"),
    )


def fingerprint(rows: DataFrame, columns: list[str], parts: int = 256) -> DataFrame:
    """An order-independent sha256 of a table's content.

    Row hashes are summed in 16-bit pieces per leading byte, then the fixed number
    of sums is hashed, so nothing is collected.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    digits = rows.select(row.alias("_h"))
    pieces = [
        F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"_s{i}") for i in range(8)
    ]
    per_byte = digits.groupBy(F.substring("_h", 1, 2).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), *pieces)
    text = F.concat_ws(":", "_b", "_n", *[f"_s{i}" for i in range(8)])
    return per_byte.agg(
        F.sum("_n").alias("num_rows"),
        F.sha2(F.concat_ws(";", F.sort_array(F.collect_list(text))), 256).alias("fingerprint"),
    )


# --------------------------------------------------------------------------- explanations
def strongest_detector(scores: DataFrame, detectors: list[str]) -> DataFrame:
    """Best detector, its score and all scores as text, largest first."""
    items = F.array(*[F.struct(F.col(d).alias("v"), F.lit(-i).alias("i"), F.lit(d).alias("n")) for i, d in enumerate(detectors)])
    ordered = F.sort_array(items, asc=False)
    return scores.select(
        "sample_id",
        F.get(ordered, F.lit(0))["n"].alias("top_detector"),
        F.get(ordered, F.lit(0))["v"].alias("top_detector_score"),
        F.concat_ws("; ", F.transform(ordered, lambda e: F.format_string("%s=%.6f", e["n"], e["v"]))).alias(
            "detector_breakdown"
        ),
    )


def component_family(name: Column) -> Column:
    return (
        F.when(name.startswith("individual_") | name.isin("route_score", "speed_score", "shape_score"), "individual")
        .when(name.startswith("group_") | name.startswith("graph_"), "group")
        .when(name.startswith("registration_"), "registration")
        .when(name.startswith("S_"), "fusion")
        .otherwise("other")
    )


def ranked_components(components: Column, k: int = 5) -> Column:
    """The k strongest entries of a name -> score map.

    Largest absolute value first, then name; the first aggregate (``S_`` names,
    ``S_event`` before the others) takes the second place.
    """
    entry = F.transform(
        F.map_entries(F.map_filter(components, lambda _, v: v.isNotNull() & ~F.isnan(v))),
        lambda e: F.struct(
            F.when(e["key"] == "S_event", F.lit(0)).otherwise(F.lit(1)).alias("first"),
            (-F.abs(F.round(e["value"], 6))).alias("weight"),
            e["key"].alias("name"),
            F.round(e["value"], 6).alias("value"),
            component_family(e["key"]).alias("family"),
        ),
    )
    aggregate = F.array_sort(F.filter(entry, lambda e: e["name"].startswith("S_")))
    primary = F.array_sort(
        F.transform(
            F.filter(entry, lambda e: ~e["name"].startswith("S_")), lambda e: e.withField("first", F.lit(1))
        )
    )
    big = 1 << 30
    ordered = F.concat(
        F.slice(primary, 1, 1), F.slice(aggregate, 1, 1), F.slice(primary, 2, big), F.slice(aggregate, 2, big)
    )
    return F.slice(ordered, 1, k)


def score_decomposition(rows: DataFrame) -> DataFrame:
    """S_ind, S_grp, S_event and S_fused from components, sources and raw scores.

    ``rows`` has sample_id, components (map), used_sources, score, event_score,
    individual_raw, group_raw.  A named component wins; else the largest positive
    prefixed component, the raw score, or a share of the score.
    """
    used = F.lower(F.coalesce("used_sources", F.lit("")))
    has = {n: F.contains(used, F.lit(n)) for n in ("individual", "group", "registration")}
    c = F.col("components")
    zero = F.lit(0.0)

    def fallback(prefix: str, raw: str, weight: Column):
        values = F.map_values(F.map_filter(c, lambda k, v: k.startswith(f"{prefix}_") & (v > 0)))
        given = F.coalesce(F.col(raw), zero)
        return F.coalesce(F.array_max(values), F.when(given != 0, given), weight * F.col("score"))

    alpha = 0.65
    both = has["individual"] & has["group"]
    weight_ind = F.when(both, F.lit(alpha)).otherwise(F.lit(1.0))
    weight_grp = F.when(both, F.lit(1 - alpha)).otherwise(F.lit(1.0))
    fused = F.coalesce(c["S_fused"], F.col("score"))
    registered = F.map_values(F.map_filter(c, lambda k, v: k.startswith("registration_")))
    event = F.when(has["registration"], F.coalesce(F.array_max(registered), fused)).otherwise(
        F.coalesce(c["S_event"], F.col("event_score"), zero)
    )
    ind = F.coalesce(
        c["S_ind"], F.when(has["individual"], fallback("individual", "individual_raw", weight_ind)), zero
    )
    grp = F.coalesce(c["S_grp"], F.when(has["group"], fallback("group", "group_raw", weight_grp)), zero)
    ind = F.when(both & (ind == 0), F.coalesce(F.col("individual_raw"), zero)).otherwise(ind)
    grp = F.when(both & (grp == 0), F.coalesce(F.col("group_raw"), zero)).otherwise(grp)
    return rows.select(
        "sample_id", ind.alias("s_ind"), grp.alias("s_grp"), event.alias("s_event"), fused.alias("s_fused")
    )


# --------------------------------------------------------------------------- set operations and sampling
def top_sequences(mass: DataFrame, scores: DataFrame, sequences: int, targets: int = 10) -> DataFrame:
    """Sequences with most mass, then those of the best targets, each once in order."""
    best = mass.orderBy(F.col("total_mass").desc(), "sequence").limit(sequences)
    heavy = best.select(F.lit(0).alias("part"), (-F.col("total_mass")).alias("_o"), "sequence")
    lead = scores.orderBy(F.col("score").desc(), "sample_id").limit(targets)
    named = lead.select(F.lit(1).alias("part"), (-F.col("score")).alias("_o"), "sequence")
    return heavy.unionByName(named).groupBy("sequence").agg(F.min(F.struct("part", "_o"))["part"].alias("part"))


def evenly_spaced(rows: DataFrame, key: str, group: str, n: int = 72) -> DataFrame:
    """At most n rows per group at positions round(i * (count - 1) / (n - 1)), half to even."""
    from trackloom.operators.scale import row_positions

    placed = row_positions(rows, [group], [(key, True)])
    total = F.col("position_count")
    wanted = placed.select(group, "position_count").distinct().select(
        group,
        F.explode(
            F.when(total <= n, F.sequence(F.lit(0).cast("long"), total - 1)).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.lit(n - 1)),
                    lambda i: F.rint(i * (total - 1) / F.lit(float(n - 1))).cast("long"),
                )
            )
        ).alias("position"),
    ).distinct()
    return placed.join(wanted, [group, "position"]).drop("position_count")


def first_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Concatenate tables; of rows with one key the earliest table's wins."""
    tagged = None
    for i, df in enumerate(sources):
        part = df.withColumn("_source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (*keys, "_source")]
    picked = tagged.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_source")).alias("r"))
    return picked.select(*keys, "r.*")


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are null."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# Spellings of label values.
TRUE_WORDS = ["1", "true", "yes", "y", "anomaly", "abnormal", "positive", "pos"]
FALSE_WORDS = ["0", "false", "no", "n", "normal", "negative", "neg"]


def first_present(rows: DataFrame, names: list[str]) -> Column:
    """First non-empty of the alias columns that exist."""
    columns = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*columns) if columns else F.lit(None).cast("string")


def binary_label(value: Column) -> Column:
    """0 or 1 from a label spelling; null when it is neither."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return (
        F.when(text.isin(TRUE_WORDS), F.lit(1))
        .when(text.isin(FALSE_WORDS), F.lit(0))
        .when(number.isin(0.0, 1.0), number.cast("int"))
    )


def normalize_labels(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Label rows with canonical columns from alias columns; ``problem`` names a bad row."""
    sequence = first_present(rows, aliases["sequence"])
    track = first_present(rows, aliases["track_id"])
    sample = first_present(rows, aliases["sample_id"])
    label = binary_label(first_present(rows, aliases["label"]))
    built = F.when(sequence.isNotNull() & track.isNotNull(), F.concat_ws(":", sequence, track))
    sample_id = F.coalesce(sample, built)
    kind = F.coalesce(
        first_present(rows, aliases["anomaly_type"]),
        F.when(label == 1, F.lit("real_anomaly")).otherwise(F.lit("normal")),
    )
    return rows.select(
        sample_id.alias("sample_id"),
        F.coalesce(sequence, F.substring_index(sample_id, ":", 1)).alias("sequence"),
        F.coalesce(track, F.regexp_replace(sample_id, "^[^:]*:", "")).alias("track_id"),
        label.alias("label"),
        kind.alias("anomaly_type"),
        F.when(sample_id.isNull(), F.lit("no sample"))
        .when(label.isNull(), F.lit("unsupported label"))
        .alias("problem"),
    )


def normalize_sequence_name(value: Column) -> Column:
    """Forward slashes, trimmed, without a trailing 00 or 01 part."""
    slashed = F.trim(F.replace(value, F.lit("\\"), F.lit("/")))
    return F.regexp_replace(F.regexp_replace(slashed, "^/+|/+$", ""), "/(00|01)$", "")
