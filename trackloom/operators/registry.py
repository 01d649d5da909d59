"""Method registry tables: validation, lookup with aliases, category overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry_violations(registry: DataFrame, required: Sequence[str]) -> DataFrame:
    """Missing fields, names used twice in a task, aliases used twice or equal to a name.

    ``registry`` has task, name, aliases and the required fields.
    """
    empty = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    missing = registry.select("task", "name", F.explode(F.array_compact(F.array(*empty))).alias("problem"))
    doubled = (
        registry.groupBy("task", "name")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("task", "name", F.lit("duplicate name").alias("problem"))
    )
    alias = registry.select("task", "name", F.explode("aliases").alias("alias"))
    shared = (
        alias.groupBy("task", "alias")
        .agg(F.countDistinct("name").alias("_n"))
        .where(F.col("_n") > 1)
        .select("task", F.col("alias").alias("name"), F.lit("duplicate alias").alias("problem"))
    )
    names = registry.select("task", F.col("name").alias("alias"), F.lit(1).alias("_hit")).distinct()
    clash = (
        alias.where(F.col("alias") != F.col("name"))
        .join(names, ["task", "alias"], "left_semi")
        .select("task", F.col("alias").alias("name"), F.lit("alias is a name").alias("problem"))
        .distinct()
    )
    return missing.unionByName(doubled).unionByName(shared).unionByName(clash)


def lookup(requests: DataFrame, registry: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Profile of each requested (task, method): by name, else by alias, else unregistered.

    ``candidates`` counts the registry rows an alias matches; more than one is an
    ambiguity the caller should reject.
    """
    by_name = registry.groupBy("task", F.col("name").alias("method")).agg(
        F.min(F.struct("name", *fields)).alias("_a")
    )
    by_alias = (
        registry.select("task", F.explode("aliases").alias("method"), F.struct("name", *fields).alias("_s"))
        .groupBy("task", "method")
        .agg(F.min("_s").alias("_b"), F.countDistinct("_s").alias("_n"))
    )
    joined = requests.join(by_name, ["task", "method"], "left").join(by_alias, ["task", "method"], "left")
    hit = F.coalesce("_a", "_b")
    return joined.select(
        *requests.columns,
        hit["name"].alias("name"),
        *[F.coalesce(hit[f], F.lit("unregistered")).alias(f) for f in fields],
        F.when(F.col("_a").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.coalesce("_n", F.lit(0))).alias("candidates"),
    )


def override_categories(summary: DataFrame, categorised: DataFrame, profiles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Summary rows with their category; registry values win over the categorised file."""
    a = categorised.select("method", *[F.col(f).alias(f"_c_{f}") for f in fields])
    b = profiles.select("method", *[F.nullif(F.col(f), F.lit("unregistered")).alias(f"_r_{f}") for f in fields])
    joined = summary.join(a, "method", "left").join(b, "method", "left")
    return joined.select(
        *summary.columns, *[F.coalesce(f"_r_{f}", f"_c_{f}", F.lit("")).alias(f) for f in fields]
    )


def score_grid(components: DataFrame, columns: Sequence[str], variants: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """Scores of every weight variant in one pass: sample_id, method, score."""
    scored = []
    for name, weights in variants:
        total = sum(weights) or 1.0
        score = sum((F.col(c) * (w / total) for c, w in zip(columns, weights)), F.lit(0.0))
        scored.append(F.struct(F.lit(name).alias("method"), score.alias("score")))
    return components.select("sample_id", F.explode(F.array(*scored)).alias("v")).select("sample_id", "v.*")
