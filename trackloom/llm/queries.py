"""Registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import fixity, host_rules, license_automaton, line_join, mixing, pieces, probminhash, projection_pairs, secret_forest, spelling, token_blocks, toxicity, turn_repair
from trackloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "copy_of", "cluster_id", "cluster_size", "kept")


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.line_report(table(spark, sf_dir, "documents"))


@query("op1_host_quality_rules", host_rules.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(table(spark, sf_dir, "documents"))


@query("op2_source_mixing", mixing.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", (F.round("target", 6) + F.lit(0.0)).alias("target"), "taken")


@query("op7_piece_encoding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_automaton.scanned(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@query("op10_warc_fixity", fixity.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audited(table(spark, sf_dir, "pages"))


@query("op3_embedding_near_dedup", projection_pairs.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_pairs.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.report(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(table(spark, sf_dir, "conversations"))


@query("op12_token_blocks")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.round_trip(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
