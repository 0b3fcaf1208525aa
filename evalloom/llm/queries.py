"""Queries of the text problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import mixing, packing, pairs, percentiles, pii, subjects, truncation
from .tokens import source_name


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_mentions(table(spark, sf_dir, "cases"), "case_id", "customer_message")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with typed placeholders."""
    return pii.redact(table(spark, sf_dir, "cases"), "case_id", "customer_message")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(*(table(spark, sf_dir, n) for n in ("garage_fixture", "small_responses", "large_responses")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_off = truncation.cut_runs(table(spark, sf_dir, "agent_runs"), "run_id", "harness", "harness_result.final_output")
    return cut_off.select(F.col("key").alias("run_id")).distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each harness cuts its outputs."""
    return truncation.cut_rates(table(spark, sf_dir, "agent_runs"), "run_id", "harness", "harness_result.final_output")


def p6_latency_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage and day, and over all days (run_day null), from merged sketches of the days."""
    cells = table(spark, sf_dir, "stage_cells")
    days = percentiles.sketches(cells, ["stage_name", "run_day"], F.col("metadata.latency_ms"), "cell_id")
    days = cut(days)
    whole = percentiles.merge(days, ["stage_name"]).withColumn("run_day", F.lit(None).cast("date"))
    return percentiles.percentiles(days.unionByName(whole))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = table(spark, sf_dir, "containers")
    return packing.report(packing.pack(table(spark, sf_dir, "documents"), containers), containers)


def _sources(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(source_name("source"), F.lit("")).alias("source"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the windows are to the corpus' proportions, and how near whole texts let them be."""
    documents, containers = table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers")
    packed = cut(packing.pack(documents, containers))
    return packing.mixture(packed, _sources(documents), containers)


def p8_target_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the selection that has mix_targets' shares, each document packed as often as it is used."""
    documents, containers, targets = (table(spark, sf_dir, n) for n in ("documents", "containers", "mix_targets"))
    chosen = mixing.select(documents, targets)
    uses = chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "uses"))).drop("col")
    packed = cut(packing.pack_sized(uses, containers, targets))
    return packing.mixture(packed, chosen.select("doc_id", "source").distinct(), containers, targets)


def p9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.select(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.classify(*(table(spark, sf_dir, n) for n in ("documents", "subject_examples", "subjects"))).distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are about each subject."""
    return subjects.composition(p10_found(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p4_found, p4_rates, p6_latency_by_day, p8_packed, p8_fill, p8_mixture, p8_target_mixture, p9_selected, p9_shares, p10_found, p10_composition)}
ORACLE: dict[str, str] = {}
