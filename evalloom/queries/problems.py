"""Queries of the general data problems (nested records, drifting schemas, unreadable rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested, quarantine, schema_drift
from ..session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.links(nested.flatten(table(spark, sf_dir, "agent_runs"), ["run_id"], nested.AGENT_RUNS), ["run_id"])


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables themselves, in long form."""
    return nested.tables(nested.flatten(table(spark, sf_dir, "agent_runs"), ["run_id"], nested.AGENT_RUNS), ["run_id"])


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(nested.flatten(table(spark, sf_dir, "agent_runs"), ["run_id"], nested.AGENT_RUNS), ["run_id"])


def p1_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related flat tables and their columns."""
    return nested.table_columns(_nodes(spark, sf_dir))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the flat tables with its typed columns: the turns of the simulations."""
    return nested.relational(cut(_nodes(spark, sf_dir)), ["run_id"])["simulator_result.turns*"]


def p1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table below it, whose parent_path is the turn's node_path."""
    return nested.relational(cut(_nodes(spark, sf_dir)), ["run_id"])["simulator_result.turns*.request.messages*"]


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All field changes, with a field that went from one parent to another as one move."""
    return schema_drift.changes_with_moves(table(spark, sf_dir, "schema_sidecars"), table(spark, sf_dir, "stage_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.field_changes(table(spark, sf_dir, "schema_sidecars"), table(spark, sf_dir, "stage_records"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all files in one consistent schema per stage table."""
    return schema_drift.consistent_table(table(spark, sf_dir, "schema_sidecars"), table(spark, sf_dir, "stage_records"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.bad_rows(*(table(spark, sf_dir, n) for n in ("raw_lines", "scores", "metadata_cases")))


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of the three tables, loaded; fields as JSON."""
    return quarantine.load_all(*(table(spark, sf_dir, n) for n in ("raw_lines", "scores", "metadata_cases")))


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_schema, p1_turns, p1_messages, p5_found, p5_changes, p5_table, p7_found, p7_loaded)}
ORACLE: dict[str, str] = {}
