"""Queries of the general data-preparation operators: nested payloads (p2) and timestamps (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.nested import flatten_nested
from galley.operators.timestamps import normalize
from galley.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every object below the root of an output's payload: output_id, node_path, parent_path."""
    nodes = flatten_nested(table(spark, root, "agent_outputs"), "id", "payload", with_body=False)
    return nodes.select("output_id", "node_path", "parent_path")


def p2_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The flat node table with its links: numbers of node and parent, depth, field and list position."""
    nodes = flatten_nested(table(spark, root, "agent_outputs"), "id", "payload")
    return nodes.select("output_id", "node_no", "parent_no", "depth", "field", "list_index", F.length("body").alias("body_chars"))


def p2_tables(spark: SparkSession, root: str) -> DataFrame:
    """The flat tables the payloads give: kind of output, table (path without positions), rows, and parents they hang on."""
    nodes = flatten_nested(table(spark, root, "agent_outputs"), "id", "payload", with_body=False, carried=("kind",))
    x = nodes.withColumn("table_name", F.regexp_replace("node_path", r"\[\d+\]", ""))
    # a parent is one (output, parent number): rows are first counted by it
    per = x.groupBy("kind", "table_name", "output_id", "parent_no").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind", "table_name").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_parents"), F.max("n").alias("most_children"))


def _times(spark: SparkSession, root: str) -> DataFrame:
    registry = table(spark, root, "sender_registry")
    emails = table(spark, root, "emails").select(F.lit("emails").alias("src"), "message_id", "received_at", "sender", F.col("created_at").alias("taken_at"))
    taken = emails.groupBy("message_id").agg(F.min("taken_at").alias("taken_at"))
    messages = table(spark, root, "messages").select(F.lit("messages").alias("src"), "message_id", "received_at", "sender").join(taken, "message_id", "left")
    both = emails.unionByName(messages.select(emails.columns))
    return normalize(both, "received_at", "sender", registry, "taken_at")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Every readable time as one instant: src, message_id, utc_us, each triple once."""
    return _times(spark, root).where(F.col("utc_us").isNotNull()).select("src", "message_id", "utc_us").distinct()


def p3_readings(spark: SparkSession, root: str) -> DataFrame:
    """How the texts were read: rows, unreadable and ambiguous ones by source table and reading."""
    x = _times(spark, root).withColumn("reading", F.coalesce("reading", F.lit("none")))
    return x.groupBy("src", "reading").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("utc_us").alias("n_instants"),
        F.sum(F.col("ambiguous").cast("int")).alias("n_ambiguous"),
    )


QUERIES = {"p2_found": p2_found, "p2_nodes": p2_nodes, "p2_tables": p2_tables, "p3_found": p3_found, "p3_readings": p3_readings}

# Payloads without what is around them: twice, as a fence may stand in a string and a string in a fence.
_TRIM = r"regexp_replace({0}, '^[\s\x{{feff}}]+|[\s\x{{feff}}]+$', '', 'g')"
_PEEL = r"""CASE WHEN regexp_matches({0}, '(?s)^```[A-Za-z0-9]*\s*.*?\s*```$') THEN regexp_extract({0}, '(?s)^```[A-Za-z0-9]*\s*(.*?)\s*```$', 1) WHEN starts_with({0}, '"') AND json_valid({0}) THEN json_extract_string({0}, '$') ELSE {0} END"""
ORACLE = {
    "p2_found": f"""WITH a AS (SELECT id, {_TRIM.format("payload")} AS p FROM agent_outputs), b AS (SELECT id, {_TRIM.format(_PEEL.format("p"))} AS p FROM a), c AS (SELECT id, {_TRIM.format(_PEEL.format("p"))} AS p FROM b),
        j AS (SELECT id, CASE WHEN json_valid(p) THEN p END AS p FROM c), t AS (SELECT j.id, regexp_replace(x.fullkey, '^\\$\\.?', '') AS node_path FROM j, json_tree(j.p::JSON) x WHERE j.p IS NOT NULL AND x.type = 'OBJECT' AND x.fullkey <> '$')
        SELECT id AS output_id, node_path, regexp_replace(node_path, '(\\.?[^.\\[\\]]+)?(\\[\\d+\\])*$', '') AS parent_path FROM t""",
}
