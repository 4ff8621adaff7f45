"""The test tables as the model's relations, once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.exprs import half_life
from engram.functions.text import norm_id
from engram.sources.tables import newest, table

AS_OF = "2025-07-01 00:00:00"
DIGITS = "0123456789abcdef"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def digit(c: str = "id") -> Column:
    """A number from 0 to 15 that an id carries: its last hexadecimal digit (-1 if it has none)."""
    return F.expr(f"locate(right({c}, 1), '{DIGITS}') - 1")


def rec(spark: SparkSession, d: str) -> DataFrame:
    """Records: one row for each id, with a lifecycle made from type and id."""
    cols = ["type", "sensitivity", "confidence", "salience", "scope", "tags", "created_at", "updated_at", "deleted_at"]
    rows = newest(table(spark, d, "memory_records"), norm_id("id"), ["ingested_at"], cols, "id")
    return rows.withColumns(
        {
            "scope": F.coalesce("scope", F.lit("")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "last_reinforced_at": F.col("updated_at"),
            "half_life_seconds": half_life(F.col("type")).cast("long") * 100,
            "min_salience": F.when(digit() % 4 == 0, 0.05).otherwise(0.0),
            "max_age_seconds": F.when(digit() == 5, 8_640_000).otherwise(0).cast("long"),
            "reinforcement_gain": F.lit(0.1),
            "pinned": digit() == 7,
            "deletion_policy": F.when(digit() % 3 == 2, "manual_only").otherwise("auto_prune"),
            "success_count": digit() % 7,
            "failure_count": digit() % 3,
            "failure_rate": F.lit(None).cast("double"),
            "has_payload": digit() != 9,
        }
    )


def fact(spark: SparkSession, d: str) -> DataFrame:
    """Facts: the latest row of each record."""
    cols = ["subject", "predicate", "object", "status", "supersedes", "superseded_by", "confidence"]
    return newest(table(spark, d, "semantic_facts"), norm_id("record_id"), ["updated_at"], cols, "id")


def ent(spark: SparkSession, d: str) -> DataFrame:
    return newest(
        table(spark, d, "entities"), norm_id("entity_id"), [], ["canonical_name", "primary_type", "types", "aliases", "identifiers", "scope", "created_at"], "entity_id"
    )


def line(spark: SparkSession, d: str) -> DataFrame:
    """Timeline events: one row for each (record, pos)."""
    rows = table(spark, d, "timeline_events").select(norm_id("record_id").alias("id"), "pos", "ingested_at", "t", "event_kind", "ref", "summary", "scope")
    best = rows.groupBy("id", "pos").agg(F.max(F.struct("ingested_at", "t", "event_kind", "ref", "summary", "scope")).alias("b"))
    return best.select("id", "pos", "b.t", "b.event_kind", "b.ref", "b.summary", "b.scope")


def node(spark: SparkSession, d: str) -> DataFrame:
    """Tool nodes: one row for each (record, node)."""
    rows = table(spark, d, "tool_nodes").select(norm_id("record_id").alias("id"), "node_id", "called_at", "tool", F.coalesce("depends_on", F.array().cast("array<string>")).alias("deps"))
    return rows.groupBy("id", "node_id").agg(F.max(F.struct("called_at", "tool", "deps")).alias("b")).select("id", "node_id", "b.called_at", "b.tool", "b.deps")


def mention(spark: SparkSession, d: str) -> DataFrame:
    cols = ["record_id", "pos", "surface", "entity_kind", "canonical_entity_id", "confidence", "aliases"]
    return newest(table(spark, d, "mentions"), F.col("mention_id"), [], cols, "mention_id").select(
        "mention_id", norm_id("record_id").alias("id"), "pos", "surface", "entity_kind", norm_id("canonical_entity_id").alias("entity_id"), "confidence", "aliases"
    )


def named(spark: SparkSession, d: str) -> DataFrame:
    """Entities as the graph operators take them."""
    e = ent(spark, d)
    return e.select(F.col("entity_id").alias("id"), "canonical_name", F.col("aliases.value").alias("aliases"), "types", F.coalesce("scope", F.lit("")).alias("scope"), F.lit("low").alias("sensitivity"))


def everything(spark: SparkSession, d: str) -> DataFrame:
    """Records of all types: ``rec``, and the entities as records."""
    e = named(spark, d).select("id", F.lit("entity").alias("type"), "sensitivity", F.lit(1.0).alias("confidence"), F.lit(0.5).alias("salience"), "scope", F.lit(True).alias("has_payload"))
    return rec(spark, d).unionByName(e, allowMissingColumns=True)


_DIGIT = f"(strpos('{DIGITS}', right(id, 1)) - 1)"
_NORM = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_LAST = "row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"

CTES = {
    "rec": f"""rec0 AS (SELECT {_NORM.format('id')} AS id, type, sensitivity, confidence, salience, coalesce(scope, '') AS scope, coalesce(tags, []) AS tags,
        created_at, updated_at, updated_at AS last_reinforced_at FROM memory_records
        QUALIFY {_LAST.format(key=_NORM.format('id'), order='ingested_at DESC NULLS LAST')}),
    rec AS (SELECT *, 100 * CASE type WHEN 'episodic' THEN 3600 WHEN 'working' THEN 86400 ELSE 2592000 END AS half_life_seconds,
        CASE WHEN {_DIGIT} % 4 = 0 THEN 0.05 ELSE 0.0 END::DOUBLE AS min_salience, CASE WHEN {_DIGIT} = 5 THEN 8640000 ELSE 0 END AS max_age_seconds,
        {_DIGIT} = 7 AS pinned, CASE WHEN {_DIGIT} % 3 = 2 THEN 'manual_only' ELSE 'auto_prune' END AS deletion_policy,
        {_DIGIT} % 7 AS success_count, {_DIGIT} % 3 AS failure_count, {_DIGIT} <> 9 AS has_payload, {_DIGIT} AS digit,
        CASE sensitivity WHEN 'public' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'hyper' THEN 4 ELSE -1 END AS rank,
        TIMESTAMPTZ '{AS_OF}+00' AS as_of FROM rec0)""",
    "fact": f"""fact AS (SELECT {_NORM.format('record_id')} AS id, subject, predicate, object, status, supersedes, superseded_by, confidence FROM semantic_facts
        QUALIFY {_LAST.format(key=_NORM.format('record_id'), order='updated_at DESC NULLS LAST')})""",
    "ent": f"""ent AS (SELECT {_NORM.format('entity_id')} AS entity_id, canonical_name, primary_type, types, aliases, identifiers, coalesce(scope, '') AS scope FROM entities)""",
    "line": f"""line AS (SELECT {_NORM.format('record_id')} AS id, pos, t, event_kind, ref, summary FROM timeline_events
        QUALIFY {_LAST.format(key=_NORM.format('record_id') + ', pos', order='ingested_at DESC NULLS LAST')})""",
    "node": f"""node AS (SELECT {_NORM.format('record_id')} AS id, node_id, tool, coalesce(depends_on, []) AS deps FROM tool_nodes
        QUALIFY {_LAST.format(key=_NORM.format('record_id') + ', node_id', order='called_at DESC NULLS LAST')})""",
    "mention": f"""mention AS (SELECT mention_id, {_NORM.format('record_id')} AS id, pos, surface, entity_kind, {_NORM.format('canonical_entity_id')} AS entity_id, confidence, aliases FROM mentions
        QUALIFY {_LAST.format(key='mention_id', order='surface DESC NULLS LAST')})""",
}


def sql(names: str, body: str, **more: str) -> str:
    """A query over the named views and further expressions."""
    parts = [CTES[n] for n in names.split()] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
