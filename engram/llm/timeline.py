"""The timelines and tool graphs of episodes in canonical form, one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import norm, norm_id

#: Words that introduce the counter of an attempt at the end of a reference.
ATTEMPT = r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]*(?:retry|retries|attempt|try|tries)[^\p{L}\p{N}]*\p{N}+[^\p{L}\p{N}]*$"


def kind_key(c: Column | str) -> Column:
    """A kind in lower case, trimmed, '-' and blanks as '_'; null where blank."""
    return F.nullif(F.regexp_replace(norm(c), r"[-\s]", "_"), F.lit(""))


def ref_key(c: Column | str) -> Column:
    """A reference without case, blanks, separators and the attempt's counter; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(norm(c), ATTEMPT, ""), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def events(df: DataFrame, refs: bool = True) -> DataFrame:
    """(rid, record_id, pos, t, kind, ref) of timeline rows, one for each (record_id, pos): the one ingested last.

    Rows without record_id or pos have no key and drop out; kind and ref are canonical. Without ``refs`` there are
    only rid, pos, t and kind, and less is moved.
    """
    cols = ["ingested_at", "t", "event_kind", *(["ref", "record_id"] if refs else [])]
    rows = (
        df.select(norm_id("record_id").alias("rid"), "pos", *cols)
        .where(F.col("rid").isNotNull() & F.col("pos").isNotNull())
        .groupBy("rid", "pos")
        .agg(F.max(F.struct(*cols)).alias("b"))
    )
    more = [F.col("b.record_id").alias("record_id"), ref_key("b.ref").alias("ref")] if refs else []
    return rows.select("rid", "pos", F.col("b.t").alias("t"), kind_key("b.event_kind").alias("kind"), *more)


def tool_nodes(df: DataFrame) -> DataFrame:
    """(rid, node, tool, deps) of tool nodes, one for each (record_id, node_id): the one called last."""
    best = F.max(F.struct("called_at", "tool", "depends_on")).alias("b")
    deps = F.filter(F.transform(F.coalesce("b.depends_on", F.array().cast("array<string>")), norm_id), lambda x: x.isNotNull())
    return (
        df.select(norm_id("record_id").alias("rid"), norm_id("node_id").alias("node"), "called_at", "tool", "depends_on")
        .where(F.col("rid").isNotNull() & F.col("node").isNotNull())
        .groupBy("rid", "node")
        .agg(best)
        .select("rid", "node", F.nullif(norm("b.tool"), F.lit("")).alias("tool"), F.array_distinct(deps).alias("deps"))
    )
