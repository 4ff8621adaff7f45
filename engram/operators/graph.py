"""Roots of a query and their neighbourhood, bounded or whole, in the relation graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.exprs import lexical_match, relation_boost
from engram.operators.ranks import numbered
from engram.operators.retrieve import layers_of, retrieve, selected, selection_confidence
from engram.operators.store import entity_terms, find_by_term
from engram.operators.trust import Trust, allows, visible
from engram.plans.staging import stage

# What a match adds to a root's score.
CANONICAL, ALIAS, TYPE, MENTION, MENTION_ALIAS, LINKED, LINKED_ALIAS = 100, 75, 15, 30, 20, 60, 45
OVERFETCH = 3


@dataclass(frozen=True)
class Limits:
    """``nodes`` or ``edges`` None: no limit."""

    roots: int = 10
    nodes: int | None = 25
    edges: int | None = 100
    hops: int = 1


def entity_boost(query: Column) -> Column:
    """Of an entity's own names: canonical_name, aliases (strings) and types."""
    any_ = lambda c: F.coalesce(F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda v: lexical_match(v, query)), F.lit(False))
    return (
        F.when(lexical_match(F.col("canonical_name"), query), CANONICAL).otherwise(0)
        + F.when(any_("aliases"), ALIAS).otherwise(0)
        + F.when(any_("types"), TYPE).otherwise(0)
    )


def mention_boost(mentions: Column, query: Column) -> Column:
    """Of an interpretation's mentions (surface, aliases): aliases add and the scan goes on, a surface adds and ends it."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("over"))

    def step(acc: Column, m: Column) -> Column:
        hit = lexical_match(m["surface"], query)
        alias = F.coalesce(F.exists(F.coalesce(m["aliases"], F.array().cast("array<string>")), lambda v: lexical_match(v, query)), F.lit(False))
        add = F.when(acc["over"], 0).when(hit, MENTION).when(alias, MENTION_ALIAS).otherwise(0)
        return F.struct((acc["sum"] + add).alias("sum"), (acc["over"] | hit).alias("over"))

    return F.coalesce(F.aggregate(mentions, zero, step)["sum"], F.lit(0))


def linked_boost(relations: DataFrame, entities: DataFrame, query: Column, trust: Trust | None = None) -> DataFrame:
    """(id, linked): for each source, what its edges to matching entities add; only entities seen in full count."""
    e = (entities if trust is None else entities.where(allows(trust))).select(
        F.col("id").alias("target_id"),
        lexical_match(F.col("canonical_name"), query).alias("by_name"),
        F.coalesce(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda v: lexical_match(v, query)), F.lit(False)).alias("by_alias"),
    ).where(F.col("by_name") | F.col("by_alias"))
    b = relation_boost(F.col("predicate"))
    add = F.when(F.col("by_name"), LINKED + b).otherwise(0) + F.when(F.col("by_alias"), LINKED_ALIAS + b).otherwise(0)
    return relations.join(e, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.sum(add).alias("linked"))


def rank_roots(base: DataFrame, boosts: DataFrame, limit: int) -> DataFrame:
    """The roots: base (id, place from 0) scored N - place + boost; ties keep their place."""
    n = base.agg(F.count("*").alias("n"))
    scored = base.join(boosts, "id", "left").join(F.broadcast(n)).withColumn("score", F.col("n") - F.col("place") + F.coalesce("boost", F.lit(0)))
    top = scored.orderBy(F.desc("score"), "place").limit(limit)
    return top.withColumn("root_rank", F.row_number().over(Window.orderBy(F.desc("score"), "place")) - 1).drop("n")


def expand(roots: DataFrame, relations: DataFrame, records: DataFrame, trust: Trust | None, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around roots (id, root_rank): breadth first, by rank and edge order, within the limits.

    nodes: id, hop, place, root; edges: source_id, predicate, target_id, weight, place. The first new visible targets
    of a hop, in order, are admitted while there is room; edges to admitted nodes are kept, each once, until the edge
    limit. Both are top-k cuts, so a node with any number of edges stays spread over its tasks; what is broadcast and
    numbered is bounded by the limits. Without a limit on nodes or edges (None) nothing is cut there, no broadcast is
    asked for, and edges are numbered by ranges. Only counts reach the driver.
    """
    small = F.broadcast if limits.nodes is not None and limits.edges is not None else lambda df: df
    key = ["source_id", "predicate", "target_id"]
    place = ["from_place", "seq", "predicate", "target_id"]
    seen = visible(records, trust).select(F.col("id").alias("target_id"))
    nodes = stage(
        (roots if limits.nodes is None else roots.orderBy("root_rank").limit(limits.nodes)).select("id", F.lit(0).alias("hop"), F.col("root_rank").cast("long").alias("place"), F.lit(True).alias("root"))
    )
    edges = None
    frontier, n_nodes, n_edges = nodes, nodes.count(), 0
    for hop in range(1, limits.hops + 1):
        if limits.edges is not None and n_edges >= limits.edges:
            break
        out = relations.join(small(frontier.select(F.col("id").alias("source_id"), F.col("place").alias("from_place"))), "source_id")
        out = out.groupBy(*key).agg(F.min(F.struct("from_place", "seq", "weight")).alias("m")).select(*key, "m.from_place", "m.seq", "m.weight")
        if edges is not None:
            out = out.join(small(edges.select(*key)), key, "left_anti")
        known = nodes.select(F.col("id").alias("target_id"))
        new = out.join(small(known), "target_id", "left_anti").join(seen, "target_id", "left_semi")
        first = new.groupBy("target_id").agg(F.min(F.struct("from_place", "seq", "predicate")).alias("first"))
        admitted = first if limits.nodes is None else first.orderBy("first", "target_id").limit(max(0, limits.nodes - n_nodes))
        admitted = stage(admitted.select("target_id"))
        kept = out.join(small(known.unionByName(admitted)), "target_id", "left_semi")
        if limits.edges is None:
            kept = stage(numbered(kept, place, "place", start=n_edges + 1))
        else:
            kept = kept.orderBy(*place).limit(limits.edges - n_edges)
            kept = stage(kept.withColumn("place", (F.row_number().over(Window.orderBy(*place)) + n_edges).cast("long")))
        step = kept.select(*key, "weight", "place")
        edges = step if edges is None else edges.unionByName(step)
        frontier = stage(
            kept.join(small(admitted), "target_id", "left_semi")
            .groupBy(F.col("target_id").alias("id"))
            .agg(F.min("place").alias("place"))
            .select("id", F.lit(hop).alias("hop"), "place", F.lit(False).alias("root"))
        )
        k, m = frontier.count(), kept.count()
        nodes, n_nodes, n_edges = nodes.unionByName(frontier), n_nodes + k, n_edges + m
        if not k:
            break
    if edges is None:
        edges = relations.where(F.lit(False)).select("source_id", "predicate", "target_id", "weight", F.lit(0).cast("long").alias("place"))
    return nodes, edges


def order_nodes(nodes: DataFrame, records: DataFrame, trust: Trust | None, by: str = "salience") -> DataFrame:
    """What a context may see of the nodes: roots first, then by hop, salience and id, or (``by`` 'id') by hop and id."""
    order = [F.desc("salience")] if by == "salience" else []
    return nodes.join(visible(records, trust), "id").orderBy(F.desc("root"), "hop", *order, "id")


@dataclass(frozen=True)
class Found:
    """nodes with root and hop, edges, roots (id, root_rank), and the selection among procedures (one row)."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    selection: DataFrame


def entity_roots(entities: DataFrame, trust: Trust, query: str, limit: int) -> DataFrame:
    """(id, place): the entities that a query names, scope by scope of the context (none: those without a scope)."""
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, query, s) for i, s in enumerate(trust.scopes or ("",))], "query_id int, term string, scope string")
    hits = find_by_term(entity_terms(entities.select(F.col("id").alias("entity_id"), "scope", "canonical_name", F.transform("aliases", lambda a: F.struct(a.alias("value"))).alias("aliases"))), asked, limit)
    return hits.groupBy(F.col("entity_id").alias("id")).agg(F.min(F.struct("query_id", "rank")).alias("place"))


def boosts(records: DataFrame, relations: DataFrame, entities: DataFrame, mentions: DataFrame, query: str, trust: Trust | None) -> DataFrame:
    """(id, boost) of the given records: by their own names, by what they mention, and by the entities they are linked to."""
    q, zero, asked = F.lit(query), F.lit(0), records.select("id")
    own = entities.join(asked, "id", "left_semi").select("id", entity_boost(q).alias("own"))
    said = mentions.join(asked, "id", "left_semi").select("id", mention_boost(F.col("mentions"), q).alias("said"))
    near = relations.join(records.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    linked = linked_boost(near, entities, q, trust)
    out = records.select("id").join(own, "id", "left").join(said, "id", "left").join(linked, "id", "left")
    return out.select("id", (F.coalesce("own", zero) + F.coalesce("said", zero) + F.coalesce("linked", zero)).alias("boost"))


def retrieve_graph(
    records: DataFrame, relations: DataFrame, entities: DataFrame, mentions: DataFrame, trust: Trust, as_of: Column, query: str = "", limits: Limits = Limits(),
    min_salience: float = 0, types: Sequence[str] = (), embeddings: DataFrame | None = None, vector: Sequence[float] | None = None, threshold: float = 0.7,
) -> Found:
    """The records of a request and the entities it names, reranked by what matches the query, with their neighbourhood.

    ``records``: all record types, entities too; ``entities``: id, canonical_name, aliases and types (strings), scope,
    sensitivity; ``mentions``: id, mentions (surface, aliases) of the records' interpretations. Redacted records get no
    boost, and only entities seen in full give one. Without a query the order of ``retrieve`` stays.
    """
    found = retrieve(records, trust, as_of, query, limits.roots * OVERFETCH, min_salience, types, embeddings, vector)
    top = [F.col("band"), F.desc("order_key"), F.col("id")]
    once = Window.partitionBy("id").orderBy("place")
    base = found.withColumn("place", F.row_number().over(Window.orderBy(*top)) - 1).select("id", "redacted", "place")  # a few rows, see the limit
    base = base.withColumn("n", F.row_number().over(once)).where(F.col("n") == 1).select("id", "redacted", F.struct(F.lit(0).alias("a"), F.col("place").alias("b"), F.lit(0).alias("c")).alias("place"))
    if query.strip() and "entity" in layers_of(types):
        named = entity_roots(entities, trust, query, limits.roots).join(visible(records, trust).select("id", "redacted"), "id").join(base.select("id"), "id", "left_anti")
        base = base.unionByName(named.select("id", "redacted", F.struct(F.lit(1).alias("a"), F.col("place.query_id").alias("b"), F.col("place.rank").alias("c")).alias("place")))
    base = stage(base.withColumn("place", F.row_number().over(Window.orderBy("place")) - 1))  # at most (3 + scopes) times the roots
    extra = boosts(base.where(~F.col("redacted")), relations, entities, mentions, query, trust) if query else base.select("id", F.lit(0).alias("boost"))
    roots = stage(rank_roots(base.select("id", "place"), extra, limits.roots))
    nodes, edges = expand(roots, relations, records, trust, limits)
    picks = selected(visible(records, trust).where(F.col("type").isin(*layers_of(types)) & (F.col("salience") >= min_salience)), as_of, embeddings, vector)
    return Found(order_nodes(nodes, records, trust), edges.orderBy("place"), roots.select("id", "root_rank"), selection_confidence(picks, threshold))
