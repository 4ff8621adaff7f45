"""Queries of the general data problems: orphan references, hierarchies, nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import norm_id
from engram.operators import flatten as fl
from engram.operators import hierarchy as hi
from engram.operators import references as rf
from engram.plans.staging import stage
from engram.sources.tables import newest, table

#: The top-level arrays of objects of the payload variants and of the interpretation.
PAYLOAD_ARRAYS = ("timeline", "tool_graph", "active_constraints", "evidence", "aliases", "identifiers", "triggers", "recipe", "nodes", "edges")
INTERPRETATION_ARRAYS = ("mentions", "relation_candidates", "reference_candidates")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The three reference fields with their status."""
    texts = table(spark, d, "interpretations")
    nodes = fl.flatten(
        texts, "record_id", "interpretation_json", "interpreted_at", INTERPRETATION_ARRAYS,
        tables=("relation_candidates[]", "reference_candidates[]"), carry_order=True,
    )
    relation = F.col("child_table") == "relation_candidates[]"
    target = F.when(relation, F.get_json_object("fields", "$.target_record_id")).otherwise(F.get_json_object("fields", "$.target_entity_id"))
    found = nodes.select(
        F.when(relation, "relation_candidates.target_record_id").otherwise("reference_candidates.target_entity_id").alias("ref_field"),
        F.when(relation, "memory_records").otherwise("entities").alias("parent_table"),
        "record_id",
        F.col("ordinal").alias("ref_pos"),
        target.alias("target"),
        F.col("interpreted_at").alias("ref_time"),
    ).where(norm_id("target").isNotNull())
    facts = newest(table(spark, d, "semantic_facts"), norm_id("record_id"), ["updated_at"], ["superseded_by", "record_id"], "norm_key")
    revised = facts.where(norm_id("superseded_by").isNotNull()).select(
        F.lit("revision.superseded_by").alias("ref_field"),
        F.lit("memory_records").alias("parent_table"),
        "record_id",
        F.lit(0).alias("ref_pos"),
        F.col("superseded_by").alias("target"),
        F.col("updated_at").alias("ref_time"),
    )
    refs = stage(found.unionByName(revised))
    parents = (
        table(spark, d, "memory_records")
        .select(F.lit("memory_records").alias("parent_table"), "id", F.col("ingested_at").alias("first_seen"), F.col("deleted_at").isNotNull().alias("deleted"))
        .unionByName(
            table(spark, d, "entities").select(
                F.lit("entities").alias("parent_table"), F.col("entity_id").alias("id"), F.col("created_at").alias("first_seen"), F.col("deleted_at").isNotNull().alias("deleted")
            )
        )
    )
    return rf.check_references(refs, parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference whose target is missing, deleted or later than the row that refers to it."""
    return _references(spark, d).where(F.col("status") != "ok").select("ref_field", "record_id", "ref_pos")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """References by field and month with their states."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return (
        _references(spark, d)
        .groupBy("ref_field", F.date_format("ref_time", "yyyy-MM").alias("period"))
        .agg(F.count("*").alias("refs"), count("missing"), count("deleted"), count("late"))
    )


def _revisions(spark: SparkSession, d: str, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """The facts by normalised id, and their tree."""
    facts = newest(table(spark, d, "semantic_facts"), norm_id("record_id"), ["updated_at"], ["supersedes", "superseded_by", "record_id"], "norm_key")
    facts = stage(facts.select("norm_key", "record_id", norm_id("supersedes").alias("older"), norm_id("superseded_by").alias("newer")))
    there = facts.select("norm_key")
    older = facts.where(F.col("older").isNotNull()).select(F.col("norm_key").alias("id"), F.col("older").alias("parent"), F.lit(0).alias("rank"))
    newer = facts.where(F.col("newer").isNotNull()).select(F.col("newer").alias("id"), F.col("norm_key").alias("parent"), F.lit(1).alias("rank"))
    links = older.join(there.select(F.col("norm_key").alias("parent")), "parent", "left_semi").unionByName(
        newer.join(there.select(F.col("norm_key").alias("id")), "id", "left_semi")
    )
    ends = links.select("id").unionByName(links.select(F.col("parent").alias("id")))  # also of links that one_parent drops
    return facts, hi.hierarchy(hi.one_parent(links), nodes=ends, paths=paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of each revised or revising fact; '' and -1 on a loop or below one."""
    facts, tree = _revisions(spark, d, paths=False)
    return tree.join(facts.select(F.col("norm_key").alias("id"), "record_id"), "id").select(
        "record_id", F.col("root_id").alias("root_key"), "depth"
    ).join(facts.select(F.col("norm_key").alias("root_key"), F.col("record_id").alias("root_name")), "root_key", "left").select(
        "record_id", F.coalesce("root_name", F.lit("")).alias("root_id"), "depth"
    )


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of each fact from its root, with the number of facts below it."""
    _, tree = _revisions(spark, d)
    return tree.select("id", "root_id", "depth", F.concat_ws(" > ", "path").alias("path"), F.greatest(F.col("size") - 1, F.lit(0)).alias("n_descendants"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each fact with each fact below it and their distance."""
    _, tree = _revisions(spark, d)
    return hi.descendants(tree)


def _sources(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [
        ("payloads", fl.flatten(table(spark, d, "payloads"), "record_id", "payload_json", "written_at", PAYLOAD_ARRAYS)),
        ("interpretations", fl.flatten(table(spark, d, "interpretations"), "record_id", "interpretation_json", "interpreted_at", INTERPRETATION_ARRAYS)),
    ]


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All child rows of payloads and interpretations with their surrogate keys, ordinals and fields."""
    return reduce(DataFrame.unionByName, [n.withColumn("source_table", F.lit(s)) for s, n in _sources(spark, d)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The path of every JSON object that is an element of an array."""
    return p5_nodes(spark, d).select("source_table", "record_id", "path")


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema: the type of each field of each array's objects."""
    rows = []
    for source, text, singles in (("payloads", "payload_json", PAYLOAD_ARRAYS), ("interpretations", "interpretation_json", INTERPRETATION_ARRAYS)):
        for name, fields in fl.infer_schema(table(spark, d, source), text, singles).items():
            rows += [(source, name, field, kind) for field, kind in fields.items()]
    return spark.createDataFrame(rows, "source_table string, child_table string, field string, type string")


def p5_tool_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One of the child tables with columns typed as the merged schema says: the nodes of the tool graphs."""
    texts = table(spark, d, "payloads")
    fields = fl.infer_schema(texts, "payload_json", PAYLOAD_ARRAYS).get("tool_graph[]", {})
    nodes = fl.flatten(texts, "record_id", "payload_json", "written_at", PAYLOAD_ARRAYS, tables=("tool_graph[]",))
    return fl.child_table(nodes, "tool_graph[]", {x: fields.get(x, "string") for x in ("id", "tool", "args", "result", "depends_on")})


def p5_unread(spark: SparkSession, d: str) -> DataFrame:
    """The records whose text holds none, with the reason."""
    ask = (("payloads", "payload_json", "written_at"), ("interpretations", "interpretation_json", "interpreted_at"))
    return reduce(DataFrame.unionByName, [fl.unread(table(spark, d, s), "record_id", text, at).withColumn("source_table", F.lit(s)) for s, text, at in ask])


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_paths, p4_descendants, p5_found, p5_nodes, p5_schema, p5_tool_nodes, p5_unread)}


# --- the same in SQL, by plainer means

_ID = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_UNIQUE = "row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC NULLS LAST) = 1"
_JSON = """SELECT id, record_id, ts, j FROM (SELECT id, record_id, ts, CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS j FROM
    (SELECT {key} AS id, record_id, {at} AS ts, {col} AS j FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC NULLS LAST) = 1)) WHERE id IS NOT NULL AND json_valid(j) AND json_type(j) = 'OBJECT'"""


def _items(field: str) -> str:
    return f"CASE json_type(j, '$.{field}') WHEN 'ARRAY' THEN json_extract(j, '$.{field}[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.{field}')] END"


def _tree(source: str, table_: str, col: str, at: str, names: tuple[str, ...]) -> str:
    lone = "|".join(names)
    return f"""SELECT '{source}' AS source_table, record_id, regexp_replace(substr(fullkey, 3), '^({lone})(\\.|$)', '\\1[0]\\2') AS path, type, value FROM
    ({_JSON.format(key=_ID.format('record_id'), at=at, col=col, table=table_)}) r, json_tree(r.j) t WHERE fullkey <> '$'"""


_TREE = f"""WITH RECURSIVE f AS (SELECT {_ID.format('record_id')} AS id, record_id, {_ID.format('supersedes')} AS older, {_ID.format('superseded_by')} AS newer FROM semantic_facts
      QUALIFY row_number() OVER (PARTITION BY {_ID.format('record_id')} ORDER BY updated_at DESC NULLS LAST) = 1),
    every AS (SELECT id, older AS parent, 0 AS rank FROM f WHERE older IN (SELECT id FROM f) UNION ALL SELECT newer, id, 1 FROM f WHERE newer IN (SELECT id FROM f)),
    links AS (SELECT id, first(parent ORDER BY rank, parent) AS parent FROM every GROUP BY id), nodes AS (SELECT id FROM every UNION SELECT parent FROM every),
    t(id, root, depth, path) AS (SELECT id, id, 0, id FROM nodes WHERE id NOT IN (SELECT id FROM links) UNION ALL SELECT l.id, t.root, t.depth + 1, t.path || ' > ' || l.id FROM t JOIN links l ON l.parent = t.id),
    below(id, descendant, distance) AS (SELECT l.parent, l.id, 1 FROM links l JOIN t ON t.id = l.parent UNION ALL SELECT l.parent, b.descendant, b.distance + 1 FROM below b JOIN links l ON l.id = b.id)"""

_REFS = f"""WITH i AS ({_JSON.format(key=_ID.format('record_id'), at='interpreted_at', col='interpretation_json', table='interpretations')}),
    e AS (SELECT 'relation_candidates.target_record_id' AS ref_field, 'm' AS tab, record_id, ts, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS ref_pos FROM (SELECT record_id, ts, {_items('relation_candidates')} AS l FROM i)
      UNION ALL SELECT 'reference_candidates.target_entity_id', 'e', record_id, ts, unnest(l), generate_subscripts(l, 1) - 1 FROM (SELECT record_id, ts, {_items('reference_candidates')} AS l FROM i)),
    refs AS (SELECT ref_field, tab, record_id, ts, ref_pos, json_extract_string(o, CASE tab WHEN 'm' THEN '$.target_record_id' ELSE '$.target_entity_id' END) AS target FROM e WHERE json_type(o) = 'OBJECT'
      UNION ALL SELECT 'revision.superseded_by', 'm', record_id, updated_at, 0, superseded_by FROM (SELECT * FROM semantic_facts QUALIFY row_number() OVER (PARTITION BY {_ID.format('record_id')} ORDER BY updated_at DESC NULLS LAST) = 1)),
    parents AS (SELECT 'm' AS tab, {_ID.format('id')} AS id, min(ingested_at) AS seen, max(deleted_at) AS gone FROM memory_records GROUP BY ALL UNION ALL SELECT 'e', {_ID.format('entity_id')}, min(created_at), max(deleted_at) FROM entities GROUP BY ALL),
    states AS (SELECT ref_field, record_id, ref_pos::INTEGER AS ref_pos, ts, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.gone IS NOT NULL THEN 'deleted' WHEN p.seen > r.ts THEN 'late' ELSE 'ok' END AS status
      FROM refs r LEFT JOIN parents p ON p.tab = r.tab AND p.id = {_ID.format('r.target')} WHERE {_ID.format('r.target')} IS NOT NULL)"""
_NODES = f"""nodes AS ({_tree('payloads', 'payloads', 'payload_json', 'written_at', PAYLOAD_ARRAYS)} UNION ALL {_tree('interpretations', 'interpretations', 'interpretation_json', 'interpreted_at', INTERPRETATION_ARRAYS)})"""
_KIND = "CASE {0} WHEN 'BIGINT' THEN 'long' WHEN 'UBIGINT' THEN 'long' WHEN 'HUGEINT' THEN 'double' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'json' END"

SQL = {
    "p2_found": f"{_REFS} SELECT ref_field, record_id, ref_pos FROM states WHERE status <> 'ok'",
    "p2_report": f"{_REFS} SELECT ref_field, strftime(ts, '%Y-%m') AS period, count(*) AS refs, count_if(status = 'missing') AS missing, count_if(status = 'deleted') AS deleted, count_if(status = 'late') AS late FROM states GROUP BY 1, 2",
    "p4_found": f"""{_TREE} SELECT f.record_id, coalesce(g.record_id, '') AS root_id, coalesce(t.depth, -1)::INTEGER AS depth FROM nodes n JOIN f USING (id) LEFT JOIN t USING (id) LEFT JOIN f g ON g.id = t.root""",
    "p4_paths": f"""{_TREE} SELECT n.id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1)::INTEGER AS depth, coalesce(t.path, '') AS path, coalesce(c.n, 0) AS n_descendants FROM nodes n LEFT JOIN t USING (id)
      LEFT JOIN (SELECT id, count(*) AS n FROM below GROUP BY 1) c USING (id)""",
    "p4_descendants": f"{_TREE} SELECT id, descendant, distance::INTEGER AS distance FROM below",
    "p5_found": f"WITH {_NODES} SELECT source_table, record_id, path FROM nodes WHERE type = 'OBJECT' AND path LIKE '%]'",
    "p5_nodes": f"""WITH {_NODES}, own AS (SELECT source_table, record_id, path, regexp_extract(path, '(\\d+)\\]$', 1)::INTEGER AS ordinal, value FROM nodes WHERE type = 'OBJECT' AND path LIKE '%]'),
    upper_ AS (SELECT *, regexp_replace(regexp_replace(path, '(\\[\\d+\\])+$', ''), '(^|\\.)[^\\]]*$', '') AS above FROM own)
    SELECT source_table, record_id, md5(record_id || chr(31) || path) AS row_id, md5(record_id || chr(31) || above) AS parent_id, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS child_table, path, ordinal, value::VARCHAR AS fields FROM upper_""",
    "p5_schema": f"""WITH {_NODES.replace(_UNIQUE, 'true')}, f AS (SELECT source_table, regexp_replace(regexp_replace(path, '\\.[^.\\[\\]]+$', ''), '\\[\\d+\\]', '[]', 'g') AS child_table, regexp_extract(path, '\\.([^.\\[\\]]+)$', 1) AS field, list(DISTINCT {_KIND.format('type')}) AS k
      FROM nodes WHERE regexp_matches(path, '\\]\\.[^.\\[\\]]+$') GROUP BY 1, 2, 3), g AS (SELECT source_table, child_table, field, list_filter(k, lambda x: x <> 'null') AS k FROM f)
    SELECT source_table, child_table, field, CASE WHEN len(k) = 1 THEN k[1] WHEN list_sort(k) = ['double', 'long'] THEN 'double' WHEN list_contains(k, 'json') THEN 'json' ELSE 'string' END AS type FROM g""",
    "p5_tool_nodes": f"""WITH {_NODES} SELECT record_id, md5(record_id || chr(31) || path) AS row_id, md5(record_id || chr(31)) AS parent_id, regexp_extract(path, '(\\d+)', 1)::INTEGER AS ordinal,
    {', '.join(f"json_extract_string(value, '$.{x}') AS f_{x}" for x in ('id', 'tool', 'args', 'result', 'depends_on'))} FROM nodes WHERE source_table = 'payloads' AND type = 'OBJECT' AND regexp_matches(path, '^tool_graph\\[\\d+\\]$')""",
    "p5_unread": "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{t}' AS source_table, record_id, CASE WHEN j IS NULL THEN 'null' WHEN regexp_matches(j, '^\\s*$') THEN 'blank' WHEN NOT json_valid(j) THEN 'not JSON' WHEN json_type(j) = 'OBJECT' THEN NULL
        WHEN json_type(j) <> 'VARCHAR' THEN 'no object' WHEN NOT json_valid(json_extract_string(j, '$')) THEN 'not JSON' WHEN json_type(json_extract_string(j, '$')) = 'OBJECT' THEN NULL ELSE 'no object' END AS reason
        FROM (SELECT record_id, {col} AS j FROM {t} WHERE {_ID.format('record_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_ID.format('record_id')} ORDER BY {at} DESC NULLS LAST) = 1)"""
        for t, col, at in (("payloads", "payload_json", "written_at"), ("interpretations", "interpretation_json", "interpreted_at"))
    ) + ") WHERE reason IS NOT NULL",
}
