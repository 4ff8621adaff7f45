"""Readers and writers beside plain tables, the JSON codec of records, settings and request limits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.exprs import SENSITIVITIES, TYPES
from engram.operators.store import Invalid

RECALL = (
    "type string, key string, memory_type string, text string, sensitivity string, scope string, tags array<string>, subject string, predicate string, object string, "
    "event_kind string, ref string, summary string, thread_id string, state string, next_actions array<string>, skill_name string, triggers array<string>, steps array<string>, "
    "intent string, nodes array<struct<id:string,op:string>>, edges array<struct<from:string,to:string>>, expected array<string>, k long, "
    "trust struct<max_sensitivity:string,authenticated:boolean,actor_id:string,scopes:array<string>>, min_salience double, memory_types array<string>"
)
# What a request may hold.
MAX_STRING, MAX_TAGS, MAX_TAG, MAX_PAYLOAD, MAX_LIMIT = 100_000, 100, 256, 10_000_000, 10_000
DEFAULT_K = 5


def recall_set(spark: SparkSession, path: str, default_k: int = DEFAULT_K) -> tuple[DataFrame, DataFrame]:
    """(records, queries) of a JSON-lines evaluation set; unknown line types are refused, k 0 or absent is the default."""
    lines = spark.read.schema(RECALL).json(path)
    other = lines.where(F.col("type").isNull() | ~F.col("type").isin("record", "query")).select("type").first()
    if other is not None:
        raise Invalid(f"unknown type {other['type']!r}")
    k = F.when(F.coalesce("k", F.lit(0)) > 0, F.col("k")).otherwise(default_k)
    return lines.where(F.col("type") == "record"), lines.where(F.col("type") == "query").withColumn("k", k)


def from_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational store, read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.options(**options).load()


def ranges(key: str, cuts: Sequence[str]) -> list[str]:
    """Conditions that cut the values of a text key into disjoint ranges, nulls in the first."""
    q = ["'" + c.replace("'", "''") + "'" for c in sorted(set(cuts))]
    if not q:
        return ["1 = 1"]
    return [f"({key} < {q[0]} OR {key} IS NULL)", *[f"({key} >= {a} AND {key} < {b})" for a, b in zip(q, q[1:])], f"({key} >= {q[-1]})"]


def from_jdbc_text(spark: SparkSession, url: str, name: str, key: str, cuts: Sequence[str], **options: str) -> DataFrame:
    """A table of a relational store with a text key, read in the ranges between ``cuts`` (as 0..f for hexadecimal ids)."""
    return spark.read.jdbc(url, name, predicates=ranges(key, cuts), properties=options)


def to_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", parts: int = 8, **options: str) -> None:
    """Rows into a table of a relational store, over ``parts`` connections."""
    df.coalesce(parts).write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def to_json(records: DataFrame) -> DataFrame:
    """(id, json): records with the payload as a nested object instead of a text."""
    cols = [c for c in records.columns if c != "payload_json"]
    body = F.to_json(F.struct(*cols))
    payload = F.coalesce("payload_json", F.lit("null"))
    return records.select("id", F.concat(F.substring(body, 1, F.length(body) - 1), F.lit(',"payload":'), payload, F.lit("}")).alias("json"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    """Records from their JSON; an unknown payload kind is a null payload, not an error."""
    kind = F.get_json_object("json", "$.payload.kind")
    payload = F.when(kind.isin(*TYPES), F.get_json_object("json", "$.payload"))
    return lines.select(F.from_json("json", schema).alias("r"), payload.alias("payload_json")).select("r.*", "payload_json")


def vector_text(c: Column) -> Column:
    """A vector as '[a,b]'."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


@dataclass(frozen=True)
class Settings:
    """Defaults, overlaid by a mapping or a YAML file."""

    decay_interval_s: int = 3600
    consolidation_interval_s: int = 21_600
    default_sensitivity: str = "low"
    selection_threshold: float = 0.7
    embedding_dimensions: int = 1536
    rate_limit_per_second: int = 100
    graph_roots: int = 10
    graph_nodes: int = 25
    graph_edges: int = 100
    graph_hops: int = 1
    tokenizers: str = "/opt/tokenizers"

    @classmethod
    def load(cls, given: dict | None = None, path: str | None = None) -> Settings:
        values = dict(given or {})
        if path:
            import yaml  # optional

            with open(path) as f:
                values = (yaml.safe_load(f) or {}) | values
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise Invalid(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **values)

    def hops(self, asked: int) -> int:
        """0 asks for the default, less for none."""
        return self.graph_hops if asked == 0 else max(asked, 0)


def check_capture(request: dict) -> None:
    """Refuse a capture request beyond the limits."""
    for k, v in request.items():
        if isinstance(v, str) and len(v.encode()) > (MAX_PAYLOAD if k in ("content", "context") else MAX_STRING):
            raise Invalid(f"{k} is too long")
    tags = request.get("tags") or []
    if len(tags) > MAX_TAGS or any(len(t.encode()) > MAX_TAG for t in tags):
        raise Invalid("too many or too long tags")
    if request.get("sensitivity") and request["sensitivity"] not in SENSITIVITIES:
        raise Invalid("unknown sensitivity")
    if request.get("proposed_type") and request["proposed_type"] not in TYPES:
        raise Invalid("unknown memory type")


def check_retrieve(max_sensitivity: str, limit: int = 0, min_salience: float = 0, hops: int = 0, types: tuple[str, ...] = ()) -> None:
    """Refuse a retrieval request beyond the limits."""
    if max_sensitivity not in SENSITIVITIES:
        raise Invalid("max_sensitivity is required")
    if not 0 <= limit <= MAX_LIMIT or not -1 <= hops <= MAX_LIMIT:
        raise Invalid("limits must be within 0 and 10000")
    if not math.isfinite(min_salience) or min_salience < 0:
        raise Invalid("min_salience must be finite and not negative")
    if any(t not in TYPES for t in types):
        raise Invalid("unknown memory type")


def check_penalty(amount: float) -> None:
    if not math.isfinite(amount) or amount < 0:
        raise Invalid("amount must be finite and not negative")
