"""Values of no fixed type, kept as JSON texts, and the small structs of the model, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.exprs import unique_folded
from engram.functions.text import norm, strip

# The payload variants' fields; untyped leaves stay JSON texts.
VARIANTS = {
    "episodic": (
        "timeline array<struct<t:timestamp,event_kind:string,ref:string,summary:string>>, tool_graph array<struct<id:string,tool:string,args:string,result:string,timestamp:timestamp,depends_on:array<string>>>, "
        "environment struct<os:string,os_version:string,tool_versions:map<string,string>,working_directory:string,context:map<string,string>>, outcome string, artifacts array<string>, tool_graph_ref string"
    ),
    "working": "thread_id string, state string, active_constraints array<struct<type:string,key:string,value:string,required:boolean>>, next_actions array<string>, open_questions array<string>, context_summary string",
    "semantic": (
        "subject string, predicate string, object string, validity struct<mode:string,conditions:map<string,string>,start:timestamp,end:timestamp>, "
        "evidence array<struct<source_type:string,source_id:string,timestamp:timestamp>>, revision_policy string, revision struct<supersedes:string,superseded_by:string,status:string>"
    ),
    "entity": "canonical_name string, primary_type string, types array<string>, aliases array<string>, identifiers array<struct<namespace:string,value:string>>, summary string",
    "competence": (
        "skill_name string, triggers array<struct<signal:string,conditions:string>>, recipe array<struct<step:string,tool:string,args_schema:string,validation:string>>, required_tools array<string>, failure_modes array<string>, "
        "fallbacks array<string>, performance struct<success_count:bigint,failure_count:bigint,success_rate:double,avg_latency_ms:double,last_used_at:timestamp>, version string"
    ),
    "plan_graph": (
        "plan_id string, version string, intent string, constraints string, inputs_schema string, outputs_schema string, nodes array<struct<id:string,op:string,params:string,guards:string>>, "
        "edges array<struct<from:string,to:string,kind:string>>, metrics struct<avg_latency_ms:double,failure_rate:double,execution_count:bigint,last_executed_at:timestamp>"
    ),
}
SOURCE_KINDS = ("event", "artifact", "tool_call", "observation", "outcome")
CURVES = ("exponential",)


def payload_of(payload_json: Column, kind: str) -> Column:
    """The payload as the variant's struct; null where it is of another or an unknown kind.

    An entity's aliases may be texts or objects with a value; both are read as the texts."""
    own = F.get_json_object(payload_json, "$.kind") == kind
    out = F.from_json(payload_json, VARIANTS[kind])
    if kind == "entity":
        each = F.transform(out["aliases"], lambda a: F.coalesce(F.get_json_object(a, "$.value"), a))
        out = out.withField("aliases", F.filter(each, lambda a: strip(a) != ""))
    return F.when(own, out)


def payloads(payload_json: Column) -> list[Column]:
    """One nullable struct column for each variant: p_episodic ... p_plan_graph."""
    return [payload_of(payload_json, k).alias(f"p_{k}") for k in VARIANTS]


def as_object(json: Column) -> Column:
    """An object's values by key, as texts; empty for anything else."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.when(_first(json) == "{", F.from_json(json, "map<string,string>")), none)


def _first(json: Column) -> Column:
    return F.substring(strip(json), 1, 1)


def string_list(json: Column) -> Column:
    """A list's values as texts: trimmed, without blanks, each once up to case; empty for anything else."""
    return unique_folded(F.when(_first(json) == "[", F.from_json(json, "array<string>")))


def bool_value(json: Column) -> Column:
    """True for a real boolean that is true; texts and numbers are none."""
    return F.coalesce(strip(json) == "true", F.lit(False))


def constraint_list(json: Column) -> Column:
    """The objects of a list as (type, key, value, required), value as JSON; null for anything but a list.

    ``required`` counts only where it is a real boolean."""
    items = F.filter(F.when(_first(json) == "[", F.from_json(json, "array<string>")), lambda x: _first(x) == "{")
    get = lambda x, k: strip(F.coalesce(F.get_json_object(x, f"$.{k}"), F.lit("")))
    real = lambda x: F.coalesce(F.regexp_like(x, F.lit(r'"required"\s*:\s*true')), F.lit(False))
    return F.transform(items, lambda x: F.struct(get(x, "type").alias("type"), get(x, "key").alias("key"), F.get_json_object(x, "$.value").alias("value"), real(x).alias("required")))


def plain_text(json: Column) -> Column:
    """A value as text: a JSON text as it is, another value as its JSON; empty for null. What a fact's object is embedded by,
    and what a capture's content is summarised by."""
    whole = F.concat(F.lit('{"v":'), json, F.lit("}"))
    return F.coalesce(F.when(_first(json) == '"', F.get_json_object(whole, "$.v")).when(strip(json) == "null", "").otherwise(json), F.lit(""))


def answer_text(json: Column) -> Column:
    """A model's answer: a text, or the texts of a list of parts (objects with ``text``), one after the other."""
    parts = F.from_json(json, "array<struct<type:string,text:string>>")
    told = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    return F.when(_first(json) == "[", F.array_join(told, "")).otherwise(plain_text(json))


def parse_time(text: Column) -> Column:
    """A point in time as written in RFC 3339; null for blank and unreadable texts."""
    return F.when(F.regexp_like(strip(text), F.lit(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")), F.try_to_timestamp(F.upper(strip(text))))


def format_time(at: Column) -> Column:
    """The other way, in UTC with microseconds; empty for null. The session's time zone must be UTC."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(""))


def unique_mentions(mentions: Column) -> Column:
    """Mentions with a surface, the first of each surface up to case and outer blanks."""
    named = F.filter(mentions, lambda m: F.coalesce(norm(m["surface"]), F.lit("")) != "")
    keys = F.transform(named, lambda m: norm(m["surface"]))
    return F.filter(named, lambda m, i: F.array_position(keys, norm(m["surface"])) == i + 1)


def entity_types(primary: Column, types: Column) -> Column:
    """The primary type and then the others, each once up to case."""
    return unique_folded(F.concat(F.array(primary), F.coalesce(types, F.array().cast("array<string>"))))


def derived_interpretation(summary: Column, labels: Column, confidence: Column, entity_ids: Column) -> Column:
    """The interpretation of a fact derived from a capture: resolved, with its entities as mentions; null if it says nothing."""
    sure = F.when(confidence > 0, confidence).otherwise(0.7)
    none = F.lit(None).cast("string")
    ids = F.filter(entity_ids, lambda x: F.coalesce(x, F.lit("")) != "")
    mentions = F.transform(ids, lambda x: F.struct(x.alias("surface"), none.alias("entity_kind"), x.alias("canonical_entity_id"), sure.alias("confidence"), F.array().cast("array<string>").alias("aliases")))
    out = F.struct(F.lit("resolved").alias("status"), F.coalesce(summary, F.lit("")).alias("summary"), F.lit("semantic").alias("proposed_type"), labels.alias("topical_labels"), mentions.alias("mentions"), sure.alias("extraction_confidence"))
    empty = (F.size(ids) == 0) & (F.coalesce(summary, F.lit("")) == "") & (F.coalesce(F.size(labels), F.lit(0)) <= 0)
    return F.when(~empty, out)


def storage_violation(r: dict[str, Column]) -> Column:
    """The first bound of the stored lifecycle that a record breaks, null for none. ``r``: half_life_seconds, min_salience
    and, if there are others than the exponential one, curve."""
    rules = [("half-life must be positive", ~F.coalesce(r["half_life_seconds"] > 0, F.lit(False))), ("minimal salience must not be negative", F.coalesce(r["min_salience"] < 0, F.lit(False)))]
    if "curve" in r:
        rules.insert(0, ("curve is unknown", ~F.coalesce(r["curve"].isin(*CURVES), F.lit(False))))
    return reduce(lambda acc, x: acc.when(x[1], F.lit(x[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))


def edge_violation(weight: Column) -> Column:
    """Whether an edge's weight is out of [0, 1]; a null weight is none."""
    return F.when((weight < 0) | (weight > 1), "weight must be in [0, 1]")
