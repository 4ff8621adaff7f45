"""Texts and terms of records, read from typed payload structs; and the merging of interpretations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import first_text, term_match, unique_folded
from engram.functions.text import norm, strip

EPISODIC = (
    "struct<timeline:array<struct<t:timestamp,event_kind:string,ref:string,summary:string>>,"
    "tool_graph:array<struct<id:string,tool:string,args:string,result:string,depends_on:array<string>>>,outcome:string>"
)
INTERPRETATION = (
    "struct<status:string,summary:string,proposed_type:string,topical_labels:array<string>,"
    "mentions:array<struct<surface:string,entity_kind:string,canonical_entity_id:string,confidence:double,aliases:array<string>>>,"
    "relation_candidates:array<struct<predicate:string,target_record_id:string,target_entity_id:string,confidence:double,resolved:boolean>>,"
    "reference_candidates:array<struct<ref:string,target_record_id:string,target_entity_id:string,confidence:double,resolved:boolean>>,extraction_confidence:double>"
)
# The named parameters of a plan node that name entities.
PLAN_KEYS = ("tool", "command", "repo", "repository", "file", "service", "package")
# Entity ids carry this prefix or at least so many dashes.
ENTITY_PREFIX, ENTITY_DASHES = "entity-", 4


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _filled(c: Column) -> Column:
    return F.filter(_list(c), lambda x: F.coalesce(x, F.lit("")) != "")


# --- what a record of each type is embedded by


def episodic_text(timeline: Column) -> Column:
    """The last summary that isn't empty; without one, kind and ref of the first event."""
    told = F.filter(timeline, lambda e: F.coalesce(e["summary"], F.lit("")) != "")
    last = F.try_element_at(told, F.lit(-1))["summary"]
    first = F.try_element_at(timeline, F.lit(1))
    plain = F.concat(F.coalesce(first["event_kind"], F.lit("")), F.lit(" "), F.coalesce(first["ref"], F.lit("")))
    return F.coalesce(last, F.when(F.size(timeline) > 0, plain), F.lit(""))


def working_text(context_summary: Column, state: Column, next_actions: Column) -> Column:
    actions = F.array_join(_list(next_actions), " ")
    return F.concat_ws(" ", F.nullif(context_summary, F.lit("")), F.nullif(state, F.lit("")), F.when(F.size(_list(next_actions)) > 0, actions))


def semantic_text(subject: Column, predicate: Column, object_: Column) -> Column:
    """``object_``: a text, or the JSON of another value."""
    return strip(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (subject, predicate, object_)]))


def competence_text(skill_name: Column, signals: Column) -> Column:
    return strip(F.concat_ws(" ", F.coalesce(skill_name, F.lit("")), F.array_join(_filled(signals), " ")))


def plan_text(intent: Column, ops: Column) -> Column:
    return F.coalesce(F.nullif(intent, F.lit("")), F.array_join(_filled(ops), " "))


def trigger_text(rows: DataFrame) -> Column:
    """By memory_type, over flat columns; entities and unknown types have no text."""
    plain = F.concat(F.coalesce("event_kind", F.lit("")), F.lit(" "), F.coalesce("ref", F.lit("")))
    return (
        F.when(F.col("memory_type") == "episodic", F.coalesce(F.nullif("summary", F.lit("")), plain))  # their one event
        .when(F.col("memory_type") == "working", working_text(F.lit(None).cast("string"), F.col("state"), F.col("next_actions")))
        .when(F.col("memory_type") == "semantic", semantic_text(F.col("subject"), F.col("predicate"), F.col("object")))
        .when(F.col("memory_type") == "competence", competence_text(F.col("skill_name"), F.col("triggers")))
        .when(F.col("memory_type") == "plan_graph", plan_text(F.col("intent"), F.col("nodes.op")))
        .otherwise("")
    )


def episode_content(p: Column) -> Column:
    """An episode as lines for a model: told events, tools with results, the outcome. ``p``: an EPISODIC struct."""
    told = F.filter(F.coalesce(p["timeline"], F.array().cast("array<struct<t:timestamp,event_kind:string,ref:string,summary:string>>")), lambda e: norm(e["summary"]) != "")
    lines = F.transform(told, lambda e: F.concat(F.coalesce(e["event_kind"], F.lit("")), F.lit(": "), e["summary"]))
    tools = F.coalesce(p["tool_graph"], F.array().cast("array<struct<id:string,tool:string,args:string,result:string,depends_on:array<string>>>"))
    calls = F.transform(
        tools, lambda n: F.concat(F.lit("tool "), F.coalesce(n["tool"], F.lit("")), F.when(norm(n["result"]) != "", F.concat(F.lit(" -> "), strip(n["result"]))).otherwise(""))
    )
    end = F.when(F.coalesce(p["outcome"], F.lit("")) != "", F.array(F.concat(F.lit("outcome: "), p["outcome"]))).otherwise(F.array().cast("array<string>"))
    return strip(F.array_join(F.concat(lines, calls, end), "\n"))


# --- terms


def mention_terms(i: Column) -> Column:
    """Surfaces and aliases of an interpretation's mentions."""
    return _list(F.flatten(F.transform(i["mentions"], lambda m: F.concat(F.array(m["surface"]), _list(m["aliases"])))))


def search_terms(envelope: Column, payload_terms: Column, interpretation: Column | None = None) -> Column:
    """The terms a record is found by: its id, scope and tags, its interpretation's, and those of its payload."""
    more = []
    if interpretation is not None:
        more = [F.array(interpretation["summary"]), _list(interpretation["topical_labels"]), mention_terms(interpretation)]
    return unique_folded(F.concat(_list(envelope), *more, _list(payload_terms)))


def query_terms(tags: Column, active: Column, content: Column, interpretation: Column) -> Column:
    """The terms of a capture request: tags, active entities, what its content names, labels, mentions, references."""
    named = first_text(*[F.get_json_object(content, f"$.{k}") for k in ("subject", "project", "tool_name", "file")])
    refs = _list(F.transform(interpretation["reference_candidates"], lambda r: r["ref"]))
    return unique_folded(F.concat(_list(tags), _list(active), F.array(named), _list(interpretation["topical_labels"]), mention_terms(interpretation), refs))


def plan_entity_terms(nodes: Column) -> Column:
    """Operations and named parameters (JSON) of plan nodes (op, params)."""
    values = lambda n: F.array(n["op"], *[F.get_json_object(n["params"], f"$.{k}") for k in PLAN_KEYS])
    return _filled(F.flatten(F.transform(nodes, values)))


def matches_term(terms: Column, term: Column) -> Column:
    return F.coalesce(F.exists(_list(terms), lambda v: term_match(v, term)), F.lit(False))


def names_reference(timeline: Column, ref: Column) -> Column:
    """Whether an episode's event has this reference."""
    return F.coalesce((norm(ref) != "") & F.exists(timeline, lambda e: norm(e["ref"]) == norm(ref)), F.lit(False))


def looks_like_entity_id(c: Column) -> Column:
    return F.startswith(c, F.lit(ENTITY_PREFIX)) | (F.length(c) - F.length(F.replace(c, F.lit("-"))) >= ENTITY_DASHES)


def derived_tags(tags: Column) -> Column:
    """'consolidated' first, then the source's tags."""
    return F.concat(F.array(F.lit("consolidated")), F.filter(_list(tags), lambda t: F.lower(t) != "consolidated"))


# --- interpretations


def merged(base: Column, over: Column) -> Column:
    """Filled fields of ``over`` win, labels are united, whole lists replaced. Both: INTERPRETATION structs."""
    text = lambda k: F.coalesce(F.nullif(over[k], F.lit("")), base[k]).alias(k)
    items = lambda k: F.when(F.size(over[k]) > 0, over[k]).otherwise(base[k]).alias(k)
    labels = F.when(F.size(over["topical_labels"]) > 0, unique_folded(F.concat(_list(base["topical_labels"]), over["topical_labels"]))).otherwise(base["topical_labels"])
    conf = F.when(over["extraction_confidence"] > 0, over["extraction_confidence"]).otherwise(base["extraction_confidence"])
    both = F.struct(
        text("status"), text("summary"), text("proposed_type"), labels.alias("topical_labels"), items("mentions"), items("relation_candidates"),
        items("reference_candidates"), conf.alias("extraction_confidence"),
    )
    return F.when(over.isNull(), base).when(base.isNull(), over).otherwise(both)


def final_status(i: Column) -> Column:
    """'tentative' while a named mention has no entity, or a reference or relation is open."""
    open_ = lambda k, name: F.coalesce(F.exists(i[k], lambda x: (norm(x[name]) != "") & ~F.coalesce(x["resolved"], F.lit(False))), F.lit(False))
    unnamed = F.coalesce(F.exists(i["mentions"], lambda m: (norm(m["surface"]) != "") & (F.coalesce(m["canonical_entity_id"], F.lit("")) == "")), F.lit(False))
    return F.when(i.isNull() | unnamed | open_("reference_candidates", "ref") | open_("relation_candidates", "predicate"), "tentative").otherwise("resolved")
