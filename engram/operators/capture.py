"""Capture: a batch of requests becomes records, entities and edges, by projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.exprs import TASK_STATES, clamp01, entity_type, first_text, freshness, half_life, record_type, source_confidence, term_match, unique_folded
from engram.functions.text import norm
from engram.functions.values import derived_interpretation, unique_mentions
from engram.operators import ingest, store
from engram.operators.store import Snapshot, both_ways
from engram.operators.texts import INTERPRETATION, looks_like_entity_id
from engram.plans.staging import stage

#: Candidates read for a request, and kept.
POOL, KEPT = 80, 20
# The content keys that name an entity, and keywords that tell its kind.
NAMING_KEYS = ("subject", "tool_name", "project", "file")
# Points of a candidate.
SCOPE_POINTS, ENTITY_POINTS, TYPE_POINTS, TAG_POINTS, TERM_POINTS = 100, 15, 10, 8, 25


def policy(requests: DataFrame) -> DataFrame:
    """Requests with type, confidence, half-life, sensitivity, salience and deletion policy of their record.

    ``requests``: source_kind, sensitivity, ...; a capture of an observation is an episode first (with_fact adds the fact).
    """
    type_ = record_type(F.col("source_kind"))
    return requests.withColumns(
        {
            "type": type_,
            "policy_confidence": source_confidence(F.col("source_kind")),
            "half_life_seconds": half_life(type_).cast("long"),
            "sensitivity": F.coalesce(F.nullif("sensitivity", F.lit("")), F.lit("low")),
            "salience": F.lit(1.0),
            "deletion_policy": F.lit("auto_prune"),
        }
    )


def content_value(content: Column, *keys: str) -> Column:
    """The first of the keys with a text that isn't blank."""
    return first_text(*[F.get_json_object(content, f"$.{k}") for k in keys])


def inferred_mentions(content: Column) -> Column:
    """(surface, kind, confidence) of content keys that contain 'entity' or name one, by key."""
    pairs = F.map_entries(F.from_json(content, "map<string,string>"))
    key = lambda x: F.lower(x["key"])
    named = F.filter(pairs, lambda x: (F.contains(key(x), F.lit("entity")) | key(x).isin(*NAMING_KEYS)) & (norm(x["value"]) != ""))
    return F.transform(F.array_sort(named), lambda x: F.struct(x["value"].alias("surface"), kind_of_key(key(x)).alias("entity_kind"), F.lit(0.5).alias("confidence")))


def kind_of_key(k: Column) -> Column:
    """The kind that a content key tells."""
    has = lambda w: F.contains(k, F.lit(w))
    return F.when(has("tool"), "tool").when(has("project"), "project").when(has("file") | has("path"), "file").when(has("person") | has("user"), "person").otherwise("concept")


def inferred_references(content: Column) -> Column:
    """(ref, confidence) of content keys that contain 'ref' or 'record_id' or are 'id', by key."""
    pairs = F.map_entries(F.from_json(content, "map<string,string>"))
    key = lambda x: F.lower(x["key"])
    named = F.filter(pairs, lambda x: (F.contains(key(x), F.lit("ref")) | F.contains(key(x), F.lit("record_id")) | (key(x) == "id")) & (norm(x["value"]) != ""))
    return F.transform(F.array_sort(named), lambda x: F.struct(x["value"].alias("ref"), F.lit(0.5).alias("confidence")))


def fallback(requests: DataFrame) -> DataFrame:
    """Requests with the interpretation made without a model: summary, labels, mentions, references."""
    return requests.withColumns(
        {
            "i_summary": first_text(F.col("summary"), F.col("reason_to_remember"), content_value(F.col("content"), "text", "summary")),
            "i_labels": unique_folded(F.col("tags")),
            "i_type": record_type(F.col("source_kind")),
            "i_mentions": F.coalesce(inferred_mentions(F.col("content")), F.array()),
            "i_references": F.coalesce(inferred_references(F.col("content")), F.array()),
            "i_confidence": F.lit(0.25),
        }
    )


def interpreted(requests: DataFrame) -> DataFrame:
    """Requests of ``fallback`` with what an interpreter found where it found something: column ``interpretation``, a struct
    as ``texts.INTERPRETATION`` (null: none). Its lists replace the inferred ones, labels are united, and its relation
    candidates, proposed type and confidence are the request's where they are set."""
    i = F.col("interpretation")
    filled = lambda k: F.coalesce(F.size(i[k]), F.lit(0)) > 0
    none = F.array().cast("array<string>")
    mentions = F.transform(
        i["mentions"], lambda m: F.struct(m["surface"].alias("surface"), m["entity_kind"].alias("entity_kind"), m["canonical_entity_id"].alias("canonical_entity_id"), m["confidence"].alias("confidence"), F.coalesce(m["aliases"], none).alias("aliases"))
    )
    guessed = F.transform(
        "i_mentions", lambda m: F.struct(m["surface"].alias("surface"), m["entity_kind"].alias("entity_kind"), F.when(looks_like_entity_id(m["surface"]), m["surface"]).alias("canonical_entity_id"), m["confidence"].alias("confidence"), none.alias("aliases"))
    )
    refs = F.transform(i["reference_candidates"], lambda r: F.struct(r["ref"].alias("ref"), r["confidence"].alias("confidence")))
    relations = F.transform(i["relation_candidates"], lambda r: F.struct(*[r[k].alias(k) for k in ("predicate", "target_record_id", "target_entity_id", "confidence")]))
    kind = "array<struct<surface:string,entity_kind:string,canonical_entity_id:string,confidence:double,aliases:array<string>>>"
    out = {
        "i_summary": F.coalesce(F.nullif(i["summary"], F.lit("")), "i_summary"), "i_labels": unique_folded(F.concat(F.col("i_labels"), F.coalesce(i["topical_labels"], none))),
        "i_mentions": unique_mentions(F.when(filled("mentions"), mentions.cast(kind)).otherwise(guessed.cast(kind))),
        "i_references": F.when(filled("reference_candidates"), refs.cast("array<struct<ref:string,confidence:double>>")).otherwise(F.col("i_references").cast("array<struct<ref:string,confidence:double>>")),
        "proposed_type": F.coalesce(F.nullif(i["proposed_type"], F.lit("")), "proposed_type"),
        "extraction_confidence": F.when(i["extraction_confidence"] > 0, i["extraction_confidence"]).otherwise(F.col("extraction_confidence")),
        "relations": F.coalesce(relations, requests["relations"]) if "relations" in requests.columns else relations,
    }
    return requests.withColumns(out).drop("interpretation")


def score_candidates(requests: DataFrame, candidates: DataFrame, as_of: Column, pool: int = POOL, kept: int = KEPT) -> DataFrame:
    """(request_id, id, score, rank): existing records that a request may refer to.

    ``requests``: request_id, scope, type, tags, terms; ``candidates``: id, type, scope, tags, terms, salience,
    created_at. A request sees the ``pool`` most salient records of its scope and of all scopes. Points: same scope,
    an entity, same type, each shared tag, each matching term, and freshness.
    """
    narrow = candidates.select("id", F.col("type").alias("c_type"), F.coalesce("scope", F.lit("")).alias("c_scope"), F.col("tags").alias("c_tags"), F.col("terms").alias("c_terms"), "salience", F.col("created_at").alias("c_created"))
    top = [F.desc("salience"), F.desc("c_created"), F.asc("id")]
    own = narrow.withColumn("n", F.row_number().over(Window.partitionBy("c_scope").orderBy(*top))).where(F.col("n") <= pool).drop("n")
    everyone = narrow.orderBy(*top).limit(pool)  # a fixed number of rows, so each request can read them all
    r = requests.select("request_id", F.coalesce("scope", F.lit("")).alias("scope"), "type", "tags", "terms")
    seen = r.where(F.col("scope") != "").join(own, F.col("scope") == F.col("c_scope")).unionByName(
        r.withColumn("one", F.lit(1)).join(F.broadcast(everyone.withColumn("one", F.lit(1))), "one").drop("one")
    ).dropDuplicates(["request_id", "id"])
    none = F.array().cast("array<string>")
    tags = F.size(F.array_intersect(F.transform(F.coalesce("tags", none), norm), F.transform(F.coalesce("c_tags", none), norm)))
    terms = F.size(F.filter(F.coalesce("terms", none), lambda n: F.exists(F.coalesce("c_terms", none), lambda v: term_match(v, n))))
    score = (
        F.when((F.col("scope") != "") & (F.col("scope") == F.col("c_scope")), SCOPE_POINTS).otherwise(0)
        + F.when(F.col("c_type") == "entity", ENTITY_POINTS).otherwise(0)
        + F.when(F.col("c_type") == F.col("type"), TYPE_POINTS).otherwise(0)
        + TAG_POINTS * tags
        + TERM_POINTS * terms
        + freshness(F.col("c_created"), as_of)
    )
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("c_created"), "id")
    return seen.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept).select("request_id", "id", "score", "rank")


def resolve_mentions(mentions: DataFrame, entities: DataFrame, terms: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved, created): each mention's entity by explicit id, else by its terms, else among candidates, else a new entity.

    ``mentions``: record_id, scope, surface, entity_kind, canonical_entity_id, confidence and, if they have any, aliases.
    The surface and then the aliases are looked up, the first term that names an entity decides, own scope before none.
    ``candidates``: record_id, entity_id, name, rank: the names of the entities that a request has as candidates, which
    are compared without case. Mentions of one new surface in one scope share one new entity, as later mentions of a
    batch find what earlier ones made. Blank surfaces without a known id drop out.
    """
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in mentions.columns else F.array().cast("array<string>")
    m = mentions.withColumn("__no", F.monotonically_increasing_id()).withColumn("term", norm("surface")).withColumn("scope", F.coalesce("scope", F.lit("")))
    m = m.withColumn("__terms", F.transform(unique_folded(F.concat(F.array("surface"), aliases)), norm))
    ids = entities.select(F.col("entity_id").alias("canonical_entity_id"), F.col("entity_id").alias("by_id"))
    m = stage(m.join(ids, "canonical_entity_id", "left"))
    asked = m.where(F.col("by_id").isNull()).select("__no", "record_id", "scope", F.posexplode("__terms").alias("at", "term"))
    hits = asked.join(terms.select("term", "entity_id", F.col("scope").alias("e_scope")), "term").where((F.col("e_scope") == F.col("scope")) | (F.col("e_scope") == ""))
    found = hits.groupBy("__no").agg(F.min(F.struct("at", (F.col("e_scope") != F.col("scope")).alias("far"), "entity_id"))["entity_id"].alias("by_term"))
    m = m.join(found, "__no", "left")
    near = F.lit(None).cast("string")
    if candidates is not None:
        named = candidates.select("record_id", norm("name").alias("term"), "rank", F.col("entity_id").alias("candidate"))
        close = asked.join(named, ["record_id", "term"]).groupBy("__no").agg(F.min(F.struct("rank", "candidate"))["candidate"].alias("by_candidate"))
        m, near = m.join(close, "__no", "left"), F.col("by_candidate")
    m = m.where(F.col("by_id").isNotNull() | (F.col("term") != ""))
    made = F.concat(F.lit("entity-"), F.substring(F.sha2(F.concat_ws("\x1f", "scope", "term"), 256), 1, 16))
    known = F.coalesce("by_id", "by_term", near)
    m = m.withColumn("entity_id", F.coalesce(known, made)).withColumn("is_new", known.isNull())
    created = m.where("is_new").groupBy("entity_id").agg(
        F.min_by("surface", "__no").alias("canonical_name"), entity_type(F.min_by("entity_kind", "__no")).alias("primary_type"), F.first("scope").alias("scope"), F.count("*").alias("mentions"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__no", aliases.alias("a"), "surface"))), lambda x: F.concat(F.array(x["surface"]), x["a"])))).alias("said"),
    )
    created = created.withColumn("aliases", unique_folded(F.concat(F.array("canonical_name"), "said"))).drop("said")
    return m.drop("__no", "__terms", "term", "by_id", "by_term", "by_candidate"), created


def edge_pairs(links: DataFrame, as_of: Column) -> DataFrame:
    """Both directions of each link (source_id, predicate, target_id, confidence); weight is the confidence, 0 counts as 1.

    Predicates are read without outer blanks and case; links to oneself, and without a predicate, make no edge."""
    weight = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(clamp01(F.col("confidence")))
    return both_ways(links.select("source_id", "predicate", "target_id", weight.alias("weight")), as_of).drop("seq")


def resolve_relations(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Relation candidates with ``target_id`` and ``resolved``: the record named, else the entity named, if it exists and
    is not the source itself.

    ``candidates``: source_id, predicate, target_record_id, target_entity_id, confidence; ``ids``: id of all records and
    entities. A candidate without a predicate is resolved by none."""
    there = ids.select("id").distinct()
    out = candidates.join(there.select(F.col("id").alias("target_record_id"), F.col("id").alias("__a")), "target_record_id", "left")
    out = out.join(there.select(F.col("id").alias("target_entity_id"), F.col("id").alias("__b")), "target_entity_id", "left")
    target = F.coalesce("__a", "__b")
    ok = target.isNotNull() & (target != F.col("source_id")) & (F.coalesce(norm("predicate"), F.lit("")) != "")
    return out.withColumn("target_id", F.when(ok, target)).withColumn("resolved", F.coalesce(ok, F.lit(False))).drop("__a", "__b")


def needs_fact(requests: DataFrame) -> Column:
    """Whether a capture also becomes a fact: an observation, a proposed fact, or a sure interpretation."""
    return (F.col("source_kind") == "observation") | (F.col("proposed_type") == "semantic") | F.coalesce(F.col("extraction_confidence") >= 0.5, F.lit(False))


def facts_of(requests: DataFrame, as_of: Column) -> DataFrame:
    """The derived facts: subject, predicate and object of the content, or of its ``fact``; incomplete ones drop out."""
    inner = F.coalesce(F.get_json_object("content", "$.fact"), F.col("content"))
    got = {c: F.get_json_object(inner, f"$.{c}") for c in ("subject", "predicate", "object")}
    # the confidence of the capture's own record, which is an event's unless a tool's or a working state's
    own = source_confidence(F.when(F.col("source_kind").isin("tool_output", "working_state"), F.col("source_kind")).otherwise("event"))
    conf = F.greatest(own, F.coalesce("extraction_confidence", F.lit(0.0)))
    rows = requests.where(needs_fact(requests)).select("request_id", "scope", "sensitivity", F.col("extraction_confidence").cast("double").alias("extraction_confidence"), *[v.alias(k) for k, v in got.items()], conf.alias("confidence"), F.lit(1.0).alias("salience"), as_of.alias("created_at"))
    return rows.where((norm("subject") != "") & (norm("predicate") != "") & F.col("object").isNotNull())


def resolve_references(references: DataFrame, records: DataFrame, entities: DataFrame, timeline: DataFrame) -> DataFrame:
    """(source_id, ref, target_id) by record id, else entity id, else a timeline event with that reference.

    ``references``: source_id, ref; ``records``: id; ``entities``: entity_id; ``timeline``: id, ref. Unknown ones have
    a null target. Of several events the smallest record id is meant.
    """
    r = references.where(norm("ref") != "").withColumn("key", norm("ref"))
    by_record = records.select(norm("id").alias("key"), F.col("id").alias("a")).dropDuplicates(["key"])
    by_entity = entities.select(norm("entity_id").alias("key"), F.col("entity_id").alias("b")).dropDuplicates(["key"])
    by_event = timeline.where(norm("ref") != "").groupBy(norm("ref").alias("key")).agg(F.min("id").alias("c"))
    joined = r.join(by_record, "key", "left").join(by_entity, "key", "left").join(by_event, "key", "left")
    return joined.select("source_id", "ref", F.coalesce("a", "b", "c").alias("target_id"))


def canonical_sides(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Facts (source_id, subject, object, ...) whose sides are the entities that their source mentions so, else as they were.

    ``mentions``: record_id, surface, aliases, entity_id. Of several the smallest id is meant."""
    said = mentions.select(F.col("record_id").alias("source_id"), F.explode(F.concat(F.array("surface"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("v"), "entity_id")
    by = said.where(norm("v") != "").groupBy("source_id", norm("v").alias("__k")).agg(F.min("entity_id").alias("__e"))
    out = facts
    for side in ("subject", "object"):
        out = out.withColumn("__k", norm(side)).join(by, ["source_id", "__k"], "left").withColumn(side, F.coalesce("__e", side)).withColumn(f"{side}_entity", F.col("__e")).drop("__k", "__e")
    return out


def _as_json(c: Column) -> Column:
    """JSON as it is, any other text as a JSON text."""
    return F.when(F.get_json_object(c, "$").isNotNull(), c).otherwise(ingest.text_json(c))


def capture_batch(requests: DataFrame, records: DataFrame, entities: DataFrame, terms: DataFrame, timeline: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """A batch of requests as rows to add: 'records', 'facts', 'entities', 'edges' and 'audit', and the 'interpretations'
    with their status; nothing is written here.

    ``requests``: request_id, source, source_kind, content, summary, reason_to_remember, tags, scope, sensitivity,
    proposed_type, extraction_confidence and, from an interpreter, relations (predicate, target_record_id,
    target_entity_id, confidence) or a whole interpretation (see ``interpreted``). Every request has one record of its own, made as ``ingest`` makes it; mentions resolve
    to existing or new entities, references and relations to existing records and entities (one to itself makes no
    edge); observations, proposed facts and sure interpretations also become facts, whose sides are the entities
    mentioned. Edges go both ways and weigh 1, those of relations their confidence. Requests of one id are one request,
    whichever row comes first in order of content.
    """
    one = requests.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min(F.struct("content", *[c for c in requests.columns if c not in ("request_id", "content")])).alias("r")).select("request_id", "r.*")
    if "interpretation" not in one.columns:
        one = one.withColumn("interpretation", F.lit(None).cast(INTERPRETATION))
    ready = stage(interpreted(fallback(policy(one))).withColumn("id", F.concat(F.lit("rec-"), F.substring(F.sha2("request_id", 256), 1, 32))))
    content = F.col("content")
    working = F.col("source_kind") == "working_state"
    tool = F.col("source_kind") == "tool_output"
    texts_of = lambda k: F.from_json(F.get_json_object(content, f"$.{k}"), "array<string>")
    state = F.get_json_object(content, "$.state")
    asked = ready.select(
        "request_id", F.when(working | tool, F.col("source_kind")).otherwise("event").alias("kind"), F.coalesce("source", F.lit("capture")).alias("source"), as_of.alias("timestamp"), "tags", "scope", "sensitivity",
        F.coalesce(F.nullif("source_kind", F.lit("")), F.lit("event")).alias("event_kind"), F.coalesce(content_value(content, "ref", "id"), F.col("id")).alias("ref"), F.col("i_summary").alias("summary"),
        F.coalesce(content_value(content, "tool_name", "tool"), F.lit("unknown")).alias("tool_name"), F.get_json_object(content, "$.args").alias("args"),
        F.when(tool, ingest.text_json(F.get_json_object(content, "$.result"))).alias("result"), texts_of("depends_on").alias("depends_on"),
        F.coalesce(content_value(content, "thread_id", "thread"), F.lit("unknown")).alias("thread_id"), F.when(state.isin(*TASK_STATES), state).otherwise("executing").alias("state"), texts_of("next_actions").alias("next_actions"),
        texts_of("open_questions").alias("open_questions"), first_text(F.col("summary"), F.col("reason_to_remember"), content_value(content, "context_summary", "summary")).alias("context_summary"),
        F.get_json_object(content, "$.active_constraints").alias("active_constraints"),
        ingest._json(context=ingest._json(capture_content=_as_json(content), capture_context=_as_json(F.col("context")) if "context" in ready.columns else F.lit(None).cast("string"), reason_to_remember=ingest.text_json(F.col("reason_to_remember")))).alias("environment"),
    )
    own = ingest.ingest(asked, records.limit(0), terms.limit(0), as_of)
    said = ready.select(F.col("id").alias("record_id"), "scope", F.inline("i_mentions"))
    found, new = resolve_mentions(said, entities, terms)
    found = stage(found)
    link = lambda df, p, target, conf: df.select("source_id", F.lit(p).alias("predicate"), F.col(target).alias("target_id"), conf.alias("confidence"))
    full = F.lit(1.0)
    links = link(found.withColumnRenamed("record_id", "source_id"), "mentions_entity", "entity_id", full)
    refs = ready.select(F.col("id").alias("source_id"), F.explode("i_references.ref").alias("ref"))
    linked = resolve_references(refs, records, entities, timeline)
    links = links.unionByName(link(linked.where(F.col("target_id").isNotNull()), "references_record", "target_id", full))
    # a reference to what the request itself is called is its own, if nobody else's
    own_refs = asked.join(ready.select("request_id", F.col("id").alias("source_id")), "request_id").select("source_id", norm("ref").alias("key")).distinct()
    open_ = linked.where(F.col("target_id").isNull()).withColumn("key", norm("ref")).join(own_refs, ["source_id", "key"], "left_anti").select("source_id")
    ids = records.select("id").unionByName(entities.select(F.col("entity_id").alias("id")))
    related = resolve_relations(ready.select(F.col("id").alias("source_id"), F.inline("relations")), ids)
    links = links.unionByName(related.where("resolved").select("source_id", "predicate", "target_id", F.col("confidence").cast("double").alias("confidence")))
    open_ = open_.unionByName(related.where(~F.col("resolved") & (norm("predicate") != "")).select("source_id"))
    facts = facts_of(ready, as_of).join(ready.select("request_id", F.col("id").alias("source_id")), "request_id")
    facts = canonical_sides(facts, found.select("record_id", "surface", "aliases", "entity_id"))
    facts = facts.withColumn("id", F.concat(F.lit("fact-"), F.substring(F.sha2(F.concat_ws("\x1f", "source_id", "subject", "predicate", "object"), 256), 1, 16)))
    about = ready.select(F.col("id").alias("source_id"), F.col("i_summary").alias("__s"), F.col("i_labels").alias("__l"), "tags", "source")
    own_ids = F.array_distinct(F.filter(F.array("subject_entity", "object_entity"), lambda x: x.isNotNull()))
    meaning = derived_interpretation(F.col("__s"), F.col("__l"), F.coalesce("extraction_confidence", F.lit(0.0)), own_ids)
    facts = facts.join(about, "source_id").withColumns({"interpretation_json": F.to_json(meaning), "tags": unique_folded(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.col("__l")))}).drop("__s", "__l")
    links = links.unionByName(link(facts, "derived_semantic", "id", full))
    for side in ("subject", "object"):
        links = links.unionByName(link(facts.where(F.col(f"{side}_entity").isNotNull()).select(F.col("id").alias("source_id"), f"{side}_entity"), f"{side}_entity", f"{side}_entity", full))
    status = ready.select("id", F.col("i_summary").alias("summary"), F.col("i_labels").alias("topical_labels")).join(open_.select(F.col("source_id").alias("id"), F.lit(True).alias("__open")).distinct(), "id", "left")
    status = status.withColumn("status", F.when(F.col("__open"), "tentative").otherwise("resolved")).drop("__open")
    return {"records": own.records, "facts": facts, "entities": new, "edges": edge_pairs(links, as_of), "audit": own.audit, "interpretations": status}


def write(snap: Snapshot, batch: dict[str, DataFrame], as_of: Column) -> Snapshot:
    """The snapshot with a batch of ``capture_batch``: records, facts, new entities and edges with their audit entries, or
    nothing of it. What is there already (of an earlier run of the same batch) is not written again."""
    j = ingest.text_json
    meaning = batch["interpretations"].select("id", F.to_json(F.struct("status", "summary", "topical_labels")).alias("interpretation_json"))
    records = batch["records"].drop("interpretation_json").join(meaning, "id", "left").select(*snap.records.columns)
    object_ = F.when(F.col("object_entity").isNotNull(), j(F.col("object"))).otherwise(_as_json(F.col("object")))
    evidence = F.concat(F.lit('[{"source_type":"episodic","source_id":'), j(F.col("source_id")), F.lit(',"timestamp":'), ingest.when_json(as_of), F.lit("}]"))
    body = ingest._json(kind=j(F.lit("semantic")), subject=j(F.col("subject")), predicate=j(F.col("predicate")), object=object_, validity=F.lit('{"mode":"global"}'), evidence=evidence)
    times = {"created_at": as_of, "updated_at": as_of, "last_reinforced_at": as_of}
    facts = batch["facts"].withColumns({"type": F.lit("semantic"), "payload_json": body, "created_by": F.col("source"), **times})
    alias = F.to_json(F.transform("aliases", lambda a: F.struct(a.alias("value"))))
    self_ = F.to_json(F.array(F.struct(F.lit("self").alias("namespace"), F.col("entity_id").alias("value"))))
    name = ingest._json(kind=j(F.lit("entity")), canonical_name=j(F.col("canonical_name")), primary_type=j(F.col("primary_type")), types=F.to_json(F.array("primary_type")), aliases=alias, identifiers=self_, summary=j(F.col("canonical_name")))
    entities = batch["entities"].withColumns({"id": F.col("entity_id"), "type": F.lit("entity"), "payload_json": name, "created_by": F.lit("capture"), **times})
    new = records.unionByName(store.as_records(facts)).unionByName(store.as_records(entities)).dropDuplicates(["id"])
    new = stage(new.join(snap.records.select("id"), "id", "left_anti").select(*snap.records.columns))
    log = lambda df, why: df.select(F.col("id").alias("record_id"), F.lit("create").alias("action"), "created_by", F.lit(why).alias("rationale"))
    made = log(facts, "Derived semantic record during capture interpretation").unionByName(log(entities, "Created canonical entity during capture resolution"))
    made = made.select("record_id", "action", F.coalesce("created_by", F.lit("capture")).alias("actor"), as_of.alias("at"), "rationale", F.unix_micros(as_of).alias("seq"))
    audit = batch["audit"].select(*snap.audit.columns).unionByName(made.select(*snap.audit.columns)).dropDuplicates(["record_id"])
    audit = audit.join(new.select(F.col("id").alias("record_id")), "record_id", "left_semi").select(*snap.audit.columns)
    edges = batch["edges"].withColumn("seq", F.unix_micros(as_of)).select(*snap.relations.columns)
    return store.create(snap, new, edges, audit)
