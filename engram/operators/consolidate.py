"""Consolidation: compress old episodes, turn their events into facts, recurring tools into skills, tool graphs into plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import pick, seconds_between, sensitivity_label, sensitivity_rank, without_fences
from engram.functions.text import strip
from engram.operators import ingest, store
from engram.operators.texts import derived_tags
from engram.plans.staging import stage

# Thresholds and vocabulary of consolidation.
MIN_AGE, MIN_SALIENCE, FACTOR = 24 * 3600, 0.05, 0.5
GAIN, MIN_EPISODES, MIN_NODES = 0.1, 2, 3
MIXED = "consolidated:mixed-scope"
OBSERVED = "observed_in"


def compress(records: DataFrame, as_of: Column) -> DataFrame:
    """Halve the salience of old episodes that aren't pinned, down to the least that is kept."""
    due = (
        (F.col("type") == "episodic")
        & ~F.coalesce("pinned", F.lit(False))
        & (seconds_between(F.col("created_at"), as_of) >= MIN_AGE)
        & (F.col("salience") > MIN_SALIENCE)
    )
    return records.withColumns(
        {
            "salience": F.when(due, F.greatest(F.col("salience") * FACTOR, F.lit(MIN_SALIENCE))).otherwise(F.col("salience")),
            "updated_at": F.when(due, as_of).otherwise(F.col("updated_at")),
        }
    )


def semantic_facts(events: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, reinforced) from timeline events of successful episodes.

    ``events``: record_id, place (episode, then position: any orderable), event_kind, summary; events without a summary
    tell nothing, a null kind is an empty one. A kind without an existing fact gives one fact, (kind, observed_in, its
    first summary). For a known kind the fact is reinforced once, with its number of matches; further events of a new
    kind count too. ``existing``: subject, fact_id, salience and, if there are others, predicate; of several rows for one
    subject the smallest fact_id is meant. Facts with another predicate are other facts.
    """
    told = events.where(F.coalesce("summary", F.lit("")) != "").withColumn("event_kind", F.coalesce("event_kind", F.lit("")))
    per = told.groupBy(F.col("event_kind").alias("subject")).agg(
        F.min_by(F.struct("summary", "record_id"), "place").alias("first"), F.count("*").alias("matches"), F.count_distinct("record_id").alias("episodes")
    )
    same = existing.where(F.col("predicate") == OBSERVED) if "predicate" in existing.columns else existing
    known = same.groupBy("subject").agg(F.min(F.struct("fact_id", "salience")).alias("k")).select("subject", "k.fact_id", "k.salience")
    joined = per.join(known, "subject", "left")
    new = joined.where(F.col("fact_id").isNull()).select(
        "subject", F.lit(OBSERVED).alias("predicate"), F.col("first.summary").alias("object"), F.col("first.record_id").alias("derived_from"), (F.col("matches") - 1).alias("reinforcements")
    )
    more = joined.where(F.col("fact_id").isNotNull()).select("fact_id", F.least(F.col("salience") + GAIN, F.lit(1.0)).alias("salience"), "matches")
    return new, more


def conservative_scope(scopes: Column) -> Column:
    """The one scope all share, else the mixed one. ``scopes``: distinct scopes."""
    return F.when(F.size(scopes) == 1, scopes[0]).otherwise(MIXED)


def scope_note(scopes: Column) -> Column:
    named = F.array_sort(F.transform(scopes, lambda s: F.when(s == "", "unscoped").otherwise(s)))
    return F.when(F.size(scopes) == 1, F.concat(F.lit("scope="), scopes[0])).otherwise(F.concat(F.lit(f"scope={MIXED} from "), F.array_join(named, ", ")))


def skills(tools: DataFrame, episodes: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, reinforced) from the tool bags of successful episodes.

    ``tools``: record_id, place, tool; ``episodes``: record_id, place, scope, sensitivity of the successful ones. An
    episode's signature is its sorted tool names with repeats; two episodes make a pattern. The recipe has the tool
    order of the first episode. ``existing``: skill_name, skill_id, salience, one row for each name.
    """
    named = tools.select("record_id", "place", strip("tool").alias("tool")).where(F.col("tool") != "")
    bags = named.groupBy("record_id").agg(
        F.array_join(F.array_sort(F.collect_list("tool")), "+").alias("signature"), F.transform(F.array_sort(F.collect_list(F.struct("place", "tool"))), lambda x: x["tool"]).alias("recipe")
    )
    per = (
        bags.join(episodes.select("record_id", F.col("place").alias("at"), F.coalesce("scope", F.lit("")).alias("scope"), sensitivity_rank(F.col("sensitivity")).alias("rank")), "record_id")
        .groupBy("signature")
        .agg(
            F.count("*").alias("success_count"),
            F.min_by("recipe", F.struct("at", "record_id")).alias("recipe"),
            F.max("rank").alias("rank"),
            F.array_sort(F.collect_set("scope")).alias("scopes"),
        )
        .where(F.col("success_count") >= MIN_EPISODES)
        .withColumn("skill_name", F.concat(F.lit("skill:"), "signature"))
    )
    joined = per.join(existing, "skill_name", "left")
    new = joined.where(F.col("skill_id").isNull()).select(
        "skill_name", "success_count", "recipe", conservative_scope(F.col("scopes")).alias("scope"), scope_note(F.col("scopes")).alias("scope_note"),
        sensitivity_label(F.col("rank")).alias("sensitivity"), F.lit(0.8).alias("confidence"),
    )
    more = joined.where(F.col("skill_id").isNotNull()).select("skill_id", F.least(F.col("salience") + GAIN, F.lit(1.0)).alias("salience"), F.col("success_count").alias("matches"))
    return new, more


def plans(nodes: DataFrame, timelines: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, edges) from tool graphs of three nodes or more that gave none yet, whatever their outcome.

    ``nodes``: record_id, place, node, tool, deps; ``timelines``: record_id, place, event_kind; ``derived``: record_id
    of episodes with a plan. Every dependency becomes a control edge; the intent is the first named event.
    """
    big = nodes.groupBy("record_id").agg(F.count("*").alias("n_nodes")).where(F.col("n_nodes") >= MIN_NODES).join(derived.select("record_id"), "record_id", "left_anti")
    intent = timelines.where(strip("event_kind") != "").groupBy("record_id").agg(F.min_by("event_kind", "place").alias("intent"))
    out = big.join(intent, "record_id", "left").select("record_id", F.coalesce("intent", F.lit("unknown")).alias("intent"), "n_nodes", F.lit(0.7).alias("confidence"), F.lit(1).alias("execution_count"))
    edges = nodes.join(big.select("record_id"), "record_id", "left_semi").select("record_id", F.explode("deps").alias("from_node"), F.col("node").alias("to_node"), F.lit("control").alias("kind"))
    return out, edges


def triples(answers: DataFrame) -> DataFrame:
    """(record_id, subject, predicate, object) from extracted JSON lists (record_id, answer): trimmed, complete, distinct."""
    found = F.from_json(without_fences(F.col("answer")), "array<struct<subject:string,predicate:string,object:string>>")
    rows = answers.select("record_id", F.explode(found).alias("t")).select("record_id", *[strip(f"t.{c}").alias(c) for c in ("subject", "predicate", "object")])
    return rows.where((F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != "")).distinct()


def claim(episodes: DataFrame, log: DataFrame, as_of: Column, batch: int = 50, expiry_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(claimed, log): the oldest episodes that are neither done nor claimed; stale claims have expired first.

    ``log``: record_id, triple_count (-1: claimed), claimed_at.
    """
    stale = (F.col("triple_count") < 0) & (seconds_between(F.col("claimed_at"), as_of) > expiry_seconds)
    alive = log.where(~stale)
    todo = episodes.join(alive.select("record_id"), "record_id", "left_anti").orderBy("created_at", "record_id").limit(batch)
    return todo, alive.unionByName(todo.select("record_id", F.lit(-1).cast(log.schema["triple_count"].dataType).alias("triple_count"), as_of.alias("claimed_at")))


def release(log: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Mark extracted episodes (record_id, triple_count) as done, and give failed ones back."""
    rest = log.join(failed.select("record_id"), "record_id", "left_anti").join(done.withColumnRenamed("triple_count", "__n"), "record_id", "left")
    return rest.select("record_id", F.coalesce("__n", "triple_count").alias("triple_count"), "claimed_at")


def run_all(records: DataFrame, timeline: DataFrame, nodes: DataFrame, known_facts: DataFrame, known_skills: DataFrame, planned: DataFrame, as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """All steps in order: (results, counters). ``timeline``: record_id, place, event_kind, summary; ``nodes``: record_id,
    place, node, tool, deps; ``records`` with ``outcome``. The first failing step raises, and nothing is written here."""
    good = records.where((F.col("type") == "episodic") & (F.col("outcome") == "success")).select(F.col("id").alias("record_id"), F.col("created_at").alias("at"), "scope", "sensitivity")
    told = timeline.join(good.select("record_id", "at"), "record_id").select("record_id", F.struct("at", "record_id", "place").alias("place"), "event_kind", "summary")
    new_facts, more_facts = semantic_facts(told, known_facts)
    new_skills, more_skills = skills(nodes.select("record_id", "place", "tool"), good.withColumnRenamed("at", "place"), known_skills)
    new_plans, edges = plans(nodes, timeline, planned)
    due = compress(records, as_of)
    out = {"records": due, "facts": new_facts, "facts_reinforced": more_facts, "skills": new_skills, "skills_reinforced": more_skills, "plans": new_plans, "plan_edges": edges}
    shrunk = due.join(records.select("id", F.col("salience").alias("before")), "id").where(F.col("salience") != F.col("before"))
    counted = [("episodes_compressed", shrunk), ("facts_created", new_facts), ("facts_reinforced", more_facts), ("skills_created", new_skills), ("skills_reinforced", more_skills), ("plans_created", new_plans)]
    rows = [df.agg(F.lit(name).alias("counter"), F.count(F.lit(1)).alias("n")) for name, df in counted]
    total = rows[0]
    for r in rows[1:]:
        total = total.unionByName(r)
    return out, total


# Who consolidates what, and the tags of what is made.
ACTORS = {"facts": "consolidation/semantic", "skills": "consolidation/competence", "plans": "consolidation/plangraph", "triples": "consolidation/semantic_extractor"}
MADE_TAGS = {"skills": ("consolidated", "auto-competence"), "plans": ("consolidated", "auto-plangraph")}


@dataclass(frozen=True)
class Made:
    """Records, edges and audit entries to add."""

    records: DataFrame
    relations: DataFrame
    audit: DataFrame

    def join(self, other: Made) -> Made:
        return Made(self.records.unionByName(other.records), self.relations.unionByName(other.relations), self.audit.unionByName(other.audit))


def _edges(df: DataFrame, predicate: str, as_of: Column) -> DataFrame:
    """Edges of df (source_id, target_id)."""
    return df.select("source_id", F.lit(predicate).alias("predicate"), "target_id", F.lit(1.0).alias("weight"), as_of.alias("created_at"), F.unix_micros(as_of).alias("seq"))


def _audit(df: DataFrame, step: str, action: str, as_of: Column) -> DataFrame:
    return df.select(F.col("id").alias("record_id"), F.lit(action).alias("action"), F.lit(ACTORS[step]).alias("actor"), as_of.alias("at"), "rationale", F.unix_micros(as_of).alias("seq"))


def entity_links(asked: DataFrame, terms: DataFrame, predicate: str, as_of: Column) -> DataFrame:
    """Edges both ways between records and the entities their terms name. ``asked``: id, scope, term; each pair once."""
    hits = store.find_by_term(terms, asked.where(strip("term") != "").select(F.struct("id", "term").alias("query_id"), "term", "scope"))
    pairs = hits.select(F.col("query_id.id").alias("source_id"), F.col("entity_id").alias("target_id")).distinct()
    return store.both_ways(pairs.select("source_id", F.lit(predicate).alias("predicate"), "target_id", F.lit(1.0).alias("weight")), as_of)


def fact_records(found: DataFrame, episodes: DataFrame, terms: DataFrame, as_of: Column, step: str = "facts") -> Made:
    """Semantic records of facts (subject, predicate, object, derived_from): tags, scope, sensitivity and confidence of
    their episode, evidence and provenance of it, the entities they name as their sides, and edges to both.

    ``episodes``: id, scope, sensitivity, confidence, tags. Facts of unknown episodes drop out."""
    src = episodes.select(F.col("id").alias("derived_from"), F.coalesce("scope", F.lit("")).alias("scope"), "sensitivity", "confidence", "tags")
    rows = found.select("subject", "predicate", "object", "derived_from").join(src, "derived_from").withColumn("id", _made_id("fact-", "subject", "predicate", "object", "derived_from"))
    rows = stage(rows)
    sides = [rows.select("id", "scope", F.lit(s).alias("side"), F.col(s).alias("term")) for s in ("subject", "object")]
    asked = sides[0].unionByName(sides[1]).where(strip("term") != "")
    hits = store.find_by_term(terms, asked.select(F.struct("id", "side").alias("query_id"), "term", "scope"))
    by = stage(hits.groupBy(F.col("query_id.id").alias("id")).agg(*[F.max(F.when(F.col("query_id.side") == s, F.col("entity_id"))).alias(f"{s}_entity") for s in ("subject", "object")]))
    full = rows.join(by, "id", "left")
    j = ingest.text_json
    evidence = F.concat(F.lit('[{"source_type":"episodic","source_id":'), j(F.col("derived_from")), F.lit(',"timestamp":'), ingest.when_json(as_of), F.lit("}]"))
    body = ingest._json(
        kind=j(F.lit("semantic")), subject=j(F.coalesce("subject_entity", "subject")), predicate=j(F.col("predicate")), object=j(F.coalesce("object_entity", "object")),
        validity=F.lit('{"mode":"global"}'), evidence=evidence, revision_policy=j(F.lit("replace")),
    )
    records = full.select(
        "id", F.lit("semantic").alias("type"), "sensitivity", "confidence", "scope", derived_tags(F.col("tags")).alias("tags"), as_of.alias("created_at"), as_of.alias("updated_at"), as_of.alias("last_reinforced_at"),
        body.alias("payload_json"), F.lit(ACTORS[step]).alias("created_by"), F.array(store.provenance("observation", F.col("derived_from"), ACTORS[step], as_of)).alias("provenance"),
    )
    edges = _edges(rows.select(F.col("id").alias("source_id"), F.col("derived_from").alias("target_id")), "derived_from", as_of)
    for s in ("subject", "object"):
        named = by.where(F.col(f"{s}_entity").isNotNull()).select(F.col("id").alias("source_id"), F.lit(f"{s}_entity").alias("predicate"), F.col(f"{s}_entity").alias("target_id"), F.lit(1.0).alias("weight"))
        edges = edges.unionByName(store.both_ways(named, as_of))
    why = rows.select("id", F.concat(F.lit("Extracted from episodic record "), "derived_from").alias("rationale"))
    return Made(store.as_records(records), edges, _audit(why, step, "create", as_of))


def skill_records(new: DataFrame, sources: DataFrame, terms: DataFrame, as_of: Column) -> Made:
    """Competence records of new skills (see ``skills``), with an edge to each episode and to the tools that are entities.

    ``sources``: skill_name, record_id (see ``skill_sources``)."""
    rows = new.withColumn("id", _made_id("skill-", "skill_name")).withColumn("signature", F.expr("substring(skill_name, 7)"))
    j = ingest.text_json
    steps = F.transform("recipe", lambda t, i: F.struct(F.format_string("Step %d: invoke %s", i + 1, t).alias("step"), t.alias("tool")))
    stats = F.concat(F.lit('{"success_count":'), F.col("success_count").cast("string"), F.lit(',"failure_count":0,"success_rate":1.0,"last_used_at":'), ingest.when_json(as_of), F.lit("}"))
    body = ingest._json(
        kind=j(F.lit("competence")), skill_name=j(F.col("skill_name")), triggers=F.to_json(F.array(F.struct(F.col("signature").alias("signal")))), recipe=F.to_json(steps),
        required_tools=F.to_json("recipe"), performance=stats, version=j(F.lit("1")),
    )
    per = sources.groupBy("skill_name").agg(F.array_sort(F.collect_list("record_id")).alias("ids"))
    origin = F.transform("ids", lambda x: F.struct(F.lit("outcome").alias("kind"), x.alias("ref"), F.lit(ACTORS["skills"]).alias("created_by"), as_of.alias("timestamp")))
    rows = stage(rows.join(per, "skill_name").withColumns({"payload_json": body, "provenance": origin}))
    records = rows.select(
        "id", F.lit("competence").alias("type"), "sensitivity", "confidence", "scope", F.array(*map(F.lit, MADE_TAGS["skills"])).alias("tags"), as_of.alias("created_at"), as_of.alias("updated_at"), as_of.alias("last_reinforced_at"),
        "payload_json", F.lit(ACTORS["skills"]).alias("created_by"), "provenance",
    )
    edges = _edges(rows.select(F.col("id").alias("source_id"), F.explode("ids").alias("target_id")), "derived_from", as_of)
    edges = edges.unionByName(entity_links(rows.select("id", "scope", F.explode("recipe").alias("term")), terms, "uses", as_of))
    why = F.format_string("Extracted from %d episodic records with pattern %s; policy: sensitivity=max(%s), %s", F.col("success_count"), F.col("signature"), F.col("sensitivity"), F.col("scope_note"))
    return Made(store.as_records(records), edges, _audit(rows.select("id", why.alias("rationale")), "skills", "create", as_of))


def skill_sources(tools: DataFrame, episodes: DataFrame) -> DataFrame:
    """(skill_name, record_id): the episodes whose tools make each pattern. Inputs as of ``skills``."""
    named = tools.select("record_id", strip("tool").alias("tool")).where(F.col("tool") != "")
    bags = named.groupBy("record_id").agg(F.concat(F.lit("skill:"), F.array_join(F.array_sort(F.collect_list("tool")), "+")).alias("skill_name"))
    return bags.join(episodes.select("record_id"), "record_id", "left_semi").select("skill_name", "record_id")


def plan_records(new: DataFrame, edges: DataFrame, nodes: DataFrame, episodes: DataFrame, terms: DataFrame, as_of: Column) -> Made:
    """Plan records of new plans and their edges (see ``plans``), with an edge to their episode and to the entities that
    their operations name. ``nodes``: record_id, node, tool; ``episodes``: id, scope, sensitivity."""
    src = episodes.select(F.col("id").alias("record_id"), F.coalesce("scope", F.lit("")).alias("scope"), "sensitivity")
    ops = nodes.join(new.select("record_id"), "record_id", "left_semi").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("id"), F.coalesce("tool", F.lit("")).alias("op")))).alias("ops"))
    ways = edges.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("from_node").alias("from"), F.col("to_node").alias("to"), "kind"))).alias("ways"))
    rows = new.join(src, "record_id").join(ops, "record_id", "left").join(ways, "record_id", "left").withColumn("id", _made_id("plan-", "record_id"))
    j = ingest.text_json
    stats = F.concat(F.lit('{"execution_count":1,"last_executed_at":'), ingest.when_json(as_of), F.lit("}"))
    body = ingest._json(kind=j(F.lit("plan_graph")), plan_id=j(F.col("id")), version=j(F.lit("1")), intent=j(F.col("intent")), nodes=F.to_json("ops"), edges=F.coalesce(F.to_json("ways"), F.lit("[]")), metrics=stats)
    rows = stage(rows.withColumn("payload_json", body))
    records = rows.select(
        "id", F.lit("plan_graph").alias("type"), "sensitivity", "confidence", "scope", F.array(*map(F.lit, MADE_TAGS["plans"])).alias("tags"), as_of.alias("created_at"), as_of.alias("updated_at"), as_of.alias("last_reinforced_at"),
        "payload_json", F.lit(ACTORS["plans"]).alias("created_by"), F.array(store.provenance("tool_call", F.col("record_id"), ACTORS["plans"], as_of)).alias("provenance"),
    )
    links = _edges(rows.select(F.col("id").alias("source_id"), F.col("record_id").alias("target_id")), "derived_from", as_of)
    links = links.unionByName(entity_links(rows.select("id", "scope", F.explode("ops.op").alias("term")), terms, "uses", as_of))
    why = rows.select("id", F.format_string("Extracted plan graph from episodic record %s (%d nodes)", "record_id", "n_nodes").alias("rationale"))
    return Made(store.as_records(records), links, _audit(why, "plans", "create", as_of))


def upsert_triples(found: DataFrame, facts: DataFrame, episodes: DataFrame, terms: DataFrame, as_of: Column) -> tuple[Made, DataFrame, DataFrame]:
    """(new records, known fact_ids with their matches, triple counts by episode) of extracted triples (see ``triples``).

    ``facts``: id, subject, predicate, object of all semantic records. A triple that a fact says just so reinforces it;
    another becomes a record of the first episode, by id, that says it."""
    per = found.groupBy("subject", "predicate", "object").agg(F.min("record_id").alias("derived_from"), F.count("*").alias("matches"))
    looked = stage(store.find_exact(facts, per))
    new = looked.where(F.col("id").isNull())
    known = looked.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("fact_id")).agg(F.sum("matches").alias("matches"))
    counts = new.groupBy(F.col("derived_from").alias("record_id")).agg(F.count("*").cast("int").alias("triple_count"))
    return fact_records(new, episodes, terms, as_of, "triples"), known, counts


def _made_id(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 32))


def consolidate(snap: store.Snapshot, timeline: DataFrame, nodes: DataFrame, terms: DataFrame, as_of: Column, answers: DataFrame | None = None) -> tuple[store.Snapshot, DataFrame]:
    """All steps over a store, written into its next snapshot: (snapshot, counters).

    ``timeline``, ``nodes``: of the store's episodes, as for ``run_all``; what is known comes from the records' payloads.
    ``answers``: record_id, answer of a model that extracts triples."""
    get = lambda k: F.get_json_object("payload_json", f"$.{k}")
    recs = snap.records.withColumn("outcome", F.when(F.col("type") == "episodic", get("outcome")))
    facts = snap.records.where(F.col("type") == "semantic").select("id", get("subject").alias("subject"), get("predicate").alias("predicate"), get("object").alias("object"), "salience")
    skill = snap.records.where(F.col("type") == "competence").groupBy(get("skill_name").alias("skill_name")).agg(F.min(F.struct("id", "salience")).alias("k")).select("skill_name", F.col("k.id").alias("skill_id"), "k.salience")
    planned = snap.relations.where(F.col("predicate") == "derived_from").join(snap.records.where(F.col("type") == "plan_graph").select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("record_id")).distinct()
    out, counters = run_all(recs, timeline, nodes, facts.select("subject", "predicate", F.col("id").alias("fact_id"), "salience"), skill, planned, as_of)
    episodes = recs.where(F.col("type") == "episodic")
    good = episodes.where(F.col("outcome") == "success").select(F.col("id").alias("record_id"))
    made = fact_records(out["facts"], episodes, terms, as_of)
    made = made.join(skill_records(out["skills"], skill_sources(nodes, good), terms, as_of)).join(plan_records(out["plans"], out["plan_edges"], nodes, episodes, terms, as_of))
    more = out["facts_reinforced"].select(F.col("fact_id").alias("id"), "salience", F.format_string("Reinforced by %d events", F.col("matches")).alias("rationale"), F.lit("facts").alias("step"))
    more = more.unionByName(out["skills_reinforced"].select(F.col("skill_id").alias("id"), "salience", F.format_string("Reinforced: %d episodes match pattern", F.col("matches")).alias("rationale"), F.lit("skills").alias("step")))
    if answers is not None:
        extracted, known, _ = upsert_triples(triples(answers), facts, episodes, terms, as_of)
        fresh = made.records.select("id")
        made = made.join(extracted)
        gain = snap.records.select("id", F.least(F.col("salience") + F.col("reinforcement_gain"), F.lit(1.0)).alias("salience"))
        more = more.unionByName(known.join(gain, known["fact_id"] == gain["id"]).select("id", "salience", F.format_string("Reinforced by %d extracted triples", F.col("matches")).alias("rationale"), F.lit("triples").alias("step")))
        count = lambda df, name: df.agg(F.lit(name).alias("counter"), F.count(F.lit(1)).alias("n"))
        counters = counters.unionByName(count(extracted.records.join(fresh, "id", "left_anti"), "triples_created")).unionByName(count(known, "triples_reinforced"))
    more = stage(more)
    raised = store.set_salience(out["records"].select(*snap.records.columns), more.groupBy("id").agg(F.max("salience").alias("salience")), as_of)
    actor = pick(F.col("step"), ACTORS)
    log = more.select(F.col("id").alias("record_id"), F.lit("reinforce").alias("action"), actor.alias("actor"), as_of.alias("at"), "rationale", F.unix_micros(as_of).alias("seq"))
    # what was made in an earlier run of the same input is not made again
    new = stage(made.records.dropDuplicates(["id"]).join(snap.records.select("id"), "id", "left_anti"))
    fresh = new.select("id")
    edges = made.relations.join(fresh.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(made.relations.join(fresh.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*made.relations.columns))
    audit = made.audit.join(fresh.select(F.col("id").alias("record_id")), "record_id", "left_semi").select(*snap.audit.columns)
    after = snap.having(
        records=raised.unionByName(new.select(*snap.records.columns)), relations=store.add_relations(snap.relations, edges.select(*snap.relations.columns)),
        audit=snap.audit.unionByName(audit).unionByName(log.select(*snap.audit.columns)),
    )
    return after, counters
