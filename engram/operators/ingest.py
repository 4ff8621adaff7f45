"""Ingestion: a batch of typed requests becomes records with payload, provenance and audit entry, or is refused with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.functions.exprs import OUTCOMES, SENSITIVITIES, half_life, pick, record_type, source_confidence
from engram.operators import store
from engram.operators.flatten import with_text
from engram.operators.store import Snapshot

#: The columns of a request; those of other kinds are null. ``args``, ``result``, ``object``, ``active_constraints`` and ``environment``: JSON.
REQUESTS = (
    "request_id string, kind string, source string, timestamp timestamp, tags array<string>, scope string, sensitivity string, event_kind string, ref string, summary string, "
    "tool_name string, args string, result string, depends_on array<string>, subject string, predicate string, object string, target_record_id string, outcome string, "
    "thread_id string, state string, next_actions array<string>, open_questions array<string>, context_summary string, active_constraints string, environment string"
)
ACTOR = "ingestion-service"
# What a source of each kind counts as, and the columns each kind must have.
SOURCE_KINDS = {"event": "event", "tool_output": "tool_call", "observation": "observation", "outcome": "outcome"}
NEEDED = {
    "event": ("event_kind", "ref"), "tool_output": ("tool_name",), "observation": ("subject", "predicate"), "outcome": ("target_record_id", "outcome"), "working_state": ("thread_id", "state"),
}


@dataclass(frozen=True)
class Ingested:
    """records, relations and audit entries to add, the changed targets of outcomes, and refused requests (request_id, reason)."""

    records: DataFrame
    relations: DataFrame
    audit: DataFrame
    changed: DataFrame
    refused: DataFrame


def candidate_violation() -> Column:
    """The first rule that a request breaks, null for a valid one."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [("kind is required", blank("kind")), ("source is required", blank("source")), ("timestamp is required", F.col("timestamp").isNull())]
    rules.append(("sensitivity is unknown", ~blank("sensitivity") & ~F.col("sensitivity").isin(*SENSITIVITIES)))
    rules += [(f"{c} is required", (F.col("kind") == kind) & blank(c)) for kind, cols in NEEDED.items() for c in cols]
    rules.append(("outcome is unknown", (F.col("kind") == "outcome") & ~F.col("outcome").isin(*OUTCOMES)))
    return reduce(lambda acc, x: acc.when(x[1], F.lit(x[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))


def _id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 32))


def _json(**parts: Column) -> Column:
    """An object of texts that are JSON already; null parts are left out."""
    each = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def text_json(c: Column) -> Column:
    """A text as JSON; null stays null."""
    whole = F.to_json(F.struct(c.alias("v")))  # {"v":...}
    return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def _list(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.to_json(c))


def when_json(at: Column) -> Column:
    return text_json(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def payload(node: Column, subject: Column, object_: Column) -> Column:
    """The payload of a request's record by its kind."""
    at, j = when_json(F.col("timestamp")), text_json
    filled = lambda c: j(F.nullif(F.col(c), F.lit("")))
    tool = F.col("kind") == "tool_output"
    event = _json(
        t=at, event_kind=F.when(tool, j(F.lit("tool_call"))).otherwise(j(F.col("event_kind"))), ref=F.when(tool, j(node)).otherwise(j(F.col("ref"))),
        summary=F.when(tool, j(F.concat(F.lit("tool_call: "), "tool_name"))).otherwise(filled("summary")),
    )
    call = _json(id=j(node), tool=j(F.col("tool_name")), args=F.col("args"), result=F.col("result"), timestamp=at, depends_on=_list(F.col("depends_on")))
    wrap = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    episode = _json(kind=j(F.lit("episodic")), timeline=wrap(event), tool_graph=F.when(tool, wrap(call)), environment=F.col("environment"))
    evidence = _json(source_type=j(F.lit("observation")), source_id=j(F.col("source")), timestamp=at)
    fact = _json(kind=j(F.lit("semantic")), subject=j(subject), predicate=j(F.col("predicate")), object=object_, validity=F.lit('{"mode":"global"}'), evidence=wrap(evidence), revision_policy=j(F.lit("replace")))
    work = _json(
        kind=j(F.lit("working")), thread_id=j(F.col("thread_id")), state=j(F.col("state")), active_constraints=F.col("active_constraints"), next_actions=_list(F.col("next_actions")),
        open_questions=_list(F.col("open_questions")), context_summary=filled("context_summary"),
    )
    return F.when(F.col("type") == "semantic", fact).when(F.col("type") == "working", work).otherwise(episode)


def ingest(requests: DataFrame, records: DataFrame, terms: DataFrame, as_of: Column) -> Ingested:
    """All requests of a batch; nothing is written here, see ``apply``.

    ``requests``: ``REQUESTS`` (absent columns are null); ``terms``: of the entities, see ``store.entity_terms``. Rows of
    one request_id are one request: the smallest; without an id they have none. Events, tool outputs and working states
    become records; an observation becomes a fact whose subject and object are the entities they name, with edges both
    ways; an outcome changes the episode it names: with several for one episode the latest holds, and all are logged.
    Without a timestamp a request counts as of ``as_of``.
    """
    fields = StructType.fromDDL(REQUESTS)
    given = requests.select(*[(F.col(f.name) if f.name in requests.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    one = given.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min(F.struct(*[f.name for f in fields if f.name != "request_id"])).alias("r")).select("request_id", "r.*")
    one = one.withColumn("timestamp", F.coalesce("timestamp", as_of)).withColumn("reason", candidate_violation())
    good = one.where(F.col("reason").isNull())
    new = good.where(F.col("kind") != "outcome").withColumns({"id": _id("rec-", F.col("request_id")), "node": _id("node-", F.col("request_id")), "type": record_type(F.col("kind")), "scope": F.coalesce("scope", F.lit(""))})
    named = new.where(F.col("type") == "semantic").withColumn("object_text", F.get_json_object(F.concat(F.lit('{"v":'), F.col("object"), F.lit("}")), "$.v")).withColumn("object_text", F.when(F.startswith(F.trim("object"), F.lit('"')), F.col("object_text")))
    asked = named.select("id", "scope", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("term")) for k, c in (("subject", "subject"), ("object", "object_text"))])).alias("q")).select("id", "scope", "q.side", "q.term")
    found = store.find_by_term(terms, asked.where(F.col("term").isNotNull()).select(F.struct("id", "side").alias("query_id"), "term", "scope")).select("query_id.id", "query_id.side", "entity_id")
    sides = found.groupBy("id").agg(*[F.max(F.when(F.col("side") == k, F.col("entity_id"))).alias(f"{k}_entity") for k in ("subject", "object")])
    ready = new.join(sides, "id", "left")
    body = payload(F.col("node"), F.coalesce("subject_entity", "subject"), F.coalesce(text_json(F.col("object_entity")), "object"))
    kind = pick(F.col("kind"), SOURCE_KINDS, F.lit("event"))
    ref = F.when(F.col("kind") == "event", F.col("ref")).when(F.col("kind") == "tool_output", F.col("node")).when(F.col("kind") == "working_state", F.col("thread_id")).otherwise(F.col("source"))
    source = F.array(F.struct(kind.alias("kind"), ref.alias("ref"), F.col("source").alias("created_by"), F.col("timestamp").alias("timestamp")))
    rows = ready.select(
        "id", "type", F.coalesce(F.nullif("sensitivity", F.lit("")), F.lit("low")).alias("sensitivity"), source_confidence(F.col("kind")).alias("confidence"), "scope", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        as_of.alias("created_at"), as_of.alias("updated_at"), as_of.alias("last_reinforced_at"), half_life(F.col("type")).alias("half_life_seconds"), body.alias("payload_json"), F.lit(ACTOR).alias("created_by"), source.alias("provenance"),
    )
    edges = store.both_ways(
        found.select(F.col("id").alias("source_id"), F.concat("side", F.lit("_entity")).alias("predicate"), F.col("entity_id").alias("target_id"), F.lit(1.0).alias("weight")), as_of
    )
    made = ready.select(F.col("id").alias("record_id"), F.lit("create").alias("action"), F.lit(ACTOR).alias("actor"), as_of.alias("at"), F.concat(F.lit("Ingested "), "kind", F.lit(" from "), "source").alias("rationale"), F.unix_micros(as_of).alias("seq"))
    changed, revised, lost = _outcomes(good.where(F.col("kind") == "outcome"), records)
    refused = one.where(F.col("reason").isNotNull()).select("request_id", "reason").unionByName(lost)
    return Ingested(store.as_records(rows), edges, made.unionByName(revised), changed, refused)


def _outcomes(said: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changed episodes, their audit entries, and refused requests."""
    known = records.select(F.col("id").alias("target_record_id"), F.col("type").alias("target_type"))
    checked = said.join(known, "target_record_id", "left")
    bad = F.when(F.col("target_type").isNull(), "target record not found").when(F.col("target_type") != "episodic", "target record is not episodic")
    lost = checked.withColumn("reason", bad).where(F.col("reason").isNotNull()).select("request_id", "reason")
    fine = checked.where(F.col("target_type") == "episodic")
    ref = F.concat_ws(":", F.lit("outcome"), "target_record_id", "outcome")
    per = fine.groupBy(F.col("target_record_id").alias("id")).agg(
        F.max(F.struct("timestamp", "request_id", "outcome")).alias("__last"),
        F.array_sort(F.collect_list(F.struct("timestamp", "request_id", ref.alias("ref"), "source"))).alias("__all"),
    )
    sources = F.transform("__all", lambda x: F.struct(F.lit("outcome").alias("kind"), x["ref"].alias("ref"), x["source"].alias("created_by"), x["timestamp"].alias("timestamp"))).cast(store.SOURCE)
    changed = records.join(per, "id").withColumns(
        {
            "payload_json": with_text(F.col("payload_json"), "outcome", F.col("__last.outcome")),
            "updated_at": F.col("__last.timestamp"),
            "provenance": F.concat(F.coalesce("provenance", F.array().cast(store.SOURCE)), sources),
        }
    ).select(*records.columns)
    log = fine.select(F.col("target_record_id").alias("record_id"), F.lit("revise").alias("action"), F.col("source").alias("actor"), F.col("timestamp").alias("at"), F.concat(F.lit("Outcome recorded: "), "outcome").alias("rationale"), F.unix_micros("timestamp").alias("seq"))
    return changed, log, lost


def apply(snap: Snapshot, batch: Ingested) -> Snapshot:
    """The snapshot with a batch: all of its records, edges, changes and audit entries, or none."""
    ids = batch.changed.select("id")
    snap = snap.having(records=snap.records.join(ids, "id", "left_anti").unionByName(batch.changed.select(*snap.records.columns)))
    return store.create(snap, batch.records, batch.relations, batch.audit.select(*snap.audit.columns))
