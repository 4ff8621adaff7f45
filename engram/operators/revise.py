"""The revision algebra: supersede, fork, retract, merge, contest; each gives a whole new snapshot or raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import pick
from engram.operators import store
from engram.operators.store import Invalid, NotFound, NotRevisable, Snapshot
from engram.plans.staging import stage


def _checked(snap: Snapshot, ids: Sequence[str]) -> None:
    spark = snap.records.sparkSession
    wanted = spark.createDataFrame([(i,) for i in set(ids)], "id string")
    found = {r["id"]: r["type"] for r in snap.records.join(F.broadcast(wanted), "id").select("id", "type").collect()}
    for i in ids:
        if i not in found:
            raise NotFound(i)
        if found[i] == "episodic":
            raise NotRevisable(f"{i}: episodic records are not revised")


def _evidence(new: DataFrame) -> None:
    """A semantic record needs evidence in its payload, or a source in its provenance."""
    if not new.where(lacks_evidence()).isEmpty():
        raise NotRevisable("a semantic revision needs evidence")


def lacks_evidence() -> Column:
    told = F.coalesce(F.json_array_length(F.get_json_object("payload_json", "$.evidence")), F.lit(0))
    return (F.col("type") == "semantic") & (told == 0) & (F.coalesce(F.size("provenance"), F.lit(0)) <= 0)


def _mark(snap: Snapshot, ids: Sequence[str], as_of: Column, status: str, zero: bool) -> DataFrame:
    hit = F.col("id").isin(*ids)
    return snap.records.withColumns(
        {
            "salience": F.when(hit & F.lit(zero), 0.0).otherwise(F.col("salience")),
            "status": F.when(hit & (F.col("type") == "semantic"), status).otherwise(F.col("status")),
            "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        }
    )


def _entry(snap: Snapshot, audit: DataFrame, ids: Sequence[str], action: str, actor: str, as_of: Column, why: str) -> DataFrame:
    rows = snap.records.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return store.log_entries(audit, rows, action, actor, as_of, why)


def _edges(snap: Snapshot, source: str, predicate: str, targets: Sequence[str], as_of: Column) -> DataFrame:
    rows = snap.records.sparkSession.createDataFrame([(source, predicate, t, i) for i, t in enumerate(targets)], "source_id string, predicate string, target_id string, n long")
    new = rows.select("source_id", "predicate", "target_id", F.lit(1.0).alias("weight"), as_of.alias("created_at"), (F.unix_micros(as_of) + F.col("n")).alias("seq"))
    return store.add_relations(snap.relations, new)


def _added(snap: Snapshot, records: DataFrame, new: DataFrame) -> tuple[DataFrame, str]:
    row = new.select("id").collect()
    if len(row) != 1:
        raise Invalid("one new record is needed")
    if not snap.records.join(new.select("id"), "id", "left_semi").isEmpty():
        raise store.AlreadyExists(row[0]["id"])
    return records.unionByName(new.select(*records.columns)), row[0]["id"]


def supersede(snap: Snapshot, old_id: str, new: DataFrame, actor: str, rationale: str, as_of: Column) -> Snapshot:
    """The old record is retracted and points to the new one, which replaces it and names it as its source."""
    _checked(snap, [old_id])
    _evidence(new)
    fact = F.col("type") == "semantic"
    source = F.array(store.provenance("event", F.lit(old_id), actor, as_of)).cast(store.SOURCE)
    ready = new.withColumns(
        {
            "status": F.when(fact, "active"), "supersedes": F.when(fact, old_id), "created_at": as_of, "updated_at": as_of,
            "provenance": F.concat(F.coalesce("provenance", F.array().cast(store.SOURCE)), source),
        }
    )
    marked = _mark(snap, [old_id], as_of, "retracted", True)
    records, new_id = _added(snap, marked, ready)
    on = (F.col("id") == old_id) & fact
    records = records.withColumn("superseded_by", F.when(on, new_id).otherwise(F.col("superseded_by")))
    audit = _entry(snap, snap.audit, [old_id], "revise", actor, as_of, f"superseded by {new_id}: {rationale}")
    audit = _entry(snap, audit, [new_id], "create", actor, as_of, f"supersedes {old_id}: {rationale}")
    return snap.having(records=records, relations=_edges(snap, new_id, "supersedes", [old_id], as_of), audit=audit)


def fork(snap: Snapshot, source_id: str, new: DataFrame, actor: str, rationale: str, as_of: Column) -> Snapshot:
    """Both records stay active; the new one derives from the source."""
    _checked(snap, [source_id])
    _evidence(new)
    records, new_id = _added(snap, snap.records, new)
    audit = _entry(snap, snap.audit, [source_id], "fork", actor, as_of, f"forked to {new_id}: {rationale}")
    audit = _entry(snap, audit, [new_id], "create", actor, as_of, f"forked from {source_id}: {rationale}")
    return snap.having(records=records, relations=_edges(snap, new_id, "derived_from", [source_id], as_of), audit=audit)


def retract(snap: Snapshot, record_id: str, actor: str, rationale: str, as_of: Column) -> Snapshot:
    """The record stays, without salience."""
    _checked(snap, [record_id])
    return snap.having(records=_mark(snap, [record_id], as_of, "retracted", True), audit=_entry(snap, snap.audit, [record_id], "delete", actor, as_of, rationale))


def merge(snap: Snapshot, ids: Sequence[str], merged: DataFrame, actor: str, rationale: str, as_of: Column) -> Snapshot:
    """All sources are retracted; the merged record derives from each."""
    if not ids:
        raise Invalid("nothing to merge")
    _checked(snap, ids)
    _evidence(merged)
    records, new_id = _added(snap, _mark(snap, ids, as_of, "retracted", True), merged)
    audit = _entry(snap, snap.audit, ids, "merge", actor, as_of, f"merged into {new_id}: {rationale}")
    audit = _entry(snap, audit, [new_id], "create", actor, as_of, f"merged from {', '.join(ids)}: {rationale}")
    return snap.having(records=records, relations=_edges(snap, new_id, "derived_from", ids, as_of), audit=audit)


def contest(snap: Snapshot, record_id: str, by_id: str, actor: str, rationale: str, as_of: Column) -> Snapshot:
    """The record is marked as contested by another, which must exist; its salience stays."""
    _checked(snap, [record_id])
    if snap.records.where(F.col("id") == by_id).isEmpty():
        raise NotFound(by_id)
    return snap.having(
        records=_mark(snap, [record_id], as_of, "contested", False),
        relations=_edges(snap, record_id, "contested_by", [by_id], as_of),
        audit=_entry(snap, snap.audit, [record_id], "revise", actor, as_of, rationale),
    )


def supersede_many(facts: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    """Bulk form over a fact table: for each (old_id, new_id) the old fact is retracted and linked, in one pass."""
    p = pairs.groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("__new"))
    on = F.col("__new").isNotNull()
    return (
        facts.join(p, "id", "left")
        .withColumns(
            {
                "salience": F.when(on, 0.0).otherwise(F.col("salience")),
                "status": F.when(on, "retracted").otherwise(F.col("status")),
                "superseded_by": F.coalesce("__new", "superseded_by"),
                "updated_at": F.when(on, as_of).otherwise(F.col("updated_at")),
            }
        )
        .drop("__new")
    )


# What each operation does to the old record, and the edge it draws: predicate, and whether from the new record.
OPERATIONS = {"supersede": ("retracted", "supersedes"), "merge": ("retracted", "derived_from"), "fork": (None, "derived_from"), "retract": ("retracted", None), "contest": ("contested", "contested_by")}
ACTIONS = {"supersede": "revise", "merge": "merge", "fork": "fork", "retract": "delete", "contest": "revise"}
MADE = "create"


def revise_many(snap: Snapshot, changes: DataFrame, new: DataFrame, as_of: Column) -> tuple[Snapshot, DataFrame]:
    """Any number of revisions in one pass: (snapshot, refused).

    ``changes``: op, old_id, new_id, actor, rationale; new_id is the record that replaces, derives from or contests the
    old one (of a retraction: null). A merge has one row for each source. ``new``: the records to add. An operation is
    done whole or refused whole, with the reason: all rows of one new_id are one operation, as are all of one retraction.
    Where one record is changed by several operations the first in order of (op, new_id) marks it, and all are logged.
    """
    none = lambda t: F.lit(None).cast(t)
    asked = changes.select("op", "old_id", "new_id", F.coalesce("actor", F.lit("")).alias("actor"), F.coalesce("rationale", F.lit("")).alias("rationale")).distinct()
    asked = asked.withColumn("unit", F.concat_ws("\x1f", "op", F.when(F.col("op").isin("retract", "contest"), F.concat_ws("\x1f", "old_id", "new_id")).otherwise(F.col("new_id"))))
    known = snap.records.select(F.col("id").alias("old_id"), F.col("type").alias("old_type"))
    others = snap.records.select(F.col("id").alias("new_id"), F.lit(True).alias("new_there"))
    made = new.groupBy(F.col("id").alias("new_id")).agg(F.count("*").alias("n_new"), F.max(lacks_evidence()).alias("bare"))
    seen = asked.join(known, "old_id", "left").join(others, "new_id", "left").join(made, "new_id", "left")
    makes = F.col("op").isin("supersede", "merge", "fork")
    reason = (
        F.when(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)), "unknown operation")
        .when(F.col("old_type").isNull(), "record not found")
        .when(F.col("old_type") == "episodic", "episodic records are not revised")
        .when(makes & F.col("new_there"), "new record exists")
        .when(makes & F.col("n_new").isNull(), "new record is missing")
        .when(makes & (F.col("n_new") > 1), "one new record is needed")
        .when(makes & F.col("bare"), "a semantic revision needs evidence")
        .when((F.col("op") == "contest") & F.col("new_there").isNull(), "contesting record not found")
    )
    checked = stage(seen.withColumn("reason", reason).select("op", "old_id", "new_id", "actor", "rationale", "unit", "reason"))
    refused = checked.groupBy("unit").agg(F.min("reason").alias("reason")).where(F.col("reason").isNotNull())
    done = stage(checked.drop("reason").join(refused.select("unit"), "unit", "left_anti"))
    state = pick(F.col("op"), {k: v[0] for k, v in OPERATIONS.items() if v[0]}, none("string"))
    marks = done.withColumn("state", state).where(F.col("state").isNotNull()).groupBy(F.col("old_id").alias("id")).agg(
        F.max(F.when(F.col("state") == "retracted", True).otherwise(False)).alias("__gone"), F.min(F.struct("op", "new_id", "state")).alias("__m"),
        F.min(F.when(F.col("op") == "supersede", F.col("new_id"))).alias("__by"),
    )
    fact, hit = F.col("type") == "semantic", F.col("__m").isNotNull()
    old = snap.records.join(marks, "id", "left").withColumns(
        {
            "salience": F.when(F.col("__gone"), 0.0).otherwise(F.col("salience")),
            "status": F.when(hit & fact, F.when(F.col("__gone"), "retracted").otherwise(F.col("__m.state"))).otherwise(F.col("status")),
            "superseded_by": F.when(fact, F.coalesce("__by", "superseded_by")).otherwise(F.col("superseded_by")),
            "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*snap.records.columns)
    wanted = done.where(makes).groupBy(F.col("new_id").alias("id")).agg(
        F.max(F.col("op") == "supersede").alias("__s"), F.min(F.when(F.col("op") == "supersede", F.col("old_id"))).alias("__old"), F.min("actor").alias("__actor")
    )
    on = F.col("__s") & fact
    source = F.array(store.provenance("event", F.col("__old"), F.col("__actor"), as_of)).cast(store.SOURCE)
    own = F.coalesce("provenance", F.array().cast(store.SOURCE))
    added = new.join(wanted, "id").withColumns(
        {
            "status": F.when(on, "active").otherwise(F.col("status")), "supersedes": F.when(on, F.col("__old")).otherwise(F.col("supersedes")),
            "provenance": F.when(F.col("__s"), F.concat(own, source)).otherwise(own),
            "created_at": F.when(F.col("__s"), as_of).otherwise(F.col("created_at")), "updated_at": F.when(F.col("__s"), as_of).otherwise(F.col("updated_at")),
        }
    ).select(*snap.records.columns)
    predicate = pick(F.col("op"), {k: v[1] for k, v in OPERATIONS.items() if v[1]}, none("string"))
    back = F.col("op") == "contest"
    edges = done.withColumn("predicate", predicate).where(F.col("predicate").isNotNull()).select(
        F.when(back, F.col("old_id")).otherwise(F.col("new_id")).alias("source_id"), "predicate", F.when(back, F.col("new_id")).otherwise(F.col("old_id")).alias("target_id"),
        F.lit(1.0).alias("weight"), as_of.alias("created_at"), F.unix_micros(as_of).alias("seq"),
    )
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(": "), F.col("rationale"))
    new_id, old_id = F.col("new_id"), F.col("old_id")
    of_old = F.when(F.col("op") == "supersede", said("superseded by ", new_id)).when(F.col("op") == "fork", said("forked to ", new_id)).when(F.col("op") == "merge", said("merged into ", new_id)).otherwise(F.col("rationale"))
    of_new = F.when(F.col("op") == "supersede", said("supersedes ", F.col("olds"))).when(F.col("op") == "fork", said("forked from ", F.col("olds"))).otherwise(said("merged from ", F.col("olds")))
    log = lambda df, id_, action, why: df.select(id_.alias("record_id"), action.alias("action"), "actor", as_of.alias("at"), why.alias("rationale"), F.unix_micros(as_of).alias("seq"))
    units = done.where(makes).groupBy("op", "new_id").agg(F.array_join(F.array_sort(F.collect_list("old_id")), ", ").alias("olds"), F.min("actor").alias("actor"), F.min("rationale").alias("rationale"))
    audit = log(done, old_id, pick(F.col("op"), ACTIONS), of_old).unionByName(log(units, new_id, F.lit(MADE), of_new))
    after = snap.having(records=old.unionByName(added), relations=store.add_relations(snap.relations, edges), audit=snap.audit.unionByName(audit.select(*snap.audit.columns)))
    return after, checked.drop("reason").join(refused, "unit").select("op", "old_id", "new_id", "reason")
