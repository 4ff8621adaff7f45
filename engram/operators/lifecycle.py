"""Salience over time: decay, reinforcement, penalties and pruning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import decayed, seconds_between
from engram.operators import store

#: Salience below which a record counts as gone.
GONE = 0.001
ACTOR = "decay-service"


#: Curves by name: salience, elapsed seconds, half-life, floor -> salience. Others may be added.
CURVES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {"exponential": decayed}


def decayed_salience(as_of: Column, curve: str = "exponential") -> Column:
    """A record's salience at ``as_of``: 0 beyond its maximal age, else decayed since its last reinforcement.

    The floor does not lift what the maximal age or an earlier step brought to 0. The clock is not reset, so repeated
    sweeps compound.
    """
    old = (F.col("max_age_seconds") > 0) & (seconds_between(F.col("created_at"), as_of) >= F.col("max_age_seconds"))
    elapsed = F.coalesce(seconds_between(F.col("last_reinforced_at"), as_of), F.lit(0.0))
    s = F.when(old, 0.0).otherwise(F.col("salience"))
    s = F.when(s > 0, CURVES[curve](s, elapsed, F.col("half_life_seconds"), F.col("min_salience"))).otherwise(s)
    return F.when(F.isnan(s) | (s == math.inf), F.col("min_salience")).when(s < 0, 0.0).otherwise(s)


def sweep(records: DataFrame, as_of: Column) -> DataFrame:
    """Decay all records that aren't pinned."""
    move = ~F.coalesce("pinned", F.lit(False))
    return records.withColumns(
        {"salience": F.when(move, decayed_salience(as_of)).otherwise(F.col("salience")), "updated_at": F.when(move, as_of).otherwise(F.col("updated_at"))}
    )


def sweep_rationale(before: DataFrame, as_of: Column) -> DataFrame:
    """(id, rationale) of the audit entries of a sweep."""
    elapsed = F.coalesce(seconds_between(F.col("last_reinforced_at"), as_of), F.lit(0.0))
    text = F.format_string("decay applied: %.4f -> %.4f (elapsed %.0fs)", "salience", decayed_salience(as_of), elapsed)
    return before.where(~F.coalesce("pinned", F.lit(False))).select("id", text.alias("rationale"))


def reinforce(records: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Add each record's gain, up to 1 (also down to it), and restart its clock. ``ids``: id."""
    hit = records.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    on = F.coalesce("__hit", F.lit(False))
    return hit.withColumns(
        {
            "salience": F.when(on, F.least(F.col("salience") + F.col("reinforcement_gain"), F.lit(1.0))).otherwise(F.col("salience")),
            "last_reinforced_at": F.when(on, as_of).otherwise(F.col("last_reinforced_at")),
            "updated_at": F.when(on, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*records.columns)


def penalize(records: DataFrame, amounts: DataFrame, as_of: Column) -> DataFrame:
    """Take off an amount (id, amount), down to the record's floor. Amounts must be finite and not negative."""
    bad = amounts.where(F.col("amount").isNull() | F.isnan("amount") | (F.col("amount") < 0) | (F.col("amount") == math.inf))
    if not bad.isEmpty():
        raise store.Invalid("amount must be finite and not negative")
    total = amounts.groupBy("id").agg(F.sum("amount").alias("__amount"))
    hit = records.join(total, "id", "left")
    on = F.col("__amount").isNotNull()
    return hit.withColumns(
        {
            "salience": F.when(on, F.greatest(F.col("salience") - F.col("__amount"), F.col("min_salience"))).otherwise(F.col("salience")),
            "updated_at": F.when(on, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*records.columns)


def reinforced(snap: store.Snapshot, ids: DataFrame, actor: str, rationale: str, as_of: Column) -> store.Snapshot:
    """``reinforce`` with an audit entry for each record."""
    known = ids.select("id").distinct().join(snap.records.select("id"), "id", "left_semi")
    return snap.having(records=reinforce(snap.records, ids, as_of), audit=store.log_entries(snap.audit, known, "reinforce", actor, as_of, rationale))


def penalized(snap: store.Snapshot, amounts: DataFrame, actor: str, rationale: str, as_of: Column) -> store.Snapshot:
    """``penalize`` with an audit entry for each record."""
    known = amounts.select("id").distinct().join(snap.records.select("id"), "id", "left_semi")
    return snap.having(records=penalize(snap.records, amounts, as_of), audit=store.log_entries(snap.audit, known, "decay", actor, as_of, f"penalty: {rationale}"))


def prunable() -> Column:
    """Not pinned, pruned automatically, at its floor and practically gone."""
    return (
        ~F.coalesce("pinned", F.lit(False))
        & (F.coalesce("deletion_policy", F.lit("auto_prune")) == "auto_prune")
        & (F.col("salience") <= F.col("min_salience"))
        & (F.col("salience") < GONE)
    )


def prune(snap: store.Snapshot, as_of: Column) -> tuple[store.Snapshot, DataFrame]:
    """The snapshot without the prunable records, and the audit entries of their removal (kept apart as tombstones)."""
    ids = snap.records.where(prunable()).select("id")
    tomb = store.log_entries(snap.audit.limit(0), ids, "delete", ACTOR, as_of, "auto-pruned: salience reached floor")
    return store.delete(snap, ids), tomb


def decay_and_prune(snap: store.Snapshot, as_of: Column) -> store.Snapshot:
    """What the scheduler does each period."""
    notes = sweep_rationale(snap.records, as_of)
    audit = store.log_entries(snap.audit, notes, "decay", ACTOR, as_of, F.col("rationale"))
    after = snap.having(records=sweep(snap.records, as_of), audit=audit)
    return prune(after, as_of)[0]
