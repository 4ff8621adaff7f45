"""Trust: which records a context may see, in full or redacted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import SENSITIVITIES, sensitivity_rank


@dataclass(frozen=True)
class Trust:
    """``authenticated`` and ``actor_id`` are carried and not checked; without scopes all scopes are visible."""

    max_sensitivity: str = "low"
    scopes: tuple[str, ...] = ()
    authenticated: bool = False
    actor_id: str = ""

    @property
    def rank(self) -> int:
        return SENSITIVITIES.index(self.max_sensitivity) if self.max_sensitivity in SENSITIVITIES else -1


def in_scope(trust: Trust) -> Column:
    scope = F.coalesce("scope", F.lit(""))
    return F.lit(True) if not trust.scopes else (scope == "") | scope.isin(*trust.scopes)


def allows(trust: Trust) -> Column:
    """Seen in full: both sensitivities known, the record's not above the context's, its scope visible."""
    rank = sensitivity_rank(F.col("sensitivity"))
    return (rank >= 0) & (rank <= trust.rank) & in_scope(trust) if trust.rank >= 0 else F.lit(False)


def allows_redacted(trust: Trust) -> Column:
    """Seen redacted: exactly one level above the context, scope visible."""
    return (sensitivity_rank(F.col("sensitivity")) == trust.rank + 1) & in_scope(trust) if trust.rank >= 0 else F.lit(False)


#: What a redacted record still shows; other columns become null, lifecycle columns neutral.
SHOWN = ("id", "type", "sensitivity", "confidence", "salience", "scope", "tags", "created_at", "updated_at")
NEUTRAL = {"half_life_seconds": 0, "pinned": False, "deletion_policy": "auto_prune", "min_salience": 0.0, "max_age_seconds": 0, "reinforcement_gain": 0.0}


def redact(records: DataFrame, when: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hide all but the envelope where ``when`` holds; ``keep``: further columns that stay."""
    cols = []
    for f in records.schema:
        hidden = F.lit(NEUTRAL.get(f.name)).cast(f.dataType)
        cols.append(F.col(f.name) if f.name in SHOWN + keep else F.when(when, hidden).otherwise(F.col(f.name)).alias(f.name))
    return records.select(*cols)


def visible(records: DataFrame, trust: Trust | None) -> DataFrame:
    """The records a context may see, with ``redacted``; without a context all in full."""
    if trust is None:
        return records.withColumn("redacted", F.lit(False))
    flagged = records.where(allows(trust) | allows_redacted(trust)).withColumn("redacted", ~allows(trust))
    return redact(flagged, F.col("redacted"), ("redacted",))


def up_to(records: DataFrame, max_sensitivity: str) -> DataFrame:
    """By sensitivity alone; an unknown level shows nothing."""
    rank = sensitivity_rank(F.col("sensitivity"))
    return records.where((rank >= 0) & (rank <= Trust(max_sensitivity).rank))
