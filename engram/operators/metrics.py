"""The metrics snapshot: one pass over the records and one over the audit entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import TYPES

#: The salience buckets and their upper ends.
BUCKETS = (("0.0-0.2", 0.2), ("0.2-0.4", 0.4), ("0.4-0.6", 0.6), ("0.6-0.8", 0.8), ("0.8-1.0", None))


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def record_metrics(records: DataFrame, as_of: Column) -> DataFrame:
    """Counts, averages and growth. Uses success_rate and execution_count where the records have them."""
    recent = F.unix_micros("created_at") > F.unix_micros(as_of) - 86_400_000_000
    extra = {"competence_success_rate": "success_rate", "plan_reuse_frequency": "execution_count"}
    return records.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("salience") > 0).alias("active_records"),
        F.count_if("pinned").alias("pinned_records"),
        F.coalesce(F.avg("salience"), F.lit(0.0)).alias("avg_salience"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        ratio(F.count_if(recent), F.count("*")).alias("memory_growth_rate"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES],
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for name, c in extra.items() if c in records.columns],
    )


def audit_metrics(audit: DataFrame) -> DataFrame:
    """Entries, and the shares of reinforcements and of revisions (revise, fork, merge) among them."""
    return audit.agg(
        F.count("*").alias("total_audit_entries"),
        ratio(F.count_if(F.col("action") == "reinforce"), F.count("*")).alias("retrieval_usefulness"),
        ratio(F.count_if(F.col("action").isin("revise", "fork", "merge")), F.count("*")).alias("revision_rate"),
    )


def collect(records: DataFrame, audit: DataFrame, as_of: Column) -> DataFrame:
    """All metrics as one row; zeros for an empty store."""
    return record_metrics(records, as_of).join(F.broadcast(audit_metrics(audit)))


def histogram(records: DataFrame) -> DataFrame:
    """(bucket, records) for all five salience buckets, also empty ones."""
    low, counts = None, []
    for name, high in BUCKETS:
        in_ = F.lit(True) if high is None else F.col("salience") < high
        in_ = in_ if low is None else in_ & (F.col("salience") >= low)
        counts.append(F.struct(F.lit(name).alias("bucket"), F.count_if(in_).alias("records")))
        low = high
    return records.agg(F.array(*counts).alias("b")).select(F.inline("b"))
