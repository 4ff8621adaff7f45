"""Retrieval quality: recall, precision, MRR and NDCG at k, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_k(ranked: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query (query_id, k): recall, precision, mrr, ndcg.

    ``ranked``: query_id, id, rank from 1; ``expected``: query_id, id. Precision divides by k. A query that expects
    nothing has recall and NDCG 1, and precision and MRR 0.
    """
    want = expected.select("query_id", "id").distinct()
    hits = ranked.join(queries.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).join(want, ["query_id", "id"])
    got = hits.groupBy("query_id").agg(F.count_distinct("id").alias("hit"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = want.groupBy("query_id").agg(F.count("*").alias("n"))
    df = queries.select("query_id", "k").join(n, "query_id", "left").join(got, "query_id", "left").fillna(0, ["n", "hit"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("k", "n").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    none = F.col("n") == 0
    return df.select(
        "query_id",
        F.when(none, 1.0).otherwise(F.try_divide("hit", "n")).alias("recall"),
        F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("k").cast("double")), F.lit(0.0)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(none, 1.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


def baseline(ranked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pure vector order within the allowed records, ranks closed up."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.join(allowed, ["query_id", "id"], "left_semi").withColumn("rank", F.row_number().over(w))


def compare(ours: DataFrame, other: DataFrame, metric: str = "ndcg") -> DataFrame:
    """Wins, losses and ties of one ranking against another, over the queries both have."""
    b = other.select("query_id", F.col(metric).alias("__b"))
    return ours.join(b, "query_id").agg(
        F.count_if(F.col(metric) > F.col("__b")).alias("wins"), F.count_if(F.col(metric) < F.col("__b")).alias("losses"), F.count_if(F.col(metric) == F.col("__b")).alias("ties")
    )
