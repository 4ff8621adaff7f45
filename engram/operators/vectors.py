"""An inverted-file index over stored vectors: every vector in the list of its nearest centroid, searches probe a few lists.

The centroids come from a bounded sample (``SAMPLE`` vectors, by a hash of their ids); every vector is indexed. What a
search may miss is measured by ``recall`` against all vectors. With as many probes as lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.staging import stage

#: Vectors that the centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 10_000, 10
#: Vectors of a list that one task compares at once: large lists are split.
BLOCK = 1_024


@dataclass(frozen=True)
class Index:
    """centroids (unit vectors), and rows: record_id, embedding, list."""

    centroids: np.ndarray
    rows: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _fit(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Spherical k-means."""
    rnd = np.random.default_rng(seed)
    x = _unit(x)
    c = x[rnd.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        there = np.linalg.norm(total, axis=1) > 0
        c[there] = _unit(total[there])
    return c


def build(embeddings: DataFrame, dimensions: int, lists: int = 100, sample: int = SAMPLE, seed: int = 0) -> Index:
    """The index of all vectors (record_id, embedding) of this size; others, and null ones, are in none."""
    rows = embeddings.where(F.size("embedding") == dimensions).select("record_id", F.col("embedding").cast("array<float>").alias("embedding"))
    some = rows.orderBy(F.xxhash64("record_id", F.lit(seed)), "record_id").limit(sample).toPandas()  # ``sample`` vectors at most
    centroids = _fit(np.array(some["embedding"].tolist(), np.float32), lists, seed) if len(some) else np.zeros((1, dimensions), np.float32)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _unit(np.array(pdf["embedding"].tolist(), np.float32))
                yield pdf.assign(list=np.argmax(x @ centroids.T, axis=1).astype(np.int32))

    return Index(centroids, stage(rows.mapInPandas(assign, "record_id string, embedding array<float>, list int")))


def search(index: Index, queries: DataFrame, k: int, probes: int = 10) -> DataFrame:
    """(query_id, record_id, similarity, rank from 0): the ``k`` nearest in the ``probes`` nearest lists, ties by id.

    ``queries``: query_id, embedding. The vectors of a list are compared in blocks, of which each gives its best ``k``."""
    centroids, probes = index.centroids, min(probes, len(index.centroids))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q = np.array(pdf["embedding"].tolist(), np.float32)
                near = np.argsort(-(_unit(q) @ centroids.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), probes), "q": [v for v in q for _ in range(probes)], "list": near.ravel().astype(np.int32)})

    asked = queries.where(F.size("embedding") == centroids.shape[1]).select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    routed = asked.mapInPandas(route, "query_id string, q array<float>, list int")
    sizes = index.rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # one row for each list
    block = F.pmod(F.xxhash64("record_id"), F.col("blocks"))
    packed = index.rows.join(F.broadcast(sizes), "list").groupBy("list", block.alias("block")).agg(F.collect_list("record_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("flat"))
    # a list asked for by many: its queries in blocks too
    of_list = routed.groupBy("list", F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("part")).agg(F.collect_list("query_id").alias("qids"), F.flatten(F.collect_list("q")).alias("qflat"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                e, q = (np.asarray(x, np.float64).reshape(-1, centroids.shape[1]) for x in (row.flat, row.qflat))
                zero = (np.linalg.norm(q, axis=1) == 0)[:, None] | (np.linalg.norm(e, axis=1) == 0)[None, :]
                sim = np.where(zero, 0.5, (np.clip(_unit(q) @ _unit(e).T, -1, 1) + 1) / 2)
                ids = np.asarray(row.ids)
                for name, s in zip(row.qids, sim):
                    best = np.lexsort((ids, -s))[:k]
                    yield pd.DataFrame({"query_id": name, "record_id": ids[best], "similarity": s[best]})

    found = packed.join(of_list, "list").select("ids", "flat", "qids", "qflat").mapInPandas(compare, "query_id string, record_id string, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "record_id")  # k rows of each block
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def recall(index: Index, queries: DataFrame, k: int, probes: int = 10) -> DataFrame:
    """(query_id, recall): the share of the true ``k`` nearest that the search finds."""
    true = search(index, queries, k, len(index.centroids)).select("query_id", "record_id")
    got = search(index, queries, k, probes).select("query_id", "record_id", F.lit(1).alias("hit"))
    return true.join(got, ["query_id", "record_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
