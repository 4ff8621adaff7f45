"""Layered retrieval, selection of procedures, and vector ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.exprs import LAYERS, cosine01, pick, recency, success_rate
from engram.operators.ranks import numbered
from engram.operators.store import Denied, NotFound
from engram.operators.trust import Trust, allows, visible

PROCEDURES = ("competence", "plan_graph")
#: Vector hits read for n candidates: 10 n, and no fewer than 500.
LEAST_HITS, HITS_EACH = 500, 10


def select(candidates: DataFrame, as_of: Column, similarity: Column | None = None) -> DataFrame:
    """Candidates with ``selection_score``, the mean of applicability, success and recency.

    Applicability is the similarity to the query where known, else the confidence. Candidates without a payload
    (``has_payload`` false) score 0.5. Columns: confidence, success_count, failure_count, failure_rate,
    last_reinforced_at, has_payload.
    """
    fits = F.col("confidence") if similarity is None else F.coalesce(similarity, "confidence")
    score = (fits + success_rate(F.col("success_count"), F.col("failure_count"), F.col("failure_rate")) + recency(F.col("last_reinforced_at"), as_of)) / 3
    return candidates.withColumn("selection_score", F.when(F.col("has_payload"), score).otherwise(0.5))


def selection_confidence(scored: DataFrame, threshold: float = 0.7, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each ``by``): candidates, best, second, confidence and whether more information is needed.

    No candidate: confidence 0; one: its score up to 1; else the lead of the best over the second, relative to it.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("selection_score"), "id") if by else None
    if w is not None:
        top = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2)
        counts = scored.groupBy(*by).agg(F.count("*").alias("candidates"))
        pair = top.groupBy(*by).agg(F.max(F.when(F.col("n") == 1, F.col("selection_score"))).alias("best"), F.max(F.when(F.col("n") == 2, F.col("selection_score"))).alias("second"))
        out = counts.join(pair, list(by))
    else:
        two = scored.orderBy(F.desc("selection_score"), "id").limit(2)
        pair = two.agg(F.max("selection_score").alias("best"), F.when(F.count("*") > 1, F.min("selection_score")).alias("second"))
        out = scored.agg(F.count("*").alias("candidates")).join(F.broadcast(pair))
    conf = (
        F.when(F.col("candidates") == 0, 0.0)
        .when(F.col("candidates") == 1, F.least("best", F.lit(1.0)))
        .when(F.col("best") > 0, (F.col("best") - F.col("second")) / F.col("best"))
        .otherwise(0.0)
    )
    return out.withColumn("confidence", conf).withColumn("needs_more", F.col("confidence") < threshold)


#: Vectors of a block: two blocks and their pairs fit a task.
BLOCK = 256


def _blocks(vectors: DataFrame, id_: str, prefix: str) -> DataFrame:
    """Vectors of one size packed into rows of about BLOCK: ids, all numbers in a row, and their size."""
    rows = vectors.where(F.size("embedding") > 0).select(F.col(id_).cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-vectors.count() // BLOCK))))
    packed = rows.groupBy(F.size("v").alias("size"), block.alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("m"))
    return packed.select(F.col("m.id").alias(f"{prefix}_ids"), F.flatten("m.v").alias(f"{prefix}_flat"), F.col("size").alias(f"{prefix}_size"))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cosine01 of all pairs of two blocks; each pair is summed alike, so equal vectors tie."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.q_size != row.e_size:
                continue
            q, e = (np.asarray(x, dtype=float).reshape(-1, row.q_size) for x in (row.q_flat, row.e_flat))
            norms = np.sqrt((e * e).sum(axis=1))
            for name, x in zip(row.q_ids, q):
                length = norms * np.sqrt((x * x).sum())
                cos = (e * x).sum(axis=1) / np.where(length == 0, 1.0, length)
                yield pd.DataFrame({"query_id": name, "record_id": row.e_ids, "similarity": (np.clip(cos, -1.0, 1.0) + 1) / 2})


def similarities(queries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(query_id, record_id, similarity) for each query (query_id, embedding) and each stored vector of its size."""
    pairs = _blocks(embeddings, "record_id", "e").crossJoin(_blocks(queries, "query_id", "q"))
    return pairs.mapInPandas(_similar, "query_id string, record_id string, similarity double")


def vector_rank(candidates: DataFrame, embeddings: DataFrame, query: Sequence[float] | DataFrame, model_size: int | None = None) -> DataFrame:
    """Candidates with ``vector_rank`` (0 = nearest) and ``vector_score`` = 1 - rank / hits; null where no hit.

    Hits are the nearest of all stored vectors, also of records that are no candidates: max(500, 10 n) of them. For a
    table of queries (query_id, embedding) each has its own hits, and each candidate comes once for each query.
    """
    n = max(LEAST_HITS, HITS_EACH * candidates.count())
    if isinstance(query, DataFrame):
        near, by = similarities(query, embeddings), ["query_id"]
        asked = candidates.crossJoin(query.select(F.col("query_id").cast("string").alias("query_id")).distinct())
    else:
        by, asked = [], candidates
        near = embeddings.where(F.size("embedding") == (model_size or len(query))).select("record_id", cosine01(F.col("embedding"), as_vector(query)).alias("similarity"))
    ranked = numbered(near, [F.desc("similarity"), "record_id"], "vector_rank", by).where(F.col("vector_rank") < n)
    if by:
        hits = ranked.groupBy(*by).agg(F.count("*").alias("hits"))
        ranked = ranked.join(hits, by)
    else:
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("hits"))))  # one row
    scored = ranked.select(*by, F.col("record_id").alias("id"), "similarity", "vector_rank", (1 - F.col("vector_rank") / F.col("hits")).alias("vector_score"))
    return asked.join(scored, [*by, "id"], "left")


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def with_similarity(records: DataFrame, embeddings: DataFrame, vector: Sequence[float]) -> DataFrame:
    """Records with ``similarity`` to the vector; null where none of its size is stored."""
    stored = embeddings.where(F.size("embedding") == len(vector)).select(F.col("record_id").alias("id"), cosine01(F.col("embedding"), as_vector(vector)).alias("similarity"))
    return records.join(stored, "id", "left")


def hybrid_order(ranked: DataFrame) -> DataFrame:
    """``place`` in the three bands: selected procedures by score (where there is a ``selection_score``), hits by 0.7 vector + 0.3 salience, the rest by salience."""
    score = F.col("selection_score") if "selection_score" in ranked.columns else F.lit(None).cast("double")
    df = ranked.withColumn("hybrid_score", 0.7 * F.col("vector_score") + 0.3 * F.col("salience"))
    df = df.withColumn("band", F.when(score.isNotNull(), 0).when(F.col("vector_score").isNotNull(), 1).otherwise(2))
    return df.withColumn("order_key", F.when(F.col("band") == 0, score).when(F.col("band") == 1, F.col("hybrid_score")).otherwise(F.col("salience")))


def layers_of(types: Sequence[str] = ()) -> list[str]:
    return list(types) or list(LAYERS)


def candidates(records: DataFrame, trust: Trust | None, min_salience: float = 0, types: Sequence[str] = ()) -> DataFrame:
    """The visible records of the layers, with ``layer``; types asked for twice come twice."""
    layers = layers_of(types)
    out = visible(records.where(F.col("type").isin(*set(layers))), trust)
    if min_salience > 0:
        out = out.where(F.col("salience") >= min_salience)
    places: dict[str, list[int]] = {}
    for i, t in enumerate(layers):
        places.setdefault(t, []).append(i)
    if all(len(x) == 1 for x in places.values()):
        return out.withColumn("layer", pick(F.col("type"), {t: x[0] for t, x in places.items()}))
    return out.withColumn("layer", F.explode(pick_lists(F.col("type"), places)))


def pick_lists(c: Column, values: dict[str, list[int]]) -> Column:
    out = F.array().cast("array<int>")
    for k, v in values.items():
        out = F.when(c == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def scored(found: DataFrame, as_of: Column, embeddings: DataFrame | None = None, vector: Sequence[float] | None = None) -> DataFrame:
    """Candidates with ``selection_score``, null but for procedures; by similarity where there is a vector of theirs to compare."""
    if vector is None or embeddings is None:
        out = select(found, as_of)
    else:
        out = select(with_similarity(found, embeddings, vector).withColumnRenamed("similarity", "__near"), as_of, F.col("__near")).drop("__near")
    return out.withColumn("selection_score", F.when(F.col("type").isin(*PROCEDURES), F.col("selection_score")))


def selected(found: DataFrame, as_of: Column, embeddings: DataFrame | None = None, vector: Sequence[float] | None = None) -> DataFrame:
    """(id, selection_score) of the procedures among candidates, each once."""
    return scored(found.where(F.col("type").isin(*PROCEDURES)), as_of, embeddings, vector).select("id", "selection_score").dropDuplicates(["id"])


def retrieve(
    records: DataFrame, trust: Trust | None, as_of: Column, query: str = "", limit: int = 0, min_salience: float = 0, types: Sequence[str] = (),
    embeddings: DataFrame | None = None, vector: Sequence[float] | None = None,
) -> DataFrame:
    """Records a request returns, in order (``order by band, order_key desc, id``), cut to ``limit``.

    With a vector and stored embeddings: the three bands of ``hybrid_order``; without any hit, salience alone. With a
    query text: selected procedures first, the others by salience. Else by salience. Status is not looked at.
    """
    found = candidates(records, trust, min_salience, types)
    plain = {"band": F.lit(2), "order_key": F.col("salience")}
    if vector is not None and embeddings is not None:
        ranked = vector_rank(found, embeddings, vector).withColumnRenamed("similarity", "__hit")
        out = hybrid_order(scored(ranked, as_of, embeddings, vector).withColumnRenamed("__hit", "similarity"))
        if embeddings.isEmpty():
            out = out.withColumns(plain)
    elif query.strip():
        out = scored(found, as_of)
        out = out.withColumn("band", F.when(F.col("selection_score").isNotNull(), 0).otherwise(2)).withColumn("order_key", F.coalesce("selection_score", "salience"))
    else:
        out = found.withColumns(plain)
    out = out.orderBy("band", F.desc("order_key"), "id")
    return out.limit(limit) if limit else out


def by_id(records: DataFrame, record_id: str, trust: Trust) -> DataFrame:
    """One record in full; NotFound, or Denied where the trust does not reach (no redaction here)."""
    one = records.where(F.col("id") == record_id)
    state = one.select(allows(trust).alias("ok")).first()
    if state is None:
        raise NotFound(record_id)
    if not state["ok"]:
        raise Denied(record_id)
    return one


def by_type(records: DataFrame, type_: str, trust: Trust | None) -> DataFrame:
    """The visible records of one type by salience."""
    return visible(records.where(F.col("type") == type_), trust).orderBy(F.desc("salience"), "id")
