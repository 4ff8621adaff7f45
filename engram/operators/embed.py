"""The seams to models: any function from texts to vectors, or from texts to answers, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import values
from engram.functions.exprs import cosine01, without_fences
from engram.operators import store, texts
from engram.operators.retrieve import as_vector

Model = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embedding(text: Column, model: Model) -> Column:
    """The vector of each text; null for null and blank ones. ``model`` runs on the executors, a batch of texts a call."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        asked = texts.where(texts.notna() & (texts.fillna("").str.strip() != ""))
        keys = asked.dropna().unique().tolist()
        known = dict(zip(keys, model(keys))) if keys else {}
        return asked.map(lambda t: [float(x) for x in known[t]] if t in known else None)

    return embed(text)


def answers(text: Column, model: Callable[[Sequence[str]], Sequence[str | None]]) -> Column:
    """A language model's answer to each text; null for null and blank ones, which are not asked."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        asked = texts.where(texts.notna() & (texts.fillna("").str.strip() != ""))
        keys = asked.dropna().unique().tolist()
        known = dict(zip(keys, model(keys))) if keys else {}
        return asked.map(lambda t: known.get(t) if isinstance(t, str) else None)

    return ask(text)


def interpretation(answer: Column) -> Column:
    """The interpretation that an answer holds, in or without a code fence, as ``texts.INTERPRETATION``; null if it holds none."""
    return F.from_json(without_fences(answer), texts.INTERPRETATION)


def record_texts(records: DataFrame) -> DataFrame:
    """(id, text): what each record of a store is embedded by; entities and unreadable payloads have no text."""
    p = {k: values.payload_of(F.col("payload_json"), k) for k in values.VARIANTS}
    w, c, g = p["working"], p["competence"], p["plan_graph"]
    text = (
        F.when(F.col("type") == "episodic", texts.episodic_text(p["episodic"]["timeline"]))
        .when(F.col("type") == "working", texts.working_text(w["context_summary"], w["state"], w["next_actions"]))
        .when(F.col("type") == "semantic", texts.semantic_text(*[p["semantic"][k] for k in ("subject", "predicate", "object")]))
        .when(F.col("type") == "competence", texts.competence_text(c["skill_name"], F.transform(c["triggers"], lambda t: t["signal"])))
        .when(F.col("type") == "plan_graph", texts.plan_text(g["intent"], F.transform(g["nodes"], lambda n: n["op"])))
    )
    return records.select("id", F.coalesce(text, F.lit("")).alias("text"))


def backfill(embeddings: DataFrame, texts: DataFrame, model: Model, name: str, dimensions: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(embeddings, added): vectors for the records (id, text) that have none yet and whose text is not blank."""
    todo = texts.where(F.coalesce(F.trim("text"), F.lit("")) != "").join(embeddings.select(F.col("record_id").alias("id")), "id", "left_anti")
    new = todo.select(F.col("id").alias("record_id"), embedding(F.col("text"), model).alias("embedding"), as_of.alias("created_at")).where(F.col("embedding").isNotNull())
    return store.store_embeddings(embeddings, new, name, dimensions), new


def similarity(embeddings: DataFrame, ids: DataFrame, vector: Sequence[float]) -> DataFrame:
    """(id, similarity, known): in [0, 1]; 0.5 and not known where no vector of this size is stored."""
    stored = embeddings.where(F.size("embedding") == len(vector)).select(F.col("record_id").alias("id"), cosine01(F.col("embedding"), as_vector(vector)).alias("s"))
    out = ids.select("id").distinct().join(stored, "id", "left")
    return out.select("id", F.coalesce("s", F.lit(0.5)).alias("similarity"), F.col("s").isNotNull().alias("known"))
