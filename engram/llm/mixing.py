"""Mixing sources to target shares of the total size, small sources repeated at most a capped number of times.

The mix is as large as the caps allow: the source that runs out first sets the total, and every source gets its share
of it. A document of a source then has an expected number of copies, quota / available size; its whole part is certain,
and the fractions are rounded by the pivotal method: two fractions trade size until one of them is 0 or 1, at random so
that each document keeps its expectation, and their joint size stays what it was. Documents are rounded in buckets of
bounded size; each leaves one residual, and the residuals are combined in a reduction tree, so a source misses its
quota by less than one document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import norm
from engram.plans.staging import stage

#: Documents that one task rounds at once, and residuals that one node of the tree combines.
BUCKET, FAN = 20_000, 1_000
EPS = 1e-9


def source_key(c: Column | str) -> Column:
    """A source's name in lower case, trimmed, '-' and blanks as '_'; null where blank."""
    return F.nullif(F.regexp_replace(norm(c), r"[-\s]", "_"), F.lit(""))


def pivotal(x: np.ndarray, size: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounded fractions and the place of the one that is left (-1: none). Sum of x * size is kept."""
    x, rnd, open_ = x.copy(), np.random.default_rng(seed).random(len(x)), -1
    for j in range(len(x)):
        if not EPS < x[j] < 1 - EPS:
            x[j] = round(x[j])
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        up = min((1 - x[i]) * size[i], x[j] * size[j])
        down = min(x[i] * size[i], (1 - x[j]) * size[j])
        d = up if rnd[j] * (up + down) < down else -down
        x[i] += d / size[i]
        x[j] -= d / size[j]
        left = [k for k in (i, j) if EPS < x[k] < 1 - EPS]
        for k in (i, j):
            if k not in left:
                x[k] = round(x[k])
        open_ = left[0] if left else -1
    return x, open_


def quotas(available: list[dict], targets: list[dict]) -> dict[str, dict]:
    """For each target source: its quota of the largest mix the caps allow, and the expected copies of its documents.

    Shares count relative to the sources that have documents; a source without any, without a share or without
    allowed repeats gets nothing.
    """
    size = {r["source"]: r["size"] for r in available}
    able = {t["source"]: t for t in targets if (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0 and size.get(t["source"], 0) > 0}
    whole = sum(t["target_share"] for t in able.values())
    total = min((t["max_repeats"] * size[s] * whole / t["target_share"] for s, t in able.items()), default=0.0)
    out = {}
    for t in targets:
        s = t["source"]
        quota = total * t["target_share"] / whole if s in able else 0.0
        rate = min(quota / size[s], t["max_repeats"]) if s in able else 0.0
        out[s] = {"quota": quota, "rate": float(round(rate)) if abs(rate - round(rate)) < EPS else rate}
    return out


def target_rows(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats): one row for each source name; of repeated names the largest share."""
    rows = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("s"), F.col("max_repeats").cast("int").alias("m"))
    best = rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("s", "m")).alias("b"))
    return best.select("source", F.col("b.s").alias("target_share"), F.col("b.m").alias("max_repeats"))


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", seed: int = 0, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """(id_col, source, size_col, copies) of every document whose source has a target.

    ``docs``: id, source, size, one row for each id; documents without a source, an id or a size above 0 are in no
    mix. ``targets``: source, target_share, max_repeats, a small reference table. Names are compared without case,
    outer blanks, and with '-' and blanks as '_'. The result depends on ``seed`` and the ids, not on the partitioning.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(F.col(id_col).alias("id"), source_key("source").alias("source"), F.col(size_col).cast("double").alias("size"))
        .where(F.col("id").isNotNull() & (F.col("size") > 0) & F.col("source").isNotNull())
    )
    wanted = [r.asDict() for r in target_rows(targets).collect()]  # a reference table, one row for each source
    known = spark.createDataFrame([(t["source"],) for t in wanted], "source string")
    totals = rows.join(F.broadcast(known), "source").groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    plan = quotas([r.asDict() for r in totals], wanted)
    n = {r["source"]: r["n"] for r in totals}
    rates = spark.createDataFrame(
        [(s, math.floor(p["rate"]), p["rate"] - math.floor(p["rate"]), max(1, -(-n.get(s, 1) // bucket))) for s, p in plan.items()],
        "source string, whole int, x double, buckets long",
    )
    open_ = rows.join(F.broadcast(rates), "source").select(
        "id", "source", "size", "whole", "x", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("buckets")).alias("bucket"), F.lit(False).alias("done")
    )
    schema = open_.schema

    def round_(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        own = int.from_bytes(f"{seed}/{key[0]}/{key[1]}/{len(pdf)}".encode(), "little")
        x, left = pivotal(pdf["x"].to_numpy(), pdf["size"].to_numpy(), own)
        done = np.ones(len(pdf), bool)
        if left >= 0:
            done[left] = False
        return pdf.assign(x=x, done=done)

    decided, width = [], max([1, *(-(-c // bucket) for c in n.values())])
    while True:
        level = stage(open_.groupBy("source", "bucket").applyInPandas(round_, schema))
        decided.append(level.where(F.col("done")))
        open_ = level.where(~F.col("done")).withColumn("bucket", F.floor(F.col("bucket") / fan))
        if width <= 1:
            break
        width = -(-width // fan)
    # one fraction a source is left: up or down at random
    coin = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
    decided.append(open_.withColumn("x", F.when(coin < F.col("x"), 1.0).otherwise(0.0)))
    out = decided[0]
    for df in decided[1:]:
        out = out.unionByName(df)
    return out.select(F.col("id").alias(id_col), "source", F.col("size").cast("long").alias(size_col), (F.col("whole") + F.col("x")).cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame, size_col: str = "n_tokens") -> DataFrame:
    """One row for each target source: its target, what it has, and the size and share it reaches."""
    per = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(size_col).alias("available"), F.count_if(F.col("copies") > 0).alias("used"),
        F.max("copies").alias("most_copies"), F.sum(F.col(size_col) * F.col("copies")).alias("reached"),
    )
    joined = target_rows(targets).join(per, "source", "left").fillna(0, ["documents", "available", "used", "most_copies", "reached"])
    joined = joined.withColumn("total", F.sum("reached").over(Window.partitionBy(F.lit(0))))  # one row for each target
    return joined.select(
        "source", "target_share", "max_repeats", "documents", "available", "used", "most_copies", "reached",
        F.coalesce(F.try_divide(F.col("reached").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("reached_share"),
    )
