"""Parquet tables by name, and the few shapes of them that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.plans.staging import stage

#: Keys are broadcast up to this many bytes of them, counted before; more of them are joined by shuffling.
BROADCAST_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(keys: DataFrame, limit: int | None = None) -> DataFrame:
    """Staged keys, marked for broadcasting if they are few bytes by count; else the planner joins them as it sees fit."""
    length = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in keys.columns])) + 16 * len(keys.columns)
    size = keys.agg(F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(keys) if size <= (BROADCAST_BYTES if limit is None else limit) else keys


def one_row_each(rows: DataFrame, key: str | list[str], pick: Callable[[Column], Column] = F.max, limit: int | None = None) -> DataFrame:
    """One row for each ``key``: the one with the greatest (``pick`` F.max) or smallest (F.min) other columns, in their order.

    For wide rows with few repeated keys: keys are counted first, and only rows of repeated keys are moved and compared;
    the others stay where they are. Rows with a null in their key are left out; nulls order first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    cols = [c for c in rows.columns if c not in keys]
    again = stage(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(*keys))
    many = if_small(again, limit)
    best = rows.join(many, keys, "left_semi").groupBy(*keys).agg(pick(F.struct(*cols)).alias("__best"))
    return rows.join(many, keys, "left_anti").select(*keys, *cols).unionByName(best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in cols]))


def newest(df: DataFrame, key: Column, order: list[str], keep: list[str], key_name: str = "key", wide: bool = False) -> DataFrame:
    """One row for each key: the one with the greatest ``order`` columns, then the greatest ``keep`` columns.

    Rows whose key is null are left out; nulls order first. Map-side combined, so a hot key shuffles little; ``wide``
    rows (texts) are not moved unless their key is repeated, see ``one_row_each``.
    """
    cols = list(dict.fromkeys([*order, *keep]))
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols) if c != key_name]
    if wide:
        return one_row_each(df.select(key.alias(key_name), *named), key_name).select(key_name, *back)
    return df.where(key.isNotNull()).groupBy(key.alias(key_name)).agg(F.max(F.struct(*named)).alias("best")).select(key_name, "best.*").select(key_name, *back)
