"""Ranks over whole tables without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.staging import stage


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, by: Sequence[str] = (), start: int = 0) -> DataFrame:
    """Rows with ``name``: their number from ``start`` in ``order``, within each ``by``.

    Rows are cut into ranges, each range is numbered on its own, and only the sizes of the ranges meet. ``order`` should
    end in a key, else ties are numbered as they come. Null ``by`` values are a group. An empty table stays empty.
    """
    by = list(by)
    parts = stage(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__part") if by else Window.orderBy("__part")  # one row for each range (and group)
    keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    before = sizes.select(F.col("__part").alias("__p"), *keys, (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    on = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    joined = parts.withColumn("__own", own).join(before, on)
    return joined.withColumn(name, (F.col("__before") + F.col("__own") - 1 + start).cast("long")).drop("__part", "__p", "__before", "__own", *[f"__by{i}" for i in range(len(by))])
