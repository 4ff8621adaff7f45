"""References to records that do not exist, are deleted, or came later.

Ids become (domain, integer): the text before the trailing hexadecimal digits with their number, and the digits'
value. Parent keys and the distinct referenced keys are range-partitioned and sorted together; within a partition,
consecutive parent integers are compressed into runs, and each referenced key is matched as-of to the preceding run
start: it is an orphan when it lies beyond that run's end. A hot target is one key there, however many rows name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import norm_id
from engram.plans.staging import stage

#: Up to 15 hexadecimal digits fit a signed long.
TAIL = r"^(.*?)([0-9a-f]{1,15})$"
MATCHED = "domain string, num long, found boolean, run_start long, run_end long, first_seen timestamp, deleted boolean"


def as_number(parent_table: Column, id_: Column) -> tuple[Column, Column]:
    """(domain, number) of a normalised id; different ids differ in at least one of them."""
    digits = F.regexp_extract(id_, TAIL, 2)
    head = F.when(digits == "", id_).otherwise(F.regexp_extract(id_, TAIL, 1))
    return F.concat_ws("/", parent_table, F.length(digits).cast("string"), head), F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0))


def match_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one partition by (domain, num, parents first): runs of the parents, as-of match of the references."""
    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        code = pd.factorize(pdf["domain"])[0]
        num, parent = pdf["num"].to_numpy(np.int64), pdf["is_parent"].to_numpy(bool)
        at = np.flatnonzero(parent)
        refs = np.flatnonzero(~parent)
        if len(at):
            carry = pdf.iloc[at[-1:]]
            starts = np.ones(len(at), bool)
            starts[1:] = (code[at[1:]] != code[at[:-1]]) | (num[at[1:]] > num[at[:-1]] + 1)
            run = np.cumsum(starts) - 1
            first = num[at][starts]
            last = num[at][np.append(np.flatnonzero(starts)[1:] - 1, len(at) - 1)]
            before = np.searchsorted(at, refs, side="right") - 1  # the last parent at or before each reference
            same = (before >= 0) & (code[at[np.maximum(before, 0)]] == code[refs])
            which = run[np.maximum(before, 0)]
            # a parent that sorts before the reference is in a run that starts before it; beyond the run's end: an orphan
            found = same & (num[refs] <= last[which])
        else:
            same = found = np.zeros(len(refs), bool)
            which, before, first, last = np.zeros(len(refs), int), np.zeros(len(refs), int), np.zeros(1, np.int64), np.zeros(1, np.int64)
        if len(refs):
            src = pdf.iloc[at[np.maximum(before, 0)]] if len(at) else pdf.iloc[np.zeros(len(refs), int)]
            yield pd.DataFrame(
                {
                    "domain": pdf["domain"].to_numpy()[refs],
                    "num": num[refs],
                    "found": found,
                    "run_start": pd.Series(first[which], dtype="Int64").where(pd.Series(same)),
                    "run_end": pd.Series(last[which], dtype="Int64").where(pd.Series(same)),
                    "first_seen": pd.Series(src["first_seen"].to_numpy()).where(pd.Series(found)),
                    "deleted": found & src["deleted"].fillna(False).to_numpy(bool),
                }
            )


def check_references(refs: DataFrame, parents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each reference with its ``status``: 'ok', 'missing', 'deleted' or 'late'.

    ``refs``: ref_field, parent_table, target, ref_time and any other columns; blank and null targets are no
    references and drop out. ``parents``: parent_table, id, first_seen, deleted; repeated ids are one parent with the
    earliest first_seen, deleted if any row is. 'late': first seen after ref_time (never, where either time is null).
    Empty inputs give no rows, and without parents every reference is missing.
    """
    spark = refs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d, k = as_number(F.col("parent_table"), F.col("pid"))
    sorted_parents = (
        parents.select("parent_table", norm_id("id").alias("pid"), "first_seen", "deleted")
        .where(F.col("pid").isNotNull())
        .groupBy("parent_table", "pid")
        .agg(F.min("first_seen").alias("first_seen"), F.max("deleted").alias("deleted"))
        .select(d.alias("domain"), k.alias("num"), F.lit(True).alias("is_parent"), "first_seen", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    )
    d, k = as_number(F.col("parent_table"), norm_id("target"))
    keyed = refs.where(norm_id("target").isNotNull()).withColumns({"__domain": d, "__num": k})
    wanted = keyed.select(F.col("__domain").alias("domain"), F.col("__num").alias("num")).distinct()
    # staged, since range partitioning reads its input twice, once to sample it
    both = stage(sorted_parents.unionByName(
        wanted.select("domain", "num", F.lit(False).alias("is_parent"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(False).alias("deleted"))
    ))
    matched = (
        both.repartitionByRange(n, "domain", "num")
        .sortWithinPartitions("domain", "num", F.col("is_parent").desc())
        .mapInPandas(match_runs, MATCHED)
    )
    m = matched.select(F.col("domain").alias("__domain"), F.col("num").alias("__num"), F.col("found").alias("__found"), F.col("first_seen").alias("__seen"), F.col("deleted").alias("__deleted"))
    status = F.when(~F.col("__found"), "missing").when(F.col("__deleted"), "deleted").when(F.col("__seen") > F.col("ref_time"), "late").otherwise("ok")
    return keyed.join(m, ["__domain", "__num"]).withColumn("status", status).drop("__domain", "__num", "__found", "__seen", "__deleted")
