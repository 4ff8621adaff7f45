"""Runs of identical consecutive events, each collapsed into one event with count and duration.

Events are range-partitioned by (entity, time, position) and sorted, so an entity with a third of all events is
spread over many tasks. In each partition the events become a string of symbols, one Unicode code point for each
canonical event, with a separator where the entity changes, the gap is too long or an event is no part of any run;
a backreference regex finds the repetitions, and their spans are mapped back to positions and times. The first and
the last segment of each partition are kept apart and joined across partitions in a second, small step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.staging import stage

RUN = re.compile("([^\0])\\1+", re.DOTALL)
FIRST_SYMBOL = 0x10000  # beyond the surrogates
SEGMENTS = "rid string, record_id string, event string, first_pos long, last_pos long, first_us long, last_us long, n long, part long, head boolean, tail boolean"


def _segments(rid: np.ndarray, ev: np.ndarray, us: np.ndarray, gap_us: int) -> list[tuple[int, int]]:
    """The repetitions of two or more events, and the first and last event if they are in none, as (first, last) rows."""
    n = len(rid)
    code = pd.factorize(ev)[0]  # -1: no event
    cut = np.zeros(n, bool)
    cut[1:] = (rid[1:] != rid[:-1]) | (us[1:] - us[:-1] > gap_us)
    at = np.arange(n) + np.cumsum(cut)  # a separator goes before each cut
    symbols = np.zeros(at[-1] + 1, np.uint32)
    symbols[at] = np.where(code < 0, 0, code + FIRST_SYMBOL)
    row = np.zeros(len(symbols), np.int64)
    row[at] = np.arange(n)
    found = [(int(row[m.start()]), int(row[m.end() - 1])) for m in RUN.finditer(symbols.tobytes().decode("utf-32-le"))]
    if not found or found[0][0] != 0:
        found.insert(0, (0, 0))
    if found[-1][1] != n - 1:
        found.append((n - 1, n - 1))
    return found


def collapse_runs(events: DataFrame, gap_seconds: int = 600, partitions: int | None = None) -> DataFrame:
    """(rid, record_id, event, first_pos, last_pos, n, first_t, last_t) of each longest run of two or more events.

    ``events``: rid, record_id, pos, t, event, one row for each (rid, pos). Rows without t or rid are left out; an
    event that is null is in no run and ends one; neighbours more than ``gap_seconds`` apart are in different runs.
    Order: (t, pos). An empty table gives no rows; other columns are ignored.
    """
    spark = events.sparkSession
    gap_us = int(gap_seconds * 1_000_000)
    # staged, since range partitioning reads its input twice, once to sample it
    rows = stage(
        events.where(F.col("t").isNotNull() & F.col("rid").isNotNull())
        .select("rid", "record_id", F.col("pos").cast("long").alias("pos"), F.unix_micros(F.col("t").cast("timestamp")).alias("us"), "event")
    )
    ordered = (
        rows.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "rid", "us", "pos")
        .sortWithinPartitions("rid", "us", "pos")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, head = None, True  # the segment that the next batch may continue; whether it is the partition's first
        part = 0

        def row(s: dict, tail: bool) -> dict:
            return {**s, "part": part, "head": head, "tail": tail}

        for pdf in batches:
            if not len(pdf):
                continue
            rid, ev, us, pos = (pdf[c].to_numpy() for c in ("rid", "event", "us", "pos"))
            ev = np.where(pd.isna(ev), None, ev)
            names, part = pdf["record_id"].to_numpy(), int(pdf["part"].iloc[0])
            out = []
            for a, b in _segments(rid, ev, us, gap_us):
                s = {"rid": rid[a], "record_id": names[a], "event": ev[a], "first_pos": pos[a], "last_pos": pos[b], "first_us": us[a], "last_us": us[b], "n": b - a + 1}
                if a == 0 and open_ is not None and s["event"] is not None and (open_["rid"], open_["event"]) == (s["rid"], s["event"]) and us[0] - open_["last_us"] <= gap_us:
                    s = {**s, **{k: open_[k] for k in ("record_id", "first_pos", "first_us")}, "n": open_["n"] + s["n"]}
                elif open_ is not None:
                    if head or open_["n"] > 1:
                        out.append(row(open_, False))
                    head = False
                open_ = s
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SEGMENTS.split(", ")])
        if open_ is not None:
            yield pd.DataFrame([row(open_, True)])

    segments = ordered.mapInPandas(scan, SEGMENTS)
    w = Window.partitionBy("rid").orderBy("first_us", "first_pos")
    joins = (
        F.col("head")
        & F.lag("tail").over(w)
        & (F.lag("event").over(w) == F.col("event"))
        & (F.col("first_us") - F.lag("last_us").over(w) <= gap_us)
    )
    ends = (
        segments.where(F.col("head") | F.col("tail"))
        .withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("rid", "run")
        .agg(
            F.min_by("record_id", F.struct("first_us", "first_pos")).alias("record_id"),
            F.first("event").alias("event"),
            F.min_by("first_pos", F.struct("first_us", "first_pos")).alias("first_pos"),
            F.max_by("last_pos", F.struct("first_us", "first_pos")).alias("last_pos"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("n").alias("n"),
        )
    )
    cols = ["rid", "record_id", "event", "first_pos", "last_pos", "first_us", "last_us", "n"]
    both = segments.where(~F.col("head") & ~F.col("tail")).select(cols).unionByName(ends.select(cols))
    return both.where((F.col("n") > 1) & F.col("event").isNotNull()).select(
        "rid", "record_id", "event", "first_pos", "last_pos", "n", F.timestamp_micros("first_us").alias("first_t"), F.timestamp_micros("last_us").alias("last_t")
    )
