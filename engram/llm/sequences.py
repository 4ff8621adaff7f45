"""Frequent ordered patterns across many entities' sequences, with gaps, mined with vertical identifier lists.

Every item has the list of its (entity, position) pairs. A pattern's list holds, for each entity, where the pattern
ends; it is extended by a temporal join with an item's list on the entity. For sequences the earliest end is enough,
and each item occurrence knows the one before it, so the join itself gives the first later occurrence and needs no
aggregation. Patterns below the support are pruned by the number of distinct entities before the next extension.
The frequent patterns of a level are gathered to the driver: at a relative support s there are at most (patterns
per entity) / s of them, however many entities there are. So the next level's candidates are made there: a pattern all
of whose parts are frequent. Each level is joined once, from the lists of the level before, and all lists stay
partitioned by entity.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.staging import stage

#: A record's sequence longer than this is reduced before mining, see ``useful``.
LONG = 4_096


def useful(items: list, length: int) -> list[int]:
    """The indexes of a sequence that earliest embeddings of patterns of up to ``length`` steps can use.

    The first occurrence of each item, then the next occurrence of each item after any of those, and so on. All
    other events can be dropped without changing which patterns the sequence contains; the result depends on the
    items and not on the sequence's length, and reducing a prefix first gives the same.
    """
    after: dict[object, list[int]] = {}
    for i, x in enumerate(items):
        after.setdefault(x, []).append(i)
    ends, keep = {-1}, set()
    for _ in range(length):
        ends = {at[k] for e in ends for at in after.values() if (k := bisect.bisect_right(at, e)) < len(at)} - keep
        if not ends:
            break
        keep |= ends
    return sorted(keep)


def _reduce_long(length: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < 2 * LONG:
                continue
            last = held["rid"].iloc[-1]
            done, rest = held[held["rid"] != last], held[held["rid"] == last]
            yield from (g.iloc[useful(g["item"].tolist(), length)] for _, g in done.groupby("rid", sort=False))
            held = rest.iloc[useful(rest["item"].tolist(), length)]
        if held is not None:
            yield from (g.iloc[useful(g["item"].tolist(), length)] for _, g in held.groupby("rid", sort=False))

    return scan


def _level(counts: DataFrame, least: float) -> dict[int, int]:
    return {r["pat"]: r["support"] for r in counts.where(F.col("support") >= least).collect()}


def _among(df: DataFrame, pats: set[int]) -> DataFrame:
    """Only these patterns; there are few, see the module's text."""
    spark = df.sparkSession
    few = spark.createDataFrame([(p,) for p in sorted(pats)], "pat long")
    return df.join(F.broadcast(few), "pat", "left_semi")


def _candidates(level: dict[int, int], n: int, k: int) -> set[int]:
    """The patterns of n + 1 steps whose every part of n steps is among the frequent patterns ``level``."""
    heads: dict[int, list[int]] = {}
    for p in level:
        heads.setdefault(p // k, []).append(p % k)
    out = set()
    for p in level:
        for x in heads.get(p % k ** (n - 1), ()):
            new = p * k + x
            # without one inner step: the steps before it, and those behind
            if all(new // k ** (i + 1) * k**i + new % k**i in level for i in range(1, n)):
                out.add(new)
    return out


def _names(found: dict[int, int], length: int, items: list[str], kind: str) -> list[tuple]:
    k, out = len(items), []
    for p, n in found.items():
        steps = []
        for _ in range(length):
            p, x = divmod(p, k)
            steps.append(items[x])
        out.append((kind, ">".join(reversed(steps)), length, n))
    return out


def _frequent(names: DataFrame, support: float) -> tuple[list[str], float]:
    """The frequent items in order and the least support; ``names``: one array of distinct names for each entity."""
    each = names.select(F.explode(F.concat("names", F.array(F.lit("")))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    counts = {r["name"]: r["n"] for r in each.where(F.col("n") >= support * F.lit(0.999)).collect()}
    least = max(1.0, support * counts.pop("", 0) - 1e-9)
    return sorted(x for x, n in counts.items() if n >= least), least


def sequence_patterns(events: DataFrame, support: float, lengths: tuple[int, ...] = (3, 4), kind: str = "event") -> list[tuple]:
    """(kind, pattern, length, support) of the patterns that a share ``support`` of the entities contains.

    ``events``: rid, name, t, pos, in the order (t, pos). Rows without a name or t are left out, but their entities
    count; rows with a null rid do not exist. An entity counts once for a pattern. No entities: no patterns.
    """
    spark, longest = events.sparkSession, max(lengths)
    rows = events.where(F.col("rid").isNotNull()).select("rid", F.when(F.col("t").isNotNull(), F.nullif("name", F.lit(""))).alias("name"), "t", "pos").persist()
    long_ = rows.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("rid")
    short = rows
    if hot := not long_.isEmpty():
        long_ = long_.persist()
        short = rows.join(long_, "rid", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = F.when(F.col("name").isNotNull(), F.struct("t", "pos", "name"))  # collect_list leaves nulls out
    listed = F.transform(F.array_sort(F.collect_list(step)), lambda x: x["name"]).alias("seq")
    seqs = short.repartition(parts, "rid").groupBy("rid").agg(listed)
    if hot:
        ordered = stage(rows.join(long_, "rid", "left_semi").where(F.col("name").isNotNull()).withColumn("item", F.col("name")))
        reduced = (
            ordered.repartitionByRange(parts, "rid", "t", "pos")
            .sortWithinPartitions("rid", "t", "pos")
            .mapInPandas(_reduce_long(longest), "rid string, name string, t timestamp, pos long, item string")
        )
        # an entity without named events is still one
        kept = long_.select("rid", F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("name"))
        seqs = seqs.unionByName(reduced.select("rid", "t", "pos", "name").unionByName(kept).groupBy("rid").agg(listed)).repartition(parts, "rid")
    seqs = seqs.persist()
    try:
        items, least = _frequent(seqs.select(F.array_distinct("seq").alias("names")), support)
        k = len(items)
        if not k:
            return []
        codes = spark.createDataFrame(list(zip(items, range(k))), "name string, item long")
        w = Window.partitionBy("rid", "item").orderBy("at")
        lists = (
            seqs.select("rid", F.posexplode("seq").alias("at", "name"))
            .join(F.broadcast(codes), "name")
            .select("rid", "item", "at", F.coalesce(F.lag("at").over(w), F.lit(-1)).alias("prev"))
            .persist()
        )
        try:
            later = lists.select("rid", "item", "at", "prev")

            def extend(ends: DataFrame) -> DataFrame:
                return (
                    ends.join(later, "rid")
                    .where((F.col("at") > F.col("end")) & (F.col("prev") <= F.col("end")))
                    .select("rid", (F.col("pat") * k + F.col("item")).alias("pat"), F.col("at").alias("end"))
                )

            first = lists.where(F.col("prev") == -1).select("rid", F.col("item").alias("pat"), F.col("at").alias("end"))
            return _grow(extend(first), extend, lambda df: df, k, items, least, lengths, kind)
        finally:
            lists.unpersist()
    finally:
        seqs.unpersist()
        rows.unpersist()
        if hot:
            long_.unpersist()


def _grow(
    grown: DataFrame, extend: Callable[[DataFrame], DataFrame], once: Callable[[DataFrame], DataFrame], k: int, items: list[str], least: float, lengths: tuple[int, ...], kind: str
) -> list[tuple]:
    """Extend the frequent patterns step by step, from those of two steps; ``once``: one row for each entity and pattern."""
    out, kept, longest = [], [], max(lengths)
    try:
        for length in range(2, longest + 1):
            if length < longest:
                grown = grown.persist()
                kept.append(grown)
            level = _level(once(grown).groupBy("pat").agg(F.count("*").alias("support")), least)
            if length in lengths:
                out += _names(level, length, items, kind)
            wanted = _candidates(level, length, k)
            if length == longest or not wanted:
                break
            grown = _among(extend(_among(grown, {p // k for p in wanted})), wanted)
    finally:
        for df in kept:
            df.unpersist()
    return out


def _closure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(rid, u, v) and both items for each node v that depends on u, directly or through other nodes."""
    for pdf in batches:
        out = []
        for rid, nodes, items, deps in zip(pdf["rid"], pdf["nodes"], pdf["items"], pdf["deps"]):
            no = {x: i for i, x in enumerate(nodes)}
            direct = [[no[d] for d in ds if d in no] for ds in deps]
            above = [0] * len(no)  # bit sets of the nodes that each depends on
            changed, rounds = True, 0
            order = range(len(no))
            while changed:
                changed = False
                for v in order:
                    new = above[v]
                    for u in direct[v]:
                        new |= above[u] | (1 << u)
                    if new != above[v]:
                        above[v], changed = new, True
                order = order if (rounds := rounds + 1) > 1 else sorted(order, key=lambda v: above[v].bit_count())
            for v, bits in enumerate(above):
                if items[v] >= 0:
                    while bits:
                        low = bits & -bits
                        u = low.bit_length() - 1
                        bits ^= low
                        if items[u] >= 0:
                            out.append((rid, u, items[u], v, items[v]))
        yield pd.DataFrame(out, columns=["rid", "u", "first", "v", "item"])


def dependency_patterns(nodes: DataFrame, support: float, lengths: tuple[int, ...] = (3, 4), kind: str = "tool") -> list[tuple]:
    """The same for graphs: each step's node depends on the previous step's node, directly or through others.

    ``nodes``: rid, node, name, deps, one row for each node. Dependencies that name no node, and repeated ones, do
    not count; nodes without a name only connect; a loop's nodes depend on each other and on themselves. A graph is
    one record's payload, so one row holds it.
    """
    spark, longest = nodes.sparkSession, max(lengths)
    graphs = (
        nodes.where(F.col("rid").isNotNull())
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid")
        .groupBy("rid")
        .agg(F.collect_list(F.struct("node", F.coalesce("name", F.lit("")).alias("name"), "deps")).alias("g"))
        .persist()
    )
    steps = None
    try:
        items, least = _frequent(graphs.select(F.array_except(F.array_distinct("g.name"), F.array(F.lit(""))).alias("names")), support)
        k = len(items)
        if not k:
            return []
        number = {x: i for i, x in enumerate(items)}

        def closure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return _closure(pdf.assign(items=[[number.get(x, -1) for x in names] for names in pdf["names"]]) for pdf in batches)

        steps = (
            graphs.select("rid", F.col("g.node").alias("nodes"), F.col("g.name").alias("names"), F.col("g.deps").alias("deps"))
            .mapInPandas(closure, "rid string, u long, first long, v long, item long")
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid")
            .persist()
        )
        later = steps.select("rid", "u", "v", "item")

        def extend(ends: DataFrame) -> DataFrame:
            return ends.join(later, ["rid", "u"]).select("rid", (F.col("pat") * k + F.col("item")).alias("pat"), F.col("v").alias("u")).distinct()

        pairs = steps.select("rid", (F.col("first") * k + F.col("item")).alias("pat"), F.col("v").alias("u")).distinct()
        return _grow(pairs, extend, lambda df: df.select("rid", "pat").distinct(), k, items, least, lengths, kind)
    finally:
        graphs.unpersist()
        if steps is not None:
            steps.unpersist()
