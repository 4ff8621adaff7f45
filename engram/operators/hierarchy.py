"""Parent-child links as full hierarchies: root, depth, subtree size, path and descendants of each node, loops reported.

Bottom-up leaf peeling: each round removes the nodes without remaining children, which send their subtree's size to
their parent. Where a round removes little (long unbranched chains), nodes with a single child are spliced out, chosen
by coin so that no two neighbours go at once, and their child carries them along: how many steps its link stands for,
and how many nodes hang from them. So the rounds grow with the logarithm of the nodes and not with the height. Reverse
peel order then gives each node root and depth from its parent, and a spliced node its size from its child. What cannot
be peeled is a loop; what hangs below one has no root. Paths, whose total length can be the square of the nodes, are
only built where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.plans.staging import stage

#: Once the remaining links take less than this, one task peels the rest in memory (some ten times as much in Python).
LOCAL_BYTES = 8 << 20
#: What a link takes beside its ids, for ``LOCAL_BYTES``.
LINK_BYTES = 64
#: Path elements that the local peel holds at once.
HELD = 200_000
FOUND = "id string, root string, depth int, size long"


def one_parent(links: DataFrame) -> DataFrame:
    """(id, parent) with one parent for each id: of the smallest ``rank``, then the smallest name. Null ends drop out."""
    return (
        links.where(F.col("id").isNotNull() & F.col("parent").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct("rank", "parent"))["parent"].alias("parent"))
    )


def _peel(paths: bool):
    """All remaining nodes at once: peel leaves, then walk down from the roots; loops and what is below them have no root."""

    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        ids = pdf["id"].tolist()
        place = {x: i for i, x in enumerate(ids)}
        up = [-1 if p is None else place[p] for p in pdf["parent"]]
        hops, size, extra = pdf["hops"].tolist(), pdf["acc"].tolist(), pdf["extra"].tolist()
        via = pdf["via"].tolist() if paths else None
        kids: list[list[int]] = [[] for _ in ids]
        for i, p in enumerate(up):
            if p >= 0:
                kids[p].append(i)
        open_ = [len(k) for k in kids]
        leaves = [i for i, n in enumerate(open_) if not n]
        while leaves:
            i = leaves.pop()
            p = up[i]
            if p >= 0:
                size[p] += size[i] + extra[i]
                open_[p] -= 1
                if not open_[p]:
                    leaves.append(p)
        seen = [False] * len(ids)
        out: list[tuple] = []
        held = 0
        cols = ["id", "root", "depth", "size", *(["path"] if paths else [])]
        for start in (i for i, p in enumerate(up) if p < 0):
            todo, way = [(start, 0, 0)], []  # node, depth, length of the path above it
            while todo:
                i, depth, above = todo.pop()
                seen[i] = True
                if paths:
                    del way[above:]
                    way += [*via[i], ids[i]]
                    held += len(way)
                out.append((ids[i], ids[start], depth, size[i], *([list(way)] if paths else [])))
                todo += [(k, depth + hops[k], len(way)) for k in kids[i]]
                if len(out) >= 10_000 or held >= HELD:
                    yield pd.DataFrame(out, columns=cols)
                    out, held = [], 0
        out += [(x, None, -1, 0, *([None] if paths else [])) for x, s in zip(ids, seen) if not s]
        if out:
            yield pd.DataFrame(out, columns=cols)

    return peel


def hierarchy(links: DataFrame, local_bytes: int = LOCAL_BYTES, nodes: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """(id, root_id, depth, size and, with ``paths``, path) for each node of ``links`` (id, parent: one row for each id).

    ``size`` counts a node and all below it; ``path`` runs from the root to the node; a root has depth 0. Nodes on a
    loop (a self-link included) or below one have root_id '', depth -1, size 0 and a null path. Ends that are null drop
    out; an empty table gives no rows. A parent that names no id of the table is a root. ``nodes`` (id): those without
    a link are roots too. Other columns are ignored. ``local_bytes`` only says when one task does the rest.
    """
    pairs = links.where(F.col("id").isNotNull() & F.col("parent").isNotNull()).select("id", "parent")
    ends = pairs.select(F.col("parent").alias("id"))
    if nodes is not None:
        ends = ends.unionByName(nodes.where(F.col("id").isNotNull()).select("id"))
    via = [F.array().cast("array<string>").alias("via")] if paths else []
    kept = ["id", "parent", "hops", "acc", "extra", *(["via"] if paths else [])]
    live = stage(
        pairs.unionByName(ends.select("id", F.lit(None).cast("string").alias("parent")))
        .groupBy("id")
        .agg(F.max("parent").alias("parent"))
        .select("id", "parent", F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("hops"), F.lit(1).cast("long").alias("acc"), F.lit(0).cast("long").alias("extra"), *via)
    )
    length = F.octet_length("id") + F.coalesce(F.octet_length("parent"), F.lit(0)) + LINK_BYTES
    if paths:
        length = length + F.aggregate("via", F.lit(0), lambda s, x: s + F.octet_length(x) + LINK_BYTES)
    load = [F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")]
    now = live.agg(*load).first()
    removed: list[tuple[str, DataFrame]] = []
    no = 0
    while now["bytes"] > local_bytes:
        no += 1
        counts = live.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
        tagged = stage(live.join(counts, "id", "left"))
        closed = F.coalesce((F.col("parent") == F.col("id")) & (F.col("kids") == 1), F.lit(False))  # a loop, shrunk to one node
        goes = F.col("kids").isNull() | closed
        removed.append(("leaf", tagged.where(goes & ~closed).select(*kept)))
        removed.append(("loop", tagged.where(closed).select(*kept)))
        sent = tagged.where(goes & ~closed & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("acc") + F.col("extra")).alias("got"))
        rest = stage(tagged.where(~goes).join(sent, "id", "left").withColumn("acc", F.col("acc") + F.coalesce("got", F.lit(0))))
        left = rest.agg(*load).first()
        if left["bytes"] > local_bytes and now["n"] - left["n"] < 0.1 * now["n"]:
            coin = lambda c, r=no: F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2)) == 1
            single = (F.col("kids") == 1) & F.col("got").isNull()  # and the child is still there
            out = rest.where(single & (F.col("parent") != F.col("id")) & coin("id") & ~coin("parent")).select(*kept)
            # the spliced ones by their child's link, which takes over theirs
            taken = out.select(F.col("id").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in kept if c != "id"])
            moved = stage(rest.select(*kept).join(out.select("id"), "id", "left_anti").join(taken, "parent", "left"))
            over = F.col("up_parent").isNotNull()
            removed.append(
                ("spliced", moved.where(over).select(
                    F.col("parent").alias("id"), F.col("up_parent").alias("parent"), F.col("up_hops").alias("hops"), (F.col("up_acc") + F.col("extra")).alias("acc"), F.col("id").alias("child"),
                    *([F.col("up_via").alias("via")] if paths else []),
                ))
            )
            own = {
                "parent": F.coalesce("up_parent", "parent"), "hops": F.col("hops") + F.coalesce("up_hops", F.lit(0)),
                "extra": F.col("extra") + F.when(over, F.col("up_acc") + F.col("up_extra")).otherwise(0),
            }
            if paths:
                own["via"] = F.when(over, F.concat("up_via", F.array("parent"), "via")).otherwise(F.col("via"))
            rest = moved.select("id", "acc", *[v.alias(k) for k, v in own.items()])
            left = rest.agg(*load).first()
        live, now = rest.select(*kept), left
    schema = FOUND + (", path array<string>" if paths else "")
    done = [live.repartition(1).mapInPandas(_peel(paths), schema)]
    if removed:
        done[0] = stage(done[0])
    for kind, gone in reversed(removed):
        known = reduce(DataFrame.unionByName, done)
        done.append(stage(_resolved(kind, gone, known, paths)))
    return reduce(DataFrame.unionByName, done).select("id", F.coalesce("root", F.lit("")).alias("root_id"), "depth", "size", *(["path"] if paths else []))


def _resolved(kind: str, gone: DataFrame, known: DataFrame, paths: bool) -> DataFrame:
    """What one step of the peel removed, with root, depth and path from its parents and, if spliced, size from its child."""
    null = lambda t: F.lit(None).cast(t)
    if kind == "loop":
        return gone.select("id", null("string").alias("root"), F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("size"), *([null("array<string>").alias("path")] if paths else []))
    up = known.select(F.col("id").alias("parent"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), *([F.col("path").alias("up_path")] if paths else []))
    out, size = gone.join(up, "parent", "left"), F.col("acc")
    if kind == "spliced":
        out = out.join(known.select(F.col("id").alias("child"), F.col("size").alias("below")), "child", "left")
        size = size + F.coalesce("below", F.lit(0))
    top = F.col("parent").isNull()
    root = F.when(top, F.col("id")).otherwise(F.col("up_root"))
    on = root.isNotNull()
    cols: list[Column] = [
        F.col("id"), root.alias("root"), F.when(~on, -1).when(top, 0).otherwise(F.col("up_depth") + F.col("hops")).cast("int").alias("depth"), F.when(on, size).otherwise(0).cast("long").alias("size"),
    ]
    if paths:
        cols.append(F.when(top, F.array("id")).otherwise(F.concat("up_path", "via", F.array("id"))).alias("path"))
    return out.select(*cols)


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance) for every node and each node below it; a relation, since a root's list is unbounded.

    ``tree``: of ``hierarchy`` with paths; each node goes to all on its path at once, instead of list by list upwards.
    """
    up = tree.where(F.size("path") > 1).select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "id"))
    return up.select("id", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
