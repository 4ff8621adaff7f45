"""Near-duplicate records with small edits: an exact set-similarity join with grouped prefixes.

Texts become sets of words; equal sets are one set. Words are ordered from rare to frequent by a count over all sets,
kept as a histogram of fixed size (hash buckets), so what is broadcast does not grow with the data; any total order
gives the same pairs. Sets with the same size and the same prefix in that order form one group.

One rule makes the keys of all sizes: the smaller set of a pair shows the words of its short index prefix, the larger
one those of its probe prefix, and similar sets share a word there. Where a word would bring more than ``HOT`` pairs
of groups together, it is joined with the next word that both could share (similar sets share two words in prefixes
that are one word longer); keys that stay hot even so are split over many tasks. Groups that share a key and pass the
length, position and bitmap filters are candidates; only then are groups expanded into their members, large groups in
blocks, which are verified on their whole sets. The bitmap of a set has a bit for each word's hash; bits that differ
between two sets, counted where each group's members agree, are words that only one of the two has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.plans.staging import stage

#: Buckets of the word histogram (2 MB).
BUCKETS = 1 << 18
WORD = "[a-z0-9]+"
#: A word is joined with a second one where it would bring more pairs of groups together than this.
HOT = 1 << 16
#: Pairs of groups that one key may bring to one task; a key with more is split.
SPLIT = 1 << 24
#: Members of a group that are compared as one block.
BLOCK = 1_000


def words(text: Column) -> Column:
    """The distinct words of a text: runs of a-z and 0-9 in lower case, sorted; empty for null."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")))


def shingles(text: Column, n: int = 5) -> Column:
    """The distinct runs of ``n`` words of a text, for joins that heed the order; empty for shorter texts."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.array_sort(
        F.array_distinct(F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))
    )


def _prefixes(counts: np.ndarray, num: int, den: int, hot: int):
    """Each set's prefix in the order of rarity, the place of its first word that may be hot, and its bitmap."""
    least = int(hot**0.5)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = pdf["tokens"].map(len).to_numpy()
            flat = np.concatenate(pdf["tokens"].to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(pdf)), sizes)
            flat = flat[np.lexsort((flat, counts[flat & (BUCKETS - 1)], row))]
            keep = np.minimum(sizes, sizes - (num * sizes + den - 1) // den + 2)
            start = np.cumsum(sizes) - sizes
            bit = (flat >> 20) & 127
            one = np.left_shift(np.int64(1), bit & 63)
            low, high = (np.bitwise_or.reduceat(np.where(part, one, 0), start) for part in (bit < 64, bit >= 64))
            rare = np.add.reduceat(counts[flat & (BUCKETS - 1)] <= least, start, dtype=np.int64)
            yield pd.DataFrame({"set_id": pdf["set_id"], "tokens": pdf["tokens"], "prefix": [flat[a : a + k] for a, k in zip(start, keep)], "low": low, "high": high, "rare": rare})

    return scan


def _keys(groups: DataFrame, num: int, den: int, hot: int, split: int) -> DataFrame:
    """(k, salt, index, rest) and the filters' columns of each key of each group; ``rest``: the most words that two
    sets can share if they share none before the key's words; ``index``: whether the smaller set of a pair has the key."""
    n = F.col("size")
    probe = (n - F.ceil(F.lit(num) * n / F.lit(den)) + 1).cast("int")
    index = (n - F.ceil(F.lit(2 * num) * n / F.lit(num + den)) + 1).cast("int")
    at = groups.select("gid", "size", "low", "high", "low_same", "high_same", "prefix", "rare", probe.alias("probe"), index.alias("n_index"))
    each = at.select("*", F.posexplode(F.slice("prefix", F.lit(1), F.col("probe"))).alias("i", "w"))
    kept = ["gid", "size", "low", "high", "low_same", "high_same"]
    single = [F.xxhash64(F.lit(1), "w").alias("k"), (F.col("i") < F.col("n_index")).alias("index"), (n - F.col("i")).alias("rest")]
    if 2 * num <= den:  # similar sets need not share two words
        return each.select(*kept, *single, F.lit(0).alias("salt"))
    # only a word in many sets can be hot
    met = each.where(F.col("i") >= F.col("rare")).groupBy("w").agg((F.count_if(F.col("i") < F.col("n_index")) * F.count("*")).alias("met"))
    heavy = stage(met.where(F.col("met") > hot))
    tagged = each.join(heavy, "w", "left")
    cold = tagged.where(F.col("met").isNull()).select(*kept, *single, F.lit(0).alias("salt"))
    j = F.col("i") + 1 + F.col("m")
    pairs = tagged.where(F.col("met").isNotNull()).select("*", F.posexplode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("m", "x"))
    pairs = pairs.where(j <= F.col("probe")).select(
        *kept, F.xxhash64(F.lit(2), "w", "x").alias("k"), ((F.col("i") < F.col("n_index")) & (j <= F.col("n_index"))).alias("index"), (n - j + 1).alias("rest"), (F.col("met") > split).alias("big")
    )
    still = pairs.where("big").groupBy("k").agg((F.count_if("index") * F.count("*")).alias("met")).where(F.col("met") > split)
    parts = stage(still.select("k", F.ceil(F.col("met") / split).cast("int").alias("parts")))
    split_ = pairs.join(parts, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a key's index rows are dealt out, its probe rows go to each part; one row may be both
    own = F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")
    salted = split_.select(*kept, "k", "index", "rest", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return cold.unionByName(salted.withColumn("index", F.col("index") & (F.col("own") == F.col("salt"))).drop("own"))


def similar_sets(
    rows: DataFrame, num: int = 4, den: int = 5, min_size: int = 1, hot: int | None = None, split: int | None = None, block: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): every row's set, and the pairs of different sets whose Jaccard similarity is num/den or more.

    ``rows``: field, key, words (sorted distinct strings), one row for each (field, key). members: field, key, set_id
    (one id for equal sets of a field); pairs: set_a, set_b, shared, all_ (sizes of intersection and union), each
    pair once. Sets of fewer than ``min_size`` words, and null keys, are left out; sets are compared within a field.
    ``hot``, ``split`` and ``block`` (``HOT``, ``SPLIT``, ``BLOCK``) only change how the work is laid out.
    """
    hot, split, block = hot or HOT, split or SPLIT, block or BLOCK
    sized = rows.where(F.col("key").isNotNull() & (F.size("words") >= max(1, min_size))).withColumn("set_id", F.unhex(F.md5(F.concat_ws(" ", "field", "words"))))
    members = stage(sized.select("field", "key", "set_id", F.transform("words", lambda w: F.xxhash64(F.col("field"), w)).alias("tokens")))
    sets = stage(members.select("set_id", "tokens").dropDuplicates(["set_id"]))
    heard = sets.select(F.explode("tokens").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for b, n in heard.toPandas().itertuples(index=False):  # at most BUCKETS rows
        counts[b] = n
    grouped = sets.mapInPandas(_prefixes(counts, num, den, hot), "set_id binary, tokens array<long>, prefix array<long>, low long, high long, rare int")
    gid = F.unhex(F.md5(F.concat_ws(" ", F.size("tokens").cast("string"), F.col("prefix").cast("array<string>"))))
    grouped = stage(grouped.select("set_id", "tokens", "prefix", "low", "high", "rare", F.size("tokens").alias("size"), gid.alias("gid")))
    agree = lambda c: F.bitwise_not(F.bit_or(c).bitwiseXOR(F.bit_and(c)))
    groups = stage(
        grouped.groupBy("gid").agg(
            F.first("prefix").alias("prefix"), F.first("size").alias("size"), F.first("rare").alias("rare"), F.count("*").alias("members"),
            F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), agree("low").alias("low_same"), agree("high").alias("high_same"),
        )
    )
    keys = _keys(groups, num, den, hot, split)
    side = lambda df, s: df.select("k", "salt", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in ("k", "salt", "index")])
    both = F.col("size_a") + F.col("size_b")
    bits = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")).bitwiseAND(F.col(f"{c}_same_a")).bitwiseAND(F.col(f"{c}_same_b")))
    near = (
        side(keys.where("index"), "a")
        .join(side(keys, "b"), ["k", "salt"])
        .where(
            (F.col("size_a") <= F.col("size_b"))
            & (F.col("size_a") * den >= F.col("size_b") * num)
            & (F.least("rest_a", "rest_b") * (num + den) >= both * num)
            & (F.shiftright(both - bits("low") - bits("high"), 1) * (num + den) >= both * num)
            & ((F.col("size_a") < F.col("size_b")) | (F.col("gid_a") < F.col("gid_b")))
        )
        .select("gid_a", "gid_b")
        .distinct()
    )
    same = groups.where(F.col("members") > 1).select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b"))
    # a large group's members are compared in blocks, each pair of blocks a key of its own
    large = stage(groups.where(F.col("members") > block).select("gid", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
    placed = grouped.join(large, "gid", "left").select("gid", "set_id", "tokens", F.pmod(F.xxhash64("set_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    todo = near.unionByName(same)
    for s in "ab":
        todo = todo.join(large.select(F.col("gid").alias(f"gid_{s}"), F.col("blocks").alias("n")), f"gid_{s}", "left")
        todo = todo.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias(f"block_{s}")).drop("n")
    x, y = (placed.select(*[F.col(c).alias(f"{c[:3] if c == 'set_id' else c}_{s}") for c in ("gid", "block", "set_id", "tokens")]) for s in "ab")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    pairs = (
        todo.where((F.col("gid_a") != F.col("gid_b")) | (F.col("block_a") <= F.col("block_b")))
        .join(x, ["gid_a", "block_a"])
        .join(y, ["gid_b", "block_b"])
        .where((F.col("gid_a") != F.col("gid_b")) | (F.col("block_a") < F.col("block_b")) | (F.col("set_a") < F.col("set_b")))
        .select("set_a", "set_b", shared.alias("shared"), (F.size("tokens_a") + F.size("tokens_b") - shared).alias("all_"))
        .where(F.col("shared") * den >= F.col("all_") * num)
    )
    return members.select("field", "key", "set_id"), stage(pairs)


def key_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, key_a, key_b) with the smaller key first: all pairs of rows of one set or of similar sets.

    The output is the square of the copies of a set; ``classes`` says the same in one row for each record.
    """
    a = members.select("field", F.col("set_id").alias("set_a"), F.col("key").alias("key_x"))
    b = members.select(F.col("set_id").alias("set_b"), F.col("key").alias("key_y"))
    across = pairs.select("set_a", "set_b").join(a, "set_a").join(b, "set_b").select("field", "key_x", "key_y")
    within = a.join(b.withColumnRenamed("set_b", "set_a"), "set_a").where(F.col("key_x") < F.col("key_y")).select("field", "key_x", "key_y")
    return across.unionByName(within).select("field", F.least("key_x", "key_y").alias("key_a"), F.greatest("key_x", "key_y").alias("key_b"))


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, key, class_id, copies, links): each row's class of equal sets, its size, and the rows in similar classes."""
    size = members.groupBy("set_id").agg(F.count("*").alias("copies"))
    both = pairs.select("set_a", "set_b").unionByName(pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b")))
    links = both.join(size.select(F.col("set_id").alias("set_b"), "copies"), "set_b").groupBy(F.col("set_a").alias("set_id")).agg(F.sum("copies").alias("links"))
    return members.join(size, "set_id").join(links, "set_id", "left").select("field", "key", F.lower(F.hex("set_id")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
