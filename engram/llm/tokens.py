"""Encoding of texts with public byte-level BPE vocabularies, and the exact joining of separately encoded halves.

A text is split by the vocabulary's pattern into pieces, and each piece is encoded on its own. Short texts are encoded
whole. A long text is cut into chunks that are encoded in parallel, wherever the cuts fall; then neighbours are joined
in a tree. At a join the pieces that the cut went through are found again: the pattern reads from left to right
without looking back, so reading on from the last certain piece start of the left side until a piece ends where one of
the right side ends gives the whole text's pieces. A piece that spans the join keeps the tokens of both sides but for
a window around the join, which is encoded again and grown until its outer tokens are those of both sides: two
neighbouring tokens that are their own pair's encoding stay so in any longer piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.plans.staging import stage
from engram.sources.tables import one_row_each

#: Where the vocabularies lie; a parameter of each function here.
VOCABULARIES = os.environ.get("ENGRAM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are cut into chunks of this many code points.
CHUNK = 4_096
#: Parts that one node of the tree joins.
FAN = 64
#: A piece that ends this close to a cut could have read on.
REACH = 3


@lru_cache(maxsize=4)
def _ranks(folder: str, name: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(folder: str, name: str):
    """The encoding of a rank file; one for each worker process."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(folder, name), special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


class Coded:
    """A text with its token ids."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


def encode(enc, text: str) -> Coded:
    return Coded(text, enc.encode_ordinary(text))


def _cut(enc, ids: list[int], n_bytes: int, from_end: bool) -> int:
    """How many of ``ids`` at the end (or start) make up exactly ``n_bytes``."""
    k = got = 0
    order = reversed(ids) if from_end else ids
    for x in order:
        if got >= n_bytes:
            break
        got += len(enc.decode_single_token_bytes(x))
        k += 1
    assert got == n_bytes, "a piece boundary is a token boundary"
    return k


def _join_piece(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of one piece from those of its two parts."""
    k = 4
    while left and right:
        a, b = left[-k:], right[:k]
        window = enc._encode_single_piece(b"".join(map(enc.decode_single_token_bytes, [*a, *b])))
        if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2
    return left + right


def join(enc, left: Coded, right: Coded) -> Coded:
    """The coded text of ``left.text + right.text``, exactly."""
    if not left.text or not right.text:
        return left if left.text else right
    pattern = _pattern()
    # a piece start of the left side that its end can't move: found from the last place where one surely begins
    start = _sure_start(left.text)
    pieces = [m.span() for m in pattern.finditer(left.text, start)]
    keep = start
    for a, b in pieces:
        if b > len(left.text) - REACH:
            break
        keep = b
    tail = left.text[keep:]
    both = tail + right.text
    ends_right = _Ends(pattern, right.text)
    new: list[tuple[int, int]] = []
    sync = len(both)
    for m in pattern.finditer(both):
        new.append(m.span())
        if m.end() >= len(tail) and ends_right.has(m.end() - len(tail)):
            sync = m.end()
            break
    used = sync - len(tail)  # code points of the right side that are read again
    k_left = _cut(enc, left.ids, len(tail.encode()), True)
    k_right = _cut(enc, right.ids, len(right.text[:used].encode()), False)
    old_left, old_right = left.ids[len(left.ids) - k_left :], right.ids[:k_right]
    middle: list[int] = []
    for a, b in new:
        if a == 0 and b > len(tail) and b == sync and len(tail) > 0 and _one_piece(pattern, tail) and _one_piece(pattern, right.text[:used]):
            middle += _join_piece(enc, old_left, old_right)
        elif a < len(tail) < b and b - a > CHUNK:
            cut = len(tail)
            middle += _join_piece(enc, enc._encode_single_piece(both[a:cut].encode()), enc._encode_single_piece(both[cut:b].encode()))
        else:
            middle += enc._encode_single_piece(both[a:b].encode())
    return Coded(left.text + right.text, left.ids[: len(left.ids) - k_left] + middle + right.ids[k_right:])


def _one_piece(pattern, text: str) -> bool:
    m = pattern.match(text)
    return m is not None and m.end() == len(text)


class _Ends:
    """The places where pieces of a text end, read only as far as asked."""

    def __init__(self, pattern, text: str):
        self.found, self.todo, self.upto = {0}, pattern.finditer(text), 0

    def has(self, at: int) -> bool:
        while self.upto < at:
            m = next(self.todo, None)
            if m is None:
                break
            self.upto = m.end()
            self.found.add(self.upto)
        return at in self.found


def _sure_start(text: str, step: int = 64) -> int:
    """A place before the last ``REACH`` code points where a piece surely begins: before white space that follows none."""
    i = max(0, len(text) - REACH)
    while i > 0:
        if text[i].isspace() and not text[i - 1].isspace():
            return i
        i -= 1
    return 0


def concat(enc, parts: list[Coded]) -> Coded:
    """All parts joined in a balanced tree."""
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else Coded("", [])


def encode_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str,
    name: str = "byte_bpe_50k",
    folder: str = VOCABULARIES,
    chunk: int = CHUNK,
    fan: int = FAN,
    counts_only: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, *keep, ids) of every text, without special tokens; with ``counts_only`` n_tokens instead of ids.

    Empty and null texts have an empty list. Rows of one id are one row: that with the smallest text, nulls last; null
    ids drop out. ``keep``: columns that stay beside the id; others are ignored, and their names do not matter.
    """
    made = "n_tokens" if counts_only else "ids"
    out = "n_tokens long" if counts_only else "ids array<int>"
    kept = [f"k{i}" for i in range(len(keep))]
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    rows = one_row_each(named, "id", F.min).drop("none")
    long_ = F.coalesce(F.length("text"), F.lit(0)) > chunk
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["id", *kept])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for pdf in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(**{made: [len(x) for x in ids] if counts_only else ids})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for pdf in batches:
            yield pdf.assign(ids=[enc.encode_ordinary(t) for t in pdf["text"]])

    node = f"{head}, no long, text string, ids array<int>"

    def join_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoding(folder, name)
        pdf = pdf.sort_values("no")
        whole_ = concat(enc, [Coded(t, list(map(int, i))) for t, i in zip(pdf["text"], pdf["ids"])])
        return pdf.iloc[:1].assign(no=pdf["no"].iloc[0] // fan, text=whole_.text, ids=[whole_.ids])

    short = rows.where(~long_).mapInPandas(whole, f"{head}, {out}")
    cuts = rows.where(long_).select("id", *kept, "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk))).alias("no"))
    spread = cuts.select("id", *kept, "no", F.substr("text", (F.col("no") * chunk + 1).cast("int"), F.lit(chunk)).alias("text")).repartition("id", "no")
    coded = stage(spread.mapInPandas(parts, node))
    top = coded.agg(F.max("no")).first()[0] or 0
    while top > 0:  # level by level, so no task holds more than one node's parts
        coded = coded.groupBy("id", F.floor(F.col("no") / fan).alias("__up")).applyInPandas(join_parts, node)
        top //= fan
    joined = coded.select("id", *kept, (F.size("ids").cast("long") if counts_only else F.col("ids")).alias(made))
    return short.unionByName(joined).select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, kept)], made)
