"""Free spellings mapped to the entries of a reference list.

Every distinct token of the spellings is repaired first: it is joined to the reference vocabulary by edit distance,
over keys that two tokens within the distance must share (equal segments at nearby places, Pass-Join), and by prefix
for tokens cut short. The repaired tokens of a spelling are then combined with soft TF-IDF to rank the complete
entries; a spelling whose best entry is not covered well enough fits none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import norm_id
from engram.plans.staging import stage

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсхуіѕјкмтнвԁԛѡһԍզոսаοαρνικτεγ", "aeopcxyisjkmthbdqwhgqnuaoapviktey")
#: Letters that decompose into others only by custom.
SPELT = {"ß": "ss", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"}
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
UNSEEN = re.compile("[\xad\u200b-\u200f\u2060-\u2064\ufeff]")
WORD = re.compile(r"[^\W_]+")
#: Tokens cut short must keep this many characters; shorter abbreviations are not repaired. A parameter of ``repair``.
PREFIX = 4
#: Steps of a similarity, and places of tokens in a spelling (its bytes are fewer), where both are one number.
SCALE, PLACES = 1_000_000, 1 << 31
#: The share of an entry's weight that a spelling must cover.
COVERED = 0.72


def latin(s: str) -> str:
    """Without invisible characters and accents, look-alike letters as Latin ones; letter case is kept."""
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKD", UNSEEN.sub("", s))
    s = "".join(c for c in s if not unicodedata.combining(c))
    return "".join(x.upper() if c.isupper() and not x.isupper() else x for c, x in ((c, SPELT.get(y, y) if not c.isascii() else c) for c in s for y in (c.lower().translate(LOOKALIKES),)))


def token_sets(s: str) -> list[list[str]]:
    """The ways to cut a spelling: into its words, into its camel-case words, and as one word; each without repeats.

    Words are runs of letters and digits of any script. A spelling without any is one token as it is."""
    s = latin(s)
    s = re.sub(r"['’`]s\b", "", s)
    plain = WORD.findall(s.lower()) or s.split()[:1] and [" ".join(s.lower().split())]
    camel = WORD.findall(CAMEL.sub(" ", s).lower())
    out = [list(dict.fromkeys(x)) for x in (plain, camel, ["".join(plain)] if plain else [])]
    return [x for i, x in enumerate(out) if x and x not in out[:i]]


def allowed(length: int) -> int:
    """Edits that a reference token of this length may differ by."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 14 else 3


def allowed_column(length: Column) -> Column:
    return F.when(length < 4, 0).when(length < 6, 1).when(length < 14, 2).otherwise(3)


def _segment(length: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of the i-th segment of a token: one segment more than its edits, so one of them stays whole."""
    parts = allowed_column(length) + 1
    size, more = F.floor(length / parts).cast("int"), F.pmod(length, parts)
    late = F.greatest(i - (parts - more), F.lit(0))
    return i * size + late, size + (i >= parts - more).cast("int")


def _key(length: Column, i: Column, part: Column) -> Column:
    return F.xxhash64(length, i, part)


def reference_keys(word: Column, prefix: int) -> Column:
    """The keys of a reference word: its segments, and its beginning."""
    n = F.length(word)

    def segment(i: Column) -> Column:
        a, k = _segment(n, i)
        return _key(n, i, F.substring(word, a + 1, k))

    return F.array_append(F.transform(F.sequence(F.lit(0), allowed_column(n)), segment), F.xxhash64(F.substring(word, 1, prefix)))


def query_keys(token: Column, prefix: int) -> Column:
    """The keys of a token: for each length that a reference word within the edits may have, the substrings that may be
    its i-th segment whole. With i segments before it and the others behind, no more edits can lie on either side."""
    n, none = F.length(token), F.array().cast("array<bigint>")

    def of_length(length: Column) -> Column:
        edits, longer = allowed_column(length), n - length

        def segment(i: Column) -> Column:
            a, k = _segment(length, i)
            low = F.greatest(F.lit(0), a - i, a + longer - (edits - i))
            high = F.least(n - k, a + i, a + longer + (edits - i))
            return F.when(low <= high, F.transform(F.sequence(low, high), lambda b: _key(length, i, F.substring(token, b + 1, k)))).otherwise(none)

        return F.when(F.abs(longer) <= edits, F.flatten(F.transform(F.sequence(F.lit(0), edits), segment))).otherwise(none)

    near = F.flatten(F.transform(F.sequence(F.greatest(n - 3, F.lit(1)), n + 3), of_length))
    return F.array_distinct(F.concat(near, F.when(n >= prefix, F.array(F.xxhash64(F.substring(token, 1, prefix)))).otherwise(none)))


def _each(fn, arg: str, *outs: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x, *y) for x in pdf[arg] for y in fn(x)]
            yield pd.DataFrame(rows, columns=[arg, *outs])

    return scan


def _cuts(s: str) -> list[tuple[int, list[str], bool]]:
    """Each way to cut a spelling, and whether it is several words written as one."""
    sets = token_sets(s)
    return [(i, x, len(x) == 1 and len(sets) > 1) for i, x in enumerate(sets)]


def repair(tokens: DataFrame, vocabulary: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(token, word, sim): each distinct token with the reference words that it may stand for, sim in (0, 1].

    ``vocabulary``: word, solid. Within the allowed edits of the word, or the beginning of it with ``prefix`` characters
    or more; the cost of a missing end grows with its length. The beginning of several words written as one (solid) is
    no spelling of all of them.
    """
    # so few bytes would be read by one task, though each token makes many keys
    spread = tokens.select("token").repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = spread.select("token", F.explode(query_keys(F.col("token"), prefix)).alias("k"))
    right = vocabulary.select("word", "solid", F.explode(reference_keys(F.col("word"), prefix)).alias("k"))
    edits, n, m = F.levenshtein("token", "word", 3), F.length("token"), F.length("word")
    letters = lambda c: F.sort_array(F.split(c, ""))
    swapped = F.when((edits == 2) & (n == m) & (letters("token") == letters("word")), 0.5).otherwise(0.0)  # two letters swapped are less than two edits
    near = F.when((edits >= 0) & (edits <= allowed_column(m)), 1 - 0.6 * (edits - swapped) / F.greatest(n, m))
    cut = F.when(~F.col("solid") & (n < m) & F.startswith("word", "token") & (n >= prefix), 0.8 + 0.15 * n / m)
    sim = F.greatest(F.coalesce(near, F.lit(0.0)), F.coalesce(cut, F.lit(0.0)))
    return left.join(right, "k").select("token", "word", sim.alias("sim")).where(F.col("sim") > 0).distinct()


def rank_entries(spellings: DataFrame, entries: DataFrame, covered: float = COVERED) -> DataFrame:
    """(spelling, primary_type, entity_id, score, exact): for each distinct spelling, the best entry of each type.

    ``spellings``: spelling. ``entries``: entity_id, primary_type, name; an entry may have several names. ``score`` is
    the weight of the matched words times the share of the name's weight that they cover, which must reach
    ``covered``; ``exact`` tells that the name is spelt just so. Null spellings drop out.
    """
    names = entries.where(F.col("name").isNotNull()).select("entity_id", "primary_type", "name").distinct()
    cut_names = names.select("name").distinct().mapInPandas(_each(_cuts, "name", "form", "words", "solid"), "name string, form int, words array<string>, solid boolean")
    forms = stage(names.join(cut_names, "name").select("entity_id", "primary_type", "name", "words", "solid"))
    entity_words = forms.select("entity_id", "solid", F.explode("words").alias("word")).groupBy("entity_id", "word").agg(F.min("solid").alias("solid"))
    n_entities = F.lit(forms.select("entity_id").distinct().count())
    weights = entity_words.groupBy("word").agg(F.log(1 + n_entities / F.count("*")).alias("idf"), F.min("solid").alias("solid"))
    forms = forms.withColumn("form_id", F.xxhash64("entity_id", "words"))
    postings = forms.select("form_id", F.explode("words").alias("word")).distinct().join(weights.drop("solid"), "word")
    totals = postings.groupBy("form_id").agg(F.sum("idf").alias("total"))
    cut = stage(
        spellings.where(F.col("spelling").isNotNull()).select("spelling").distinct()
        .mapInPandas(_each(_cuts, "spelling", "form", "tokens", "solid"), "spelling string, form int, tokens array<string>, solid boolean")
        .select("spelling", "form", F.posexplode("tokens").alias("at", "token"))
    )
    repaired = stage(repair(cut.select("token").distinct(), weights))
    matched = (
        cut.join(repaired, "token")
        .join(postings, "word")
        .repartition("spelling")  # one exchange for all that follows
        .groupBy("spelling", "form", "form_id", "word")
        .agg(F.max(F.floor(F.col("sim") * SCALE) * PLACES - F.col("at")).alias("best"), F.first("idf").alias("idf"))  # as one number: similarity, then place
        .select("spelling", "form", "form_id", F.ceil(F.col("best") / PLACES).alias("sim"), (F.ceil(F.col("best") / PLACES) * PLACES - F.col("best")).alias("at"), "idf")
        .groupBy("spelling", "form", "form_id", "at")  # one token stands for one word
        .agg(F.max(F.col("sim") / SCALE * F.col("idf")).alias("hit"))
        .groupBy("spelling", "form", "form_id")
        .agg(F.sum("hit").alias("hit"))
    )
    ranked = (
        matched.join(totals, "form_id")
        .where(F.col("hit") >= covered * F.col("total"))
        .join(forms.select("form_id", "entity_id", "primary_type", "name").distinct(), "form_id")
        .select("spelling", "primary_type", F.struct(F.round(F.col("hit") * F.col("hit") / F.col("total"), 6).alias("score"), (F.col("name") == F.col("spelling")).alias("exact"), "entity_id").alias("x"))
    )
    best = ranked.groupBy("spelling", "primary_type").agg(F.max("x").alias("x"))
    return best.select("spelling", "primary_type", F.col("x.entity_id").alias("entity_id"), F.col("x.score").alias("score"), F.col("x.exact").alias("exact"))


def kind_fits(kind: Column, primary_type: Column, kinds: dict[str, str]) -> Column:
    """1 where the kind names the type or, for a kind that names none, no other kind does; 0.5 without a kind; else 0."""
    k, t = F.lower(F.trim(kind)), F.lower(primary_type)
    own = F.lit(False)
    for name, type_ in kinds.items():
        own = own | ((k == name) & (t == type_.lower()))
    other = ~k.isin(*kinds) & ~t.isin(*[x.lower() for x in kinds.values()])
    return F.when(k.isNull() | (k == ""), 0.5).when(own | other, 1.0).otherwise(0.0)


def map_mentions(mentions: DataFrame, entries: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(mention_id, entity_id, score): the entry that each mention means, '' and null if none.

    ``mentions``: mention_id, surface, kind, aliases, one row for each. The surface decides, and the aliases where it
    fits no entry; among entries that a spelling fits about equally, the kind decides, then the exact spelling, then
    the smaller id. Null, blank and unknown surfaces without aliases fit none.
    """
    spelt = stage(
        mentions.select("mention_id", "kind", F.posexplode(F.concat(F.array("surface"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "spelling"))
        .where(norm_id("spelling").isNotNull())
        .withColumn("at", F.least("at", F.lit(1)))
    )
    ranked = rank_entries(spelt.select("spelling"), entries)
    fits = kind_fits(F.col("kind"), F.col("primary_type"), kinds)
    choice = F.struct((-F.col("at")).alias("first"), (F.col("score") * (0.9 + 0.1 * fits)).alias("weighted"), fits.alias("fits"), "exact", F.col("entity_id"), "score")
    found = spelt.join(ranked, "spelling").groupBy("mention_id").agg(F.max(choice).alias("c"))
    return mentions.select("mention_id").join(found, "mention_id", "left").select("mention_id", F.coalesce("c.entity_id", F.lit("")).alias("entity_id"), F.col("c.score").alias("score"))
