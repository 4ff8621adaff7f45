"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import norm_id
from engram.llm import mapping, mixing, neardup, oracle, quality, runs, sequences, timeline, tokens
from engram.plans.staging import stage
from engram.sources.tables import newest, table

#: p3: the share of all records that must contain a pattern.
SUPPORT = 0.06


#: The mention kinds that name an entity type.
KINDS = {"person": "Person", "tool": "Tool", "project": "Project", "file": "File", "concept": "Concept"}


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The entities with all their names, one row for each name."""
    rows = newest(table(spark, d, "entities"), norm_id("entity_id"), [], ["primary_type", "canonical_name", "aliases", "identifiers", "entity_id"], "norm_key")
    none = F.array().cast("array<string>")
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases.value", none), F.coalesce("identifiers.value", none))
    return rows.select("entity_id", "primary_type", F.explode(names).alias("name"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    cols = ["canonical_entity_id", "surface", "entity_kind", "aliases"]
    return newest(table(spark, d, "mentions"), F.col("mention_id"), [], cols, "mention_id")


def _mapped(spark: SparkSession, d: str, labelled: bool = False) -> DataFrame:
    """The mentions without a known entity (or, to measure, those with one) mapped to the entry meant."""
    known = table(spark, d, "entities").select(norm_id("entity_id").alias("own")).distinct()
    todo = _mentions(spark, d).withColumn("own", norm_id("canonical_entity_id")).join(known, "own", "left_semi" if labelled else "left_anti")
    todo = stage(todo.select("mention_id", "surface", F.col("entity_kind").alias("kind"), "aliases", "own"))
    return mapping.map_mentions(todo, _entries(spark, d), KINDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The entity that each mention without a known one means, '' if none."""
    return _mapped(spark, d).select("mention_id", "entity_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The spellings that fit no entry, with their number of mentions."""
    none = _mapped(spark, d).where(F.col("entity_id") == "").select("mention_id")
    return _mentions(spark, d).join(none, "mention_id").groupBy("surface").agg(F.count("*").alias("mentions"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The mapping measured on the mentions whose entity is known: right, other and none."""
    own = _mentions(spark, d).select("mention_id", norm_id("canonical_entity_id").alias("own"))
    state = F.when(F.col("entity_id") == "", "none").when(norm_id("entity_id") == F.col("own"), "right").otherwise("other")
    return _mapped(spark, d, True).join(own, "mention_id").groupBy(state.alias("state")).agg(F.count("*").alias("mentions"))


def _patterns(spark: SparkSession, d: str) -> list[tuple]:
    lines = timeline.events(table(spark, d, "timeline_events"), refs=False)
    nodes = timeline.tool_nodes(table(spark, d, "tool_nodes"))
    found = sequences.sequence_patterns(lines.select("rid", F.col("kind").alias("name"), "t", F.col("pos").cast("long").alias("pos")), SUPPORT)
    return found + sequences.dependency_patterns(nodes.withColumnRenamed("tool", "name"), SUPPORT)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of 3 or 4 steps that at least 6 of every 100 records contain."""
    return spark.createDataFrame([x[:2] for x in _patterns(spark, d)], "seq_kind string, pattern string")


def p3_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The same with length and support count."""
    return spark.createDataFrame(_patterns(spark, d), "seq_kind string, pattern string, n_steps int, support long")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.events(table(spark, d, "timeline_events"))
    return runs.collapse_runs(rows.withColumn("event", F.concat("kind", F.lit("|"), "ref")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last position of each run of repeated events."""
    return _runs(spark, d).select("record_id", "first_pos", "last_pos")


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run as one event with count and duration."""
    seconds = (F.unix_micros("last_t") - F.unix_micros("first_t")) / 1e6
    kind = F.split("event", r"\|")
    return _runs(spark, d).select("record_id", kind[0].alias("event_kind"), kind[1].alias("ref"), "first_pos", "last_pos", F.col("n").alias("n_events"), F.unix_micros("first_t").alias("first_us"), seconds.alias("seconds"))


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    recall = newest(table(spark, d, "recall_dataset").where(F.col("type") == "record"), norm_id("key"), [], ["text", "summary", "key"], "norm_key", wide=True)
    facts = newest(table(spark, d, "semantic_facts"), norm_id("record_id"), ["updated_at"], ["object", "record_id"], "norm_key", wide=True)
    fields = recall.select(F.col("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("text", "summary")])).alias("v"))
    rows = fields.select("v.field", "key", "v.value").unionByName(facts.select(F.lit("object").alias("field"), F.col("record_id").alias("key"), F.col("object").alias("value")))
    return neardup.similar_sets(rows.select("field", "key", neardup.words(F.col("value")).alias("words")), 3, 5, 6)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose texts, summaries or objects share at least 0.6 of their distinct words."""
    return neardup.key_pairs(*_similar(spark, d))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record's class of equal word sets, the copies in it and its number of links to similar ones."""
    return neardup.classes(*_similar(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every text."""
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _common(spark: SparkSession, d: str) -> dict[str, set[str]]:
    """The reference list of common words: a few hundred rows."""
    out: dict[str, set[str]] = {}
    for r in table(spark, d, "common_words").where(F.col("lang").isNotNull() & F.col("word").isNotNull()).collect():
        out.setdefault(r["lang"], set()).add(r["word"])
    return out


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets")).where(F.col("copies") > 0)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source reaches beside its target."""
    sized = stage(_sized(spark, d))
    return mixing.shares(mixing.mix(sized, table(spark, d, "mix_targets")), table(spark, d, "mix_targets"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source and number of tokens of each document."""
    docs = table(spark, d, "documents")
    return tokens.encode_corpus(docs, "doc_id", "text", counts_only=True, keep=("source",))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every text."""
    return quality.text_statistics(table(spark, d, "documents"), "doc_id", "text", _common(spark, d))


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts among them."""
    return p10_stats(spark, d).select("doc_id", "n_chars", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation_share")])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the combined rules put among lists, tables and junk: running sentences, repeated or not, make up
    less than half of the visible characters."""
    return p10_stats(spark, d).where(F.col("kind").isin("list", "table", "junk")).select("doc_id")


QUERIES = (p1_found, p1_unmatched, p1_agreement, p3_found, p3_patterns, p6_found, p6_runs, p7_found, p7_classes, p8_ids, p9_mix, p9_shares, p10_found, p10_stats, p10_counts)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
