"""The record store as an immutable snapshot of DataFrames; every change gives a new snapshot, published in one step."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.functions.exprs import first_violation, inverse_predicate
from engram.functions.text import norm

RECORDS = (
    "id string, type string, sensitivity string, confidence double, salience double, scope string, tags array<string>, created_at timestamp, "
    "updated_at timestamp, last_reinforced_at timestamp, half_life_seconds long, min_salience double, max_age_seconds long, "
    "reinforcement_gain double, pinned boolean, deletion_policy string, payload_json string, status string, supersedes string, superseded_by string, "
    "created_by string, provenance array<struct<kind:string,ref:string,created_by:string,timestamp:timestamp>>, interpretation_json string"
)
SOURCE = "array<struct<kind:string,ref:string,created_by:string,timestamp:timestamp>>"
RELATIONS = "source_id string, predicate string, target_id string, weight double, created_at timestamp, seq long"
AUDIT = "record_id string, action string, actor string, at timestamp, rationale string, seq long"
EMBEDDINGS = "record_id string, embedding array<float>, model string, created_at timestamp"


class StoreError(Exception):
    """A refused operation; ``code`` is the status a caller would see."""

    code = "INTERNAL"


class NotFound(StoreError):
    code = "NOT_FOUND"


class AlreadyExists(StoreError):
    code = "ALREADY_EXISTS"


class Denied(StoreError):
    code = "PERMISSION_DENIED"


class Invalid(StoreError):
    code = "INVALID_ARGUMENT"


class NotRevisable(StoreError):
    code = "FAILED_PRECONDITION"


@dataclass(frozen=True)
class Snapshot:
    """records, relations (edges out of records), audit (append-only) and embeddings."""

    records: DataFrame
    relations: DataFrame
    audit: DataFrame
    embeddings: DataFrame | None = None

    def having(self, **tables: DataFrame) -> Snapshot:
        return replace(self, **tables)


def as_records(df: DataFrame) -> DataFrame:
    """The columns of ``RECORDS`` in order; those that ``df`` lacks have the value of a new record."""
    new = {
        "sensitivity": "low", "confidence": 1.0, "salience": 1.0, "scope": "", "half_life_seconds": 86_400, "min_salience": 0.0, "max_age_seconds": 0, "reinforcement_gain": 0.0,
        "pinned": False, "deletion_policy": "auto_prune",
    }
    cols = []
    for f in StructType.fromDDL(RECORDS):
        c = F.col(f.name) if f.name in df.columns else F.array() if f.name in ("tags", "provenance") else F.lit(new.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def provenance(kind: str, ref: Column, created_by: Column | str, at: Column) -> Column:
    """One source of a record."""
    by = F.lit(created_by) if isinstance(created_by, str) else created_by
    return F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), by.alias("created_by"), at.alias("timestamp"))


def empty(spark: SparkSession) -> Snapshot:
    """A reset store."""
    return Snapshot(*(spark.createDataFrame([], s) for s in (RECORDS, RELATIONS, AUDIT, EMBEDDINGS)))


def publish(snap: Snapshot, path: str, version: int) -> None:
    """Write a version and make it the current one in a last, atomic step. A version that exists is refused, so of two
    writers that take the same number one fails.

    Records are laid out by type and sorted by salience, so that type filters prune folders and salience filters
    prune row groups.
    """
    spark = snap.records.sparkSession
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}.lock")
    try:
        lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(lock, False).close()
    except Py4JJavaError as e:
        raise AlreadyExists(f"version {version}") from e
    for f in fields(snap):
        if (df := getattr(snap, f.name)) is None:
            continue
        w = df.sortWithinPartitions(F.desc("salience")) if f.name == "records" else df
        w = w.write.mode("errorifexists")
        (w.partitionBy("type") if f.name == "records" else w).parquet(f"{path}/v{version}/{f.name}")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT.{version}")
    fs = to.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(tmp, to, _overwrite(spark))


def _overwrite(spark: SparkSession):
    gateway = spark.sparkContext._gateway
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    return options


def current(spark: SparkSession, path: str) -> Snapshot:
    """The published version."""
    version = json.loads("".join(r[0] for r in spark.read.text(f"{path}/CURRENT").collect()))["version"]
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/v{version}/{name}")
    return Snapshot(read("records", RECORDS), read("relations", RELATIONS), read("audit", AUDIT), read("embeddings", EMBEDDINGS))


# --- reading


def list_records(
    records: DataFrame, type: str = "", scope: str = "", sensitivity: str = "", min_salience: float = 0, max_salience: float = 0,
    tags: Sequence[str] = (), limit: int = 0, offset: int = 0,
) -> DataFrame:
    """Records that meet all given options (zero values are no filter), greatest salience first, then newest, then id."""
    tests: list[Column] = [F.col(c) == v for c, v in (("type", type), ("scope", scope), ("sensitivity", sensitivity)) if v]
    tests += [F.col("salience") >= min_salience] * (min_salience > 0) + [F.col("salience") <= max_salience] * (max_salience > 0)
    tests += [F.array_contains("tags", t) for t in tags]
    out = reduce(DataFrame.where, tests, records).orderBy(F.desc("salience"), F.desc("created_at"), "id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def get(snap: Snapshot, record_id: str) -> DataFrame:
    """One record with its edges and audit entries as arrays; NotFound if there is none."""
    one = snap.records.where(F.col("id") == record_id)
    if one.isEmpty():
        raise NotFound(record_id)
    return hydrate(snap, one)


def hydrate(snap: Snapshot, records: DataFrame) -> DataFrame:
    """Records with their edges and audit entries, each in insertion order."""
    ids = records.select("id")
    edges = snap.relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    rel = edges.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "predicate", "target_id", "weight", "created_at"))).alias("relations"))
    log = snap.audit.join(ids.withColumnRenamed("id", "record_id"), "record_id", "left_semi")
    aud = log.groupBy(F.col("record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "actor", "at", "rationale"))).alias("audit_log"))
    return records.join(rel, "id", "left").join(aud, "id", "left")


def get_batch(snap: Snapshot, ids: Sequence[str]) -> DataFrame:
    """The records of ``ids`` in the order given; unknown ids are left out."""
    spark = snap.records.sparkSession
    order = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "id string, place int")
    return hydrate(snap, snap.records.join(F.broadcast(order), "id")).orderBy("place").drop("place")


def relations_of(snap: Snapshot, record_id: str) -> DataFrame:
    """The edges out of a record in insertion order."""
    if snap.records.where(F.col("id") == record_id).isEmpty():
        raise NotFound(record_id)
    return snap.relations.where(F.col("source_id") == record_id).orderBy("seq")


# --- writing


def add_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (source, predicate, target): weight and time of the last one, place of the first; weight 0 becomes 1."""
    rows = relations.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    key = ["source_id", "predicate", "target_id"]
    last = F.max_by(F.struct("weight", "created_at"), F.struct("__new", "seq")).alias("last")
    merged = rows.groupBy(*key).agg(last, F.min_by("seq", F.struct("__new", "seq")).alias("seq"))
    weight = F.when(F.coalesce("last.weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("last.weight"))
    return merged.select(*key, weight.alias("weight"), F.col("last.created_at").alias("created_at"), "seq")


def both_ways(links: DataFrame, as_of: Column) -> DataFrame:
    """Edges of each link (source_id, predicate, target_id, weight) and of its inverse, each once; self-links make none."""
    rows = links.where(F.col("source_id") != F.col("target_id")).select("source_id", norm("predicate").alias("predicate"), "target_id", "weight").where(F.col("predicate") != "")
    back = rows.select(F.col("target_id").alias("source_id"), inverse_predicate(F.col("predicate")).alias("predicate"), F.col("source_id").alias("target_id"), "weight")
    once = rows.unionByName(back).groupBy("source_id", "predicate", "target_id").agg(F.max("weight").alias("weight"))
    return once.withColumns({"created_at": as_of, "seq": F.unix_micros(as_of)})


def link(snap: Snapshot, new: DataFrame) -> Snapshot:
    """Add edges whose sources exist; else nothing is written."""
    sources = new.select(F.col("source_id").alias("id")).distinct()
    if (missing := sources.join(snap.records.select("id"), "id", "left_anti").first()) is not None:
        raise NotFound(missing["id"])
    return snap.having(relations=add_relations(snap.relations, new))


def create(snap: Snapshot, new: DataFrame, relations: DataFrame | None = None, audit: DataFrame | None = None) -> Snapshot:
    """Add records: all or none. Invalid rows and ids that exist already (or twice) are refused."""
    wrong = new.select("id", first_violation({c: F.col(c) for c in new.columns}).alias("rule")).where(F.col("rule").isNotNull()).first()
    if wrong:
        raise Invalid(f"{wrong['id']}: {wrong['rule']}")
    twice = new.groupBy("id").count().where(F.col("count") > 1).select("id")
    if "payload_json" not in new.columns:
        raise Invalid("payload_json is required")
    clash = new.join(snap.records.select("id"), "id", "left_semi").select("id").unionByName(twice).first()
    if clash:
        raise AlreadyExists(clash["id"])
    return snap.having(
        records=snap.records.unionByName(new.select(*snap.records.columns)),
        relations=snap.relations if relations is None else add_relations(snap.relations, relations),
        audit=snap.audit if audit is None else snap.audit.unionByName(audit),
    )


def update(snap: Snapshot, changed: DataFrame, relations: DataFrame | None = None) -> Snapshot:
    """Replace whole records but for created_at, and their edges if given; audit entries stay as they are."""
    ids = changed.select("id")
    if (missing := ids.join(snap.records.select("id"), "id", "left_anti").first()) is not None:
        raise NotFound(missing["id"])
    born = snap.records.join(ids, "id", "left_semi").select("id", F.col("created_at").alias("__born"))
    rows = changed.join(born, "id").withColumn("created_at", F.col("__born")).select(*snap.records.columns)
    edges = snap.relations
    if relations is not None:
        edges = add_relations(edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti"), relations)
    return snap.having(records=snap.records.join(ids, "id", "left_anti").unionByName(rows), relations=edges)


def delete(snap: Snapshot, ids: DataFrame) -> Snapshot:
    """Remove records with all that belongs to them: edges out and in, audit entries, embeddings."""
    gone = lambda df, c: df.join(ids.select(F.col("id").alias(c)), c, "left_anti")
    return Snapshot(
        gone(snap.records, "id"),
        gone(gone(snap.relations, "source_id"), "target_id"),
        gone(snap.audit, "record_id"),
        None if snap.embeddings is None else gone(snap.embeddings, "record_id"),
    )


def set_salience(records: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """New salience values (id, salience) with updated_at; other records are as before."""
    delta = changes.select("id", F.col("salience").alias("__s"))
    hit = F.col("__s").isNotNull()
    return (
        records.join(delta, "id", "left")
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
        .withColumn("salience", F.coalesce("__s", "salience"))
        .drop("__s")
        .select(*records.columns)
    )


def log_entries(audit: DataFrame, ids: DataFrame, action: str, actor: str, as_of: Column, rationale: Column | str) -> DataFrame:
    """Append one entry for each of ``ids`` (id, and what the rationale needs)."""
    why = F.lit(rationale) if isinstance(rationale, str) else rationale
    new = ids.select(F.col("id").alias("record_id"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), as_of.alias("at"), why.alias("rationale"), F.unix_micros(as_of).alias("seq"))
    return audit.unionByName(new.select(*audit.columns))


# --- embeddings


def store_embeddings(embeddings: DataFrame, new: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Upsert vectors. The first model and size are binding: others are refused."""
    seen = embeddings.agg(F.min("model").alias("m"), F.max("model").alias("n"), F.min(F.size("embedding")).alias("d")).first()
    if seen["m"] is not None and (seen["m"], seen["d"]) != (model, dimensions):
        raise Invalid(f"embeddings are {seen['m']} with {seen['d']} dimensions")
    if not new.where(F.size("embedding") != dimensions).isEmpty():
        raise Invalid(f"a vector has not {dimensions} dimensions")
    rows = new.select("record_id", "embedding", F.lit(model).alias("model"), "created_at")
    return embeddings.join(rows.select("record_id"), "record_id", "left_anti").unionByName(rows)


def get_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored vectors of ``ids`` (id)."""
    return embeddings.join(ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")


def find_exact(facts: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples (subject, predicate, object) with ``id`` of the fact that says just so: the smallest; null if none does."""
    key = ["subject", "predicate", "object"]
    known = facts.groupBy(*key).agg(F.min("id").alias("id"))
    return triples.join(known, key, "left")


# --- entity lookups


def entity_terms(entities: DataFrame) -> DataFrame:
    """(term, entity_id, scope) of the canonical names and aliases."""
    values = F.concat(F.array("canonical_name"), F.coalesce("aliases.value", F.array().cast("array<string>")))
    return (
        entities.select("entity_id", F.coalesce("scope", F.lit("")).alias("scope"), F.explode(values).alias("v"))
        .select(norm("v").alias("term"), "entity_id", "scope")
        .where(F.col("term") != "")
        .distinct()
    )


def find_by_term(terms: DataFrame, queries: DataFrame, limit: int = 1) -> DataFrame:
    """(query_id, entity_id, rank) for each query (query_id, term, scope): own scope before none, then the id."""
    q = queries.select("query_id", norm("term").alias("term"), F.coalesce("scope", F.lit("")).alias("q_scope"))
    hits = q.join(terms, "term").where((F.col("scope") == F.col("q_scope")) | (F.col("scope") == ""))
    best = hits.groupBy("query_id", "entity_id").agg(F.min(F.when((F.col("scope") == F.col("q_scope")) & (F.col("q_scope") != ""), 0).otherwise(1)).alias("far"))
    w = Window.partitionBy("query_id").orderBy("far", "entity_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "entity_id", "rank")


def find_by_identifier(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity_id) for each query (query_id, namespace, value, scope): own scope before none, then the id."""
    ids = entities.select("entity_id", F.coalesce("scope", F.lit("")).alias("scope"), F.explode("identifiers").alias("i")).select("entity_id", "scope", "i.namespace", "i.value")
    q = queries.select("query_id", "namespace", "value", F.coalesce("scope", F.lit("")).alias("q_scope"))
    hits = q.join(ids, ["namespace", "value"]).where((F.col("scope") == F.col("q_scope")) | (F.col("scope") == ""))
    return hits.groupBy("query_id").agg(F.min(F.struct((F.col("scope") == "").alias("far"), "entity_id"))["entity_id"].alias("entity_id"))
