"""Queries of the memory store's own operators over the test tables, each beside the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import exprs as ex
from engram.functions.text import norm
from engram.operators import capture, consolidate, evalkit, flatten, graph, ingest, lifecycle, metrics, retrieve, revise, store, texts, trust, vectors
from engram.plans import views as v
from engram.plans.staging import stage
from engram.plans.general import INTERPRETATION_ARRAYS
from engram.plans.general import _JSON as JSON_OF
from engram.plans.general import _items as items_sql
from engram.plans.views import as_of, sql
from engram.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


CONTEXT = trust.Trust("medium", ("project:lanternfield", "user:berfalber"))
SEEN = "rank >= 0 AND rank <= 2 AND (scope = '' OR scope IN ('project:lanternfield', 'user:berfalber'))"
ABOVE = "rank = 3 AND (scope = '' OR scope IN ('project:lanternfield', 'user:berfalber'))"
TEXT = "restart the obsidian-registry in staging"
HALF = "0.6931471805599453"

# --- filters and listing


@query("ref_list_records", sql("rec", "SELECT id, salience, epoch_us(created_at) AS created_us FROM rec WHERE type = 'semantic' AND sensitivity = 'low' AND salience >= 0.2 AND salience <= 0.9"))
def list_records(spark, d):
    return store.list_records(v.rec(spark, d), type="semantic", sensitivity="low", min_salience=0.2, max_salience=0.9).select("id", "salience", F.unix_micros("created_at").alias("created_us"))


@query("ref_list_tags_all", sql("rec", "SELECT id, len(tags) AS n_tags FROM rec WHERE list_contains(tags, 'session') AND scope <> ''"))
def list_tags(spark, d):
    return store.list_records(v.rec(spark, d), tags=["session"]).where(F.col("scope") != "").select("id", F.size("tags").cast("long").alias("n_tags"))


@query("ref_trust_filter", sql("rec", f"SELECT id, {ABOVE} AS redacted, CASE WHEN {ABOVE} THEN 0 ELSE half_life_seconds END AS half_life_seconds FROM rec WHERE {SEEN} OR {ABOVE}"))
def trust_filter(spark, d):
    return trust.visible(v.rec(spark, d), CONTEXT).select("id", "redacted", "half_life_seconds")


@query("ref_sensitivity_filter", sql("rec", "SELECT sensitivity, count(*) AS n FROM rec WHERE rank BETWEEN 0 AND 2 GROUP BY 1"))
def sensitivity(spark, d):
    return trust.up_to(v.rec(spark, d), "medium").groupBy("sensitivity").agg(F.count("*").alias("n"))


# the kind of a record's payload: from its text, else from the table that holds its rows
KIND_OF = f"""SELECT id, max(kind) AS kind FROM (SELECT {v._NORM.format('record_id')} AS id, 'semantic' AS kind FROM semantic_facts UNION ALL SELECT {v._NORM.format('record_id')}, 'episodic' FROM timeline_events
    UNION ALL SELECT id, json_extract_string(j, '$.kind') FROM ({JSON_OF.format(key=v._NORM.format('record_id'), at='written_at', col='payload_json', table='payloads')})) WHERE id IS NOT NULL GROUP BY 1"""


def _kinds(spark, d):
    raw = v.newest(table(spark, d, "payloads"), v.norm_id("record_id"), ["written_at"], ["payload_json"], "id", wide=True)
    told = raw.select("id", F.get_json_object(flatten.record_texts(F.col("payload_json"), ()), "$.kind").alias("payload_kind"))
    flat = [table(spark, d, t).select(v.norm_id("record_id").alias("id"), F.lit(k).alias("payload_kind")) for t, k in (("semantic_facts", "semantic"), ("timeline_events", "episodic"))]
    return told.unionByName(flat[0]).unionByName(flat[1]).where(F.col("id").isNotNull()).groupBy("id").agg(F.max("payload_kind").alias("payload_kind"))


@query("ref_validity", sql("", f"""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN coalesce(m.id, '') = '' THEN 'id is required' WHEN coalesce(type, '') = '' THEN 'type is required'
    WHEN type NOT IN ('episodic','working','semantic','competence','plan_graph','entity') THEN 'type is unknown' WHEN coalesce(sensitivity, '') = '' THEN 'sensitivity is required'
    WHEN sensitivity NOT IN ('public','low','medium','high','hyper') THEN 'sensitivity is unknown' WHEN confidence < 0 OR confidence > 1 THEN 'confidence must be in [0, 1]' WHEN salience < 0 THEN 'salience must not be negative'
    WHEN k.kind IS NULL THEN 'payload is required' WHEN k.kind <> type THEN 'payload must be of the record''s type' ELSE 'valid' END AS rule
    FROM memory_records m LEFT JOIN kinds k ON k.id = {v._NORM.format('m.id')}) GROUP BY 1""", kinds=KIND_OF))
def validity(spark, d):
    df = table(spark, d, "memory_records").withColumn("__id", v.norm_id("id")).join(_kinds(spark, d).withColumnRenamed("id", "__id"), "__id", "left")
    rule = F.coalesce(ex.first_violation({c: F.col(c) for c in df.columns}), F.lit("valid"))
    return df.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


# --- retrieval


@query("ref_retrieve_salience", sql("rec", f"""SELECT id, salience, row_number() OVER (ORDER BY salience DESC, id) AS place FROM rec WHERE ({SEEN} OR {ABOVE})
    AND salience >= 0.1 AND type IN ('semantic','working') ORDER BY salience DESC, id LIMIT 100"""))
def retrieve_salience(spark, d):
    """A top-k request: the limit is its meaning."""
    df = retrieve.retrieve(v.rec(spark, d), CONTEXT, as_of(), limit=100, min_salience=0.1, types=("semantic", "working"))
    return df.select("id", "salience", F.row_number().over(Window.orderBy(F.desc("salience"), "id")).alias("place"))


SELECTED = f"""SELECT id, scope, type, salience, CASE WHEN NOT has_payload THEN 0.5 ELSE (confidence + CASE WHEN success_count + failure_count > 0
    THEN success_count / (success_count + failure_count) ELSE 0.5 END + CASE WHEN epoch_us(as_of) <= epoch_us(last_reinforced_at) THEN 1.0
    ELSE exp(-{HALF} * (epoch_us(as_of) - epoch_us(last_reinforced_at)) / 86400e6 / 30) END) / 3 END AS score FROM rec WHERE type IN ('competence','plan_graph')"""


@query("ref_select_scores", sql("rec", "SELECT id, round(score, 6) AS score FROM picks", picks=SELECTED))
def select_scores(spark, d):
    picks = v.rec(spark, d).where(F.col("type").isin(*retrieve.PROCEDURES))
    return retrieve.select(picks, as_of()).select("id", r6("selection_score", "score"))


@query("ref_select_confidence", sql("rec", """SELECT scope, n AS candidates, round(CASE WHEN n = 1 THEN least(a, 1.0) WHEN a > 0 THEN (a - b) / a ELSE 0 END, 6) AS confidence,
    CASE WHEN n = 1 THEN least(a, 1.0) WHEN a > 0 THEN (a - b) / a ELSE 0 END < 0.7 AS needs_more FROM (SELECT scope, count(*) AS n, max(score) AS a,
    max(CASE WHEN no = 2 THEN score END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS no FROM picks) GROUP BY 1)""", picks=SELECTED))
def select_confidence(spark, d):
    picks = retrieve.select(v.rec(spark, d).where(F.col("type").isin(*retrieve.PROCEDURES)), as_of())
    return retrieve.selection_confidence(picks, by=["scope"]).select("scope", "candidates", r6("confidence", "confidence"), "needs_more")


@query("ref_retrieve_text", sql("rec", f"""SELECT id, CASE WHEN type IN ('competence','plan_graph') THEN 0 ELSE 2 END AS band FROM rec WHERE {SEEN} OR {ABOVE}"""))
def retrieve_text(spark, d):
    return retrieve.retrieve(v.rec(spark, d), CONTEXT, as_of(), query="restart the gateway").select("id", "band")


# Each vector whose number 50 divides, against all vectors.
EVERY, DIMENSIONS = 50, 64
NEAR_ALL = f"""SELECT q_id, vec_id, (list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) + 1) / 2 AS sim FROM
    (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {EVERY} = 0)"""


def _searches(spark, d):
    emb = table(spark, d, "embeddings")
    doc = F.concat(F.lit("doc-"), "vec_id")
    return emb.select(doc.alias("record_id"), "embedding"), emb.where(F.col("vec_id") % EVERY == 0).select(doc.alias("query_id"), "embedding")


@query("ref_vector_similarity", sql("", f"SELECT 'doc-' || q_id AS query_id, 'doc-' || vec_id AS record_id, round(sim, 6) AS similarity FROM ({NEAR_ALL})"))
def vector_similarity_all(spark, d):
    emb, asked = _searches(spark, d)
    return retrieve.similarities(asked, emb).select("query_id", "record_id", r6("similarity", "similarity"))


@query("ref_hybrid_rank", sql("", """SELECT q.query_id, c.id, round(0.7 * (1 - (no - 1) / n) + 0.3 * salience, 6) AS hybrid, CASE WHEN no IS NULL THEN 2 ELSE 1 END AS band
    FROM cand c CROSS JOIN (SELECT DISTINCT query_id FROM hits) q LEFT JOIN hits h ON c.id = h.id AND h.query_id = q.query_id""",
    cand="SELECT 'doc-' || doc_id AS id, least(coalesce(n_chars, 0) / 2000.0, 1.0) AS salience FROM documents",
    hits=f"""SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT 'doc-' || q_id AS query_id, 'doc-' || vec_id AS id, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, 'doc-' || vec_id) AS no
    FROM ({NEAR_ALL})) WHERE no <= (SELECT greatest(500, 10 * count(*)) FROM documents)"""))  # fmt: skip
def hybrid_all(spark, d):
    emb, asked = _searches(spark, d)
    cand = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.least(F.coalesce("n_chars", F.lit(0)) / 2000.0, F.lit(1.0)).alias("salience"))
    return retrieve.hybrid_order(retrieve.vector_rank(cand, emb, asked)).select("query_id", "id", r6("hybrid_score", "hybrid"), "band")


@query("ref_index_recall", sql("", f"SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % {EVERY} = 0"))
def index_recall(spark, d):
    """The inverted-file index measured against all vectors: whether the mean recall of the 10 nearest reaches 0.9."""
    emb, asked = _searches(spark, d)
    got = vectors.recall(vectors.build(emb, DIMENSIONS, lists=64), asked, 10, probes=40)
    return got.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


NEAR_ONE = NEAR_ALL.replace(f"WHERE vec_id % {EVERY} = 0", "WHERE vec_id = 0")


@query("ref_select_similarity", sql("", f"""SELECT c.id, round((coalesce(sim, confidence) + 0.5 + CASE WHEN created_at IS NULL THEN 0.5 WHEN created_at >= TIMESTAMP '{v.AS_OF}' THEN 1.0
    ELSE exp(-{HALF} * (epoch_us(TIMESTAMP '{v.AS_OF}') - epoch_us(created_at)) / 86400e6 / 30) END) / 3, 6) AS score FROM cand c LEFT JOIN ({NEAR_ONE}) n ON c.id = 'doc-' || n.vec_id""",
    cand="SELECT 'doc-' || doc_id AS id, least(coalesce(n_chars, 0) / 2000.0, 1.0) AS confidence, created_at::TIMESTAMP AS created_at FROM (SELECT DISTINCT ON (doc_id) * FROM documents ORDER BY doc_id) WHERE memory_type IN ('competence', 'plan_graph')"))
def select_similarity(spark, d):
    """The procedures of one request, whose vector is that of the first embedding."""
    emb = table(spark, d, "embeddings").select(F.concat(F.lit("doc-"), "vec_id").alias("record_id"), "embedding", "vec_id")
    vector = list(emb.where("vec_id = 0").first()["embedding"])
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"]).select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.col("memory_type").alias("type"), F.least(F.coalesce("n_chars", F.lit(0)) / 2000.0, F.lit(1.0)).alias("confidence"), F.lit(0).alias("success_count"),
        F.lit(0).alias("failure_count"), F.lit(None).cast("double").alias("failure_rate"), F.col("created_at").cast("timestamp").alias("last_reinforced_at"), F.lit(True).alias("has_payload"),
    )
    return retrieve.selected(docs, as_of(), emb, vector).select("id", r6("selection_score", "score"))


# --- entities and graph

TERMS = "SELECT DISTINCT lower(trim(n)) AS term, entity_id, scope FROM (SELECT entity_id, scope, unnest(list_concat([canonical_name], [a.value FOR a IN coalesce(aliases, [])])) AS n FROM ent) WHERE trim(n) <> ''"


@query("ref_entity_lookup", sql("ent mention rec", """SELECT mention_id, entity_id, far FROM (SELECT m.mention_id, t.entity_id, CASE WHEN t.scope = r.scope AND r.scope <> '' THEN 0 ELSE 1 END AS far,
    row_number() OVER (PARTITION BY m.mention_id ORDER BY CASE WHEN t.scope = r.scope AND r.scope <> '' THEN 0 ELSE 1 END, t.entity_id) AS no
    FROM mention m JOIN rec r ON m.id = r.id JOIN terms t ON t.term = lower(trim(m.surface)) AND (t.scope = r.scope OR t.scope = '')) WHERE no = 1""", terms=TERMS))
def entity_lookup(spark, d):
    scopes = v.rec(spark, d).select("id", "scope")
    asked = v.mention(spark, d).join(scopes, "id").select(F.col("mention_id").alias("query_id"), F.col("surface").alias("term"), "scope")
    terms = store.entity_terms(v.ent(spark, d))
    found = store.find_by_term(terms, asked).select(F.col("query_id").alias("mention_id"), "entity_id")
    own = asked.join(terms.withColumnRenamed("scope", "s"), norm(asked["term"]) == terms["term"]).where((F.col("s") == F.col("scope")) & (F.col("scope") != "")).select(F.col("query_id").alias("mention_id")).distinct()
    return found.join(own.withColumn("own", F.lit(True)), "mention_id", "left").select("mention_id", "entity_id", F.when(F.col("own"), 0).otherwise(1).alias("far"))


@query("ref_entity_identifier", sql("ent", "SELECT i.value AS query_id, min(entity_id) AS entity_id FROM (SELECT entity_id, scope, unnest(identifiers) AS i FROM ent) WHERE scope = '' GROUP BY i.namespace, i.value"))
def entity_identifier(spark, d):
    e = v.ent(spark, d)
    asked = e.select(F.explode("identifiers").alias("i"), F.coalesce("scope", F.lit("")).alias("s")).where("s = ''").select(F.col("i.value").alias("query_id"), "i.namespace", "i.value", F.lit("").alias("scope")).distinct()
    return store.find_by_identifier(e, asked)


@query("ref_root_boost", sql("ent", f"""SELECT entity_id AS id, boost FROM (SELECT entity_id, CASE WHEN hit(canonical_name) THEN 100 ELSE 0 END
    + CASE WHEN len([a FOR a IN coalesce(aliases, []) IF hit(a.value)]) > 0 THEN 75 ELSE 0 END + CASE WHEN len([t FOR t IN coalesce(types, []) IF hit(t)]) > 0 THEN 15 ELSE 0 END AS boost FROM ent) WHERE boost > 0""").replace("hit(canonical_name)", f"(contains(lower(trim(canonical_name)), '{TEXT}') OR contains('{TEXT}', lower(trim(canonical_name))))").replace("hit(a.value)", f"(contains(lower(trim(a.value)), '{TEXT}') OR contains('{TEXT}', lower(trim(a.value))))").replace("hit(t)", f"(contains(lower(trim(t)), '{TEXT}') OR contains('{TEXT}', lower(trim(t))))"))  # fmt: skip
def root_boost(spark, d):
    e = v.ent(spark, d).withColumn("aliases", F.col("aliases.value"))
    return e.select(F.col("entity_id").alias("id"), graph.entity_boost(F.lit(TEXT)).alias("boost")).where("boost > 0")


def _links(spark, d):
    """Edges between records and the entities they mention, both ways."""
    m = v.mention(spark, d).where(F.col("id").isNotNull() & F.col("entity_id").isNotNull())
    there = m.groupBy(F.col("id").alias("source_id"), F.col("entity_id").alias("target_id")).agg(F.min("mention_id").alias("seq"), F.max("confidence").alias("weight"))
    out = there.select("source_id", F.lit("mentions_entity").alias("predicate"), "target_id", "weight", "seq")
    back = there.select(F.col("target_id").alias("source_id"), F.lit("mentioned_in").alias("predicate"), F.col("source_id").alias("target_id"), "weight", "seq")
    return out.unionByName(back)


LINKS = """SELECT s AS source_id, p AS predicate, t AS target_id FROM (SELECT DISTINCT id AS s, 'mentions_entity' AS p, entity_id AS t FROM mention WHERE id IS NOT NULL AND entity_id IS NOT NULL
    UNION SELECT DISTINCT entity_id, 'mentioned_in', id FROM mention WHERE id IS NOT NULL AND entity_id IS NOT NULL)"""


NAME = "obsidian-registry"


def hit(c: str, query: str) -> str:
    """lexical_match in SQL."""
    c = f"lower(trim({c}))"
    return f"({c} <> '' AND (contains({c}, '{query}') OR contains('{query}', {c})))"


def any_hit(list_: str, query: str) -> str:
    return f"len(list_filter(coalesce({list_}, []), lambda x: x IS NOT NULL AND {hit('x', query)})) > 0"


ALIASES = "list_transform(coalesce(aliases, []), lambda a: a.value)"
RISE = "CASE trim(lower(predicate)) " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in ex.BOOSTS.items()) + " ELSE 0 END"
LINKED = f"""SELECT l.source_id AS id, sum(CASE WHEN {hit('e.canonical_name', NAME)} THEN 60 + {RISE} ELSE 0 END + CASE WHEN {any_hit(ALIASES, NAME)} THEN 45 + {RISE} ELSE 0 END)::BIGINT AS linked
    FROM links l JOIN ent e ON e.entity_id = l.target_id GROUP BY 1"""


@query("ref_linked_boost", sql("ent mention", "SELECT id, linked FROM linked WHERE linked > 0", links=LINKS, linked=LINKED))
def linked_boost(spark, d):
    return graph.linked_boost(_links(spark, d), v.named(spark, d), F.lit(NAME)).select("id", F.col("linked").cast("long").alias("linked"))


NODES = "SELECT id FROM rec UNION ALL SELECT entity_id FROM ent"


def _graph(spark, d, hops):
    e = v.ent(spark, d)
    roots = e.where(norm("canonical_name") == "obsidian-registry").select(F.col("entity_id").alias("id"), F.lit(0).alias("root_rank"))
    all_ = v.rec(spark, d).select("id").unionByName(e.select(F.col("entity_id").alias("id")))
    return graph.expand(roots, stage(_links(spark, d)), all_, None, graph.Limits(1, None, None, hops))


@query("ref_graph_1hop", sql("rec ent mention", """SELECT source_id, predicate, target_id FROM links WHERE source_id = (SELECT entity_id FROM ent WHERE lower(trim(canonical_name)) = 'obsidian-registry')
    AND target_id IN (SELECT id FROM nodes)""", links=LINKS, nodes=NODES))
def graph_1hop(spark, d):
    return _graph(spark, d, 1)[1].select("source_id", "predicate", "target_id")


@query("ref_graph_2hop", sql("rec ent mention", "SELECT id, min(hop)::INTEGER AS hop FROM h GROUP BY 1", links=LINKS, nodes=NODES,
    h="""SELECT entity_id AS id, 0 AS hop FROM ent WHERE lower(trim(canonical_name)) = 'obsidian-registry' UNION ALL
    SELECT l.target_id, h.hop + 1 FROM h JOIN links l ON l.source_id = h.id JOIN nodes n ON n.id = l.target_id WHERE h.hop < 2"""))  # fmt: skip
def graph_2hop(spark, d):
    return _graph(spark, d, 2)[0].select("id", "hop")


# The whole request: the records of a query and the entities it names, reranked, with their neighbourhood.
SEQ = """SELECT s AS source_id, p AS predicate, t AS target_id, min(no) AS seq FROM (SELECT id AS s, 'mentions_entity' AS p, entity_id AS t, mention_id AS no FROM mention WHERE id IS NOT NULL AND entity_id IS NOT NULL
    UNION ALL SELECT entity_id, 'mentioned_in', id, mention_id FROM mention WHERE id IS NOT NULL AND entity_id IS NOT NULL) GROUP BY 1, 2, 3"""
GRAPH = dict(
    links=LINKS, linked=LINKED, seqs=SEQ, terms=TERMS, picks=SELECTED.replace("SELECT id, scope, type, salience,", "SELECT id,"),
    allr="SELECT id, type, salience, scope, rank FROM rec UNION ALL SELECT entity_id, 'entity', 0.5, scope, 1 FROM ent", seen=f"SELECT *, NOT ({SEEN}) AS redacted FROM allr WHERE {SEEN} OR {ABOVE}",
    base0="""SELECT id, redacted, row_number() OVER (ORDER BY band, key DESC, id) - 1 AS place FROM (SELECT s.id, redacted, CASE WHEN type IN ('competence','plan_graph') THEN 0 ELSE 2 END AS band,
      CASE WHEN type NOT IN ('competence','plan_graph') THEN salience WHEN redacted THEN 0.5 ELSE p.score END AS key FROM seen s LEFT JOIN picks p ON p.id = s.id) ORDER BY band, key DESC, id LIMIT 30""",
    called=f"""SELECT entity_id AS id, min(no) AS no FROM (SELECT entity_id, i * 1000 + row_number() OVER (PARTITION BY i ORDER BY t.scope <> q.scope, entity_id) AS no FROM terms t JOIN (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(CONTEXT.scopes))}) q(i, scope)
      ON t.term = '{NAME}' AND (t.scope = q.scope OR t.scope = '') QUALIFY row_number() OVER (PARTITION BY i ORDER BY t.scope <> q.scope, entity_id) <= 10) GROUP BY 1""",
    base="SELECT id, redacted, row_number() OVER (ORDER BY a, b) - 1 AS place FROM (SELECT id, redacted, 0 AS a, place AS b FROM base0 UNION ALL SELECT c.id, s.redacted, 1, c.no FROM called c JOIN seen s USING (id) WHERE c.id NOT IN (SELECT id FROM base0))",
    own=f"SELECT entity_id AS id, CASE WHEN {hit('canonical_name', NAME)} THEN 100 ELSE 0 END + CASE WHEN {any_hit(ALIASES, NAME)} THEN 75 ELSE 0 END + CASE WHEN {any_hit('types', NAME)} THEN 15 ELSE 0 END AS own FROM ent",
    told=f"""SELECT id, sum(CASE WHEN s AND before = 0 THEN 30 WHEN NOT s AND a AND before = 0 THEN 20 ELSE 0 END) AS said FROM (SELECT *, coalesce(sum(s::INT) OVER (PARTITION BY id ORDER BY pos, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT id, pos, mention_id, coalesce({hit('surface', NAME)}, false) AS s, {any_hit('aliases', NAME)} AS a FROM mention WHERE id IS NOT NULL)) GROUP BY 1""",
    roots="""SELECT id, row_number() OVER (ORDER BY score DESC, place) - 1 AS root_rank FROM (SELECT b.id, place, (SELECT count(*) FROM base) - place + CASE WHEN redacted THEN 0 ELSE coalesce(own, 0) + coalesce(said, 0) + coalesce(linked, 0) END AS score
      FROM base b LEFT JOIN own USING (id) LEFT JOIN told USING (id) LEFT JOIN linked USING (id)) ORDER BY score DESC, place LIMIT 10""",
    out="""SELECT s.*, row_number() OVER (ORDER BY root_rank, seq, predicate, target_id) AS o, target_id IN (SELECT id FROM roots) AS home FROM seqs s JOIN roots r ON r.id = s.source_id WHERE target_id IN (SELECT id FROM seen) OR target_id IN (SELECT id FROM roots)""",
    admitted="SELECT target_id AS id FROM out WHERE NOT home GROUP BY 1 ORDER BY min(o) LIMIT (SELECT 25 - count(*) FROM roots)",
    kept="SELECT source_id, predicate, target_id, row_number() OVER (ORDER BY o) AS place FROM out WHERE home OR target_id IN (SELECT id FROM admitted) ORDER BY o LIMIT 100",
)


def _found(spark, d):
    said = v.mention(spark, d).where(F.col("id").isNotNull()).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mention_id", "surface", "aliases"))), lambda m: F.struct(m["surface"].alias("surface"), m["aliases"].alias("aliases"))).alias("mentions"))
    return graph.retrieve_graph(v.everything(spark, d), stage(_links(spark, d)), v.named(spark, d), said, CONTEXT, as_of(), NAME)


@query("ref_graph_roots", sql("rec ent mention", "SELECT id, root_rank::INTEGER AS root_rank FROM roots", **GRAPH))
def graph_roots(spark, d):
    return _found(spark, d).roots.select("id", F.col("root_rank").cast("int").alias("root_rank"))


@query("ref_graph_nodes", sql("rec ent mention", "SELECT n.id, hop, s.redacted FROM (SELECT id, 0 AS hop FROM roots UNION ALL SELECT DISTINCT target_id, 1 FROM kept WHERE target_id IN (SELECT id FROM admitted)) n JOIN seen s USING (id)", **GRAPH))
def graph_nodes(spark, d):
    return _found(spark, d).nodes.select("id", "hop", "redacted")


@query("ref_graph_edges", sql("rec ent mention", "SELECT source_id, predicate, target_id, place FROM kept", **GRAPH))
def graph_edges(spark, d):
    return _found(spark, d).edges.select("source_id", "predicate", "target_id", "place")


# --- lifecycle

DECAYED = f"""SELECT *, CASE WHEN s0 > 0 THEN greatest(s0 * exp(-greatest((epoch_us(as_of) - epoch_us(last_reinforced_at)) / 1e6, 0) * {HALF} / half_life_seconds), min_salience) ELSE s0 END AS s1
    FROM (SELECT *, CASE WHEN max_age_seconds > 0 AND (epoch_us(as_of) - epoch_us(created_at)) / 1e6 >= max_age_seconds THEN 0.0 ELSE salience END AS s0 FROM rec)"""


@query("ref_decay_sweep", sql("rec", "SELECT id, round(CASE WHEN pinned THEN salience ELSE s1 END, 6) AS salience FROM dec", dec=DECAYED))
def decay_sweep(spark, d):
    return lifecycle.sweep(v.rec(spark, d), as_of()).select("id", r6("salience", "salience"))


@query("ref_prune", sql("rec", "SELECT id FROM dec WHERE NOT pinned AND deletion_policy = 'auto_prune' AND s1 <= min_salience AND s1 < 0.001", dec=DECAYED))
def prune(spark, d):
    return lifecycle.sweep(v.rec(spark, d), as_of()).where(lifecycle.prunable()).select("id")


@query("ref_reinforce", sql("rec", "SELECT id, round(CASE WHEN digit < 4 THEN least(salience + 0.1, 1.0) ELSE salience END, 6) AS salience, epoch_us(CASE WHEN digit < 4 THEN as_of ELSE last_reinforced_at END) AS clock_us FROM rec"))
def reinforce(spark, d):
    rec = v.rec(spark, d)
    return lifecycle.reinforce(rec, rec.where(v.digit() < 4), as_of()).select("id", r6("salience", "salience"), F.unix_micros("last_reinforced_at").alias("clock_us"))


@query("ref_penalize", sql("rec", "SELECT id, round(CASE WHEN digit < 4 THEN greatest(salience - 0.25, min_salience) ELSE salience END, 6) AS salience FROM rec"))
def penalize(spark, d):
    rec = v.rec(spark, d)
    return lifecycle.penalize(rec, rec.where(v.digit() < 4).select("id", F.lit(0.25).alias("amount")), as_of()).select("id", r6("salience", "salience"))


@query("ref_compress", sql("rec", "SELECT id, round(CASE WHEN type = 'episodic' AND NOT pinned AND epoch_us(as_of) - epoch_us(created_at) >= 86400000000 AND salience > 0.05 THEN greatest(salience * 0.5, 0.05) ELSE salience END, 6) AS salience FROM rec"))
def compress(spark, d):
    return consolidate.compress(v.rec(spark, d), as_of()).select("id", r6("salience", "salience"))


# --- consolidation


# No table tells the outcome of an episode that has a timeline or a tool graph, so every episode counts as successful.


def _told(spark, d):
    return v.line(spark, d).select(F.col("id").alias("record_id"), F.struct("id", "pos").alias("place"), "event_kind", "summary")


def _known_facts(spark, d):
    return spark.createDataFrame([("heartbeat", "fact-heartbeat", 0.95), ("approval", "fact-approval", 0.4)], "subject string, fact_id string, salience double")


TOLD = "SELECT id, pos, coalesce(event_kind, '') AS event_kind, summary FROM line WHERE coalesce(summary, '') <> ''"
NEW_FACTS = """SELECT event_kind AS subject, 'observed_in' AS predicate, first(summary ORDER BY id, pos) AS object, first(id ORDER BY id, pos) AS derived_from, count(*) - 1 AS reinforcements
    FROM told WHERE event_kind NOT IN ('heartbeat', 'approval') GROUP BY 1"""


@query("ref_semantic_new", sql("line", NEW_FACTS, told=TOLD))
def semantic_new(spark, d):
    return consolidate.semantic_facts(_told(spark, d), _known_facts(spark, d))[0]


@query("ref_semantic_reinforced", sql("line", "SELECT 'fact-' || event_kind AS fact_id, CASE event_kind WHEN 'heartbeat' THEN 1.0 ELSE 0.5 END::DOUBLE AS salience, count(*) AS matches FROM told WHERE event_kind IN ('heartbeat', 'approval') GROUP BY 1, 2", told=TOLD))
def semantic_reinforced(spark, d):
    return consolidate.semantic_facts(_told(spark, d), _known_facts(spark, d))[1].select("fact_id", r6("salience", "salience"), "matches")


def _made(prefix: str, *cols: str) -> str:
    return f"'{prefix}' || substr(sha256(concat_ws(chr(31), {', '.join(cols)})), 1, 32)"


def _entity_of(term: str, scope: str) -> str:
    """The first entity that a term names, own scope before none."""
    return f"(SELECT t.entity_id FROM terms t WHERE t.term = lower(trim({term})) AND (t.scope = {scope} OR t.scope = '') ORDER BY t.scope <> {scope}, t.entity_id LIMIT 1)"


@query("ref_fact_edges", sql("line rec ent", """SELECT id AS source_id, 'derived_from' AS predicate, derived_from AS target_id FROM made UNION ALL SELECT id, 'subject_entity', s FROM made WHERE s IS NOT NULL UNION ALL SELECT s, 'fact_subject_of', id FROM made WHERE s IS NOT NULL
    UNION ALL SELECT id, 'object_entity', o FROM made WHERE o IS NOT NULL UNION ALL SELECT o, 'fact_object_of', id FROM made WHERE o IS NOT NULL""", told=TOLD, terms=TERMS, new=NEW_FACTS,
    made=f"SELECT {_made('fact-', 'subject', 'predicate', 'object', 'derived_from')} AS id, derived_from, {_entity_of('subject', 'r.scope')} AS s, {_entity_of('object', 'r.scope')} AS o FROM new n JOIN rec r ON r.id = n.derived_from"))
def fact_edges(spark, d):
    """The edges of the facts that consolidation writes: to their episode and to the entities they name."""
    new, _ = consolidate.semantic_facts(_told(spark, d), _known_facts(spark, d))
    return consolidate.fact_records(new, v.rec(spark, d), store.entity_terms(v.ent(spark, d)), as_of()).relations.select("source_id", "predicate", "target_id")


BAGS = "SELECT id, string_agg(trim(tool), '+' ORDER BY trim(tool)) AS sig FROM node WHERE trim(coalesce(tool, '')) <> '' GROUP BY id"
SKILLS = """SELECT 'skill:' || sig AS skill_name, count(*) AS success_count, CASE WHEN count(DISTINCT scope) = 1 THEN min(scope) ELSE 'consolidated:mixed-scope' END AS scope,
    CASE max(rank) WHEN 0 THEN 'public' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'hyper' ELSE 'low' END AS sensitivity FROM bags JOIN rec USING (id) GROUP BY sig HAVING count(*) >= 2"""


def _skills(spark, d):
    tools = v.node(spark, d).select(F.col("id").alias("record_id"), F.col("node_id").alias("place"), "tool")
    none = spark.createDataFrame([], "skill_name string, skill_id string, salience double")
    episodes = v.rec(spark, d).select(F.col("id").alias("record_id"), F.col("created_at").alias("place"), "scope", "sensitivity")
    return consolidate.skills(tools, episodes, none)[0], tools, episodes


@query("ref_skills", sql("node rec", SKILLS, bags=BAGS))
def skills(spark, d):
    return _skills(spark, d)[0].select("skill_name", "success_count", "scope", "sensitivity")


@query("ref_skill_edges", sql("node rec", f"SELECT {_made('skill-', 'skill_name')} AS source_id, 'derived_from' AS predicate, b.id AS target_id FROM made m JOIN bags b ON m.skill_name = 'skill:' || b.sig JOIN rec r ON r.id = b.id", bags=BAGS, made=SKILLS))
def skill_edges(spark, d):
    """The edges of the skills that consolidation writes to their episodes."""
    new, tools, episodes = _skills(spark, d)
    made = consolidate.skill_records(new, consolidate.skill_sources(tools, episodes), store.entity_terms(v.ent(spark, d)), as_of())
    return made.relations.where(F.col("predicate") == "derived_from").select("source_id", "predicate", "target_id")


def _plans(spark, d):
    nodes = v.node(spark, d).select(F.col("id").alias("record_id"), F.col("node_id").alias("node"), "tool", "deps")
    events = v.line(spark, d).select(F.col("id").alias("record_id"), F.col("pos").alias("place"), "event_kind")
    return *consolidate.plans(nodes, events, v.rec(spark, d).limit(0).select(F.col("id").alias("record_id"))), nodes


BIG = "SELECT id, count(*) AS n FROM node WHERE id IS NOT NULL GROUP BY id HAVING count(*) >= 3"


@query("ref_plans", sql("node line", """SELECT b.id AS record_id, b.n AS n_nodes, coalesce(i.k, 'unknown') AS intent FROM big b LEFT JOIN
    (SELECT id, first(event_kind ORDER BY pos) AS k FROM line WHERE trim(coalesce(event_kind, '')) <> '' GROUP BY id) i USING (id)""", big=BIG))
def plans(spark, d):
    return _plans(spark, d)[0].select("record_id", "n_nodes", "intent")


@query("ref_plan_edges", sql("node", "SELECT n.id AS record_id, unnest(n.deps) AS from_node, n.node_id AS to_node, 'control' AS kind FROM node n JOIN big USING (id)", big=BIG))
def plan_edges(spark, d):
    return _plans(spark, d)[1]


@query("ref_plan_records", sql("node rec", f"SELECT {_made('plan-', 'id')} AS id, r.id AS record_id, scope, sensitivity, n AS n_nodes, (SELECT count(*) FROM (SELECT unnest(deps) FROM node x WHERE x.id = b.id)) AS n_edges FROM big b JOIN rec r USING (id)", big=BIG))
def plan_records(spark, d):
    """The plan records that consolidation writes, read back from their payloads."""
    new, edges, nodes = _plans(spark, d)
    rec = v.rec(spark, d)
    made = consolidate.plan_records(new, edges, nodes, rec, store.entity_terms(v.ent(spark, d)), as_of()).records
    size = lambda k: F.json_array_length(F.get_json_object("payload_json", f"$.{k}")).cast("long")
    return made.select("id", F.col("provenance")[0]["ref"].alias("record_id"), "scope", "sensitivity", size("nodes").alias("n_nodes"), size("edges").alias("n_edges"))


@query("ref_unclaimed", sql("rec", f"SELECT id AS record_id, row_number() OVER (ORDER BY created_at, id) AS place FROM rec WHERE type = 'episodic' AND digit NOT IN (1, 2) ORDER BY created_at, id LIMIT 50"))
def unclaimed(spark, d):
    """The next batch of the extraction queue: done and freshly claimed episodes are out, stale claims are back."""
    rec = v.rec(spark, d).where(F.col("type") == "episodic").withColumnRenamed("id", "record_id")
    at = v.digit("record_id")
    log = rec.where(at < 4).where(at > 0).select("record_id", F.when(at == 1, 2).otherwise(-1).alias("triple_count"), F.expr(f"timestamp '{v.AS_OF}' - make_interval(0,0,0,0, CASE WHEN {('locate(right(record_id, 1), ' + repr(v.DIGITS) + ') - 1')} = 3 THEN 5 ELSE 0 END)").alias("claimed_at"))
    todo, _ = consolidate.claim(rec, log, as_of())
    return todo.select("record_id", F.row_number().over(Window.orderBy("created_at", "record_id")).alias("place"))


@query("ref_triples", sql("fact", "SELECT DISTINCT trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object FROM fact WHERE trim(coalesce(subject,'')) <> '' AND trim(coalesce(predicate,'')) <> '' AND trim(coalesce(object,'')) <> ''"))
def triples(spark, d):
    f = v.fact(spark, d)
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("subject", "predicate", "object"), F.struct("subject", "predicate", "object"))), F.lit("\n```"))
    return consolidate.triples(f.select(F.col("id").alias("record_id"), answer.alias("answer"))).select("subject", "predicate", "object").distinct()


# --- revision


@query("ref_supersede_many", sql("fact", """SELECT f.id, round(CASE WHEN n.new_id IS NULL THEN coalesce(confidence, 0) ELSE 0 END, 6) AS salience, CASE WHEN n.new_id IS NULL THEN status ELSE 'retracted' END AS status, coalesce(n.new_id, superseded_by) AS superseded_by
    FROM fact f LEFT JOIN (SELECT lower(trim(supersedes)) AS old_id, min(id) AS new_id FROM fact WHERE trim(coalesce(supersedes, '')) <> '' GROUP BY 1) n ON n.old_id = f.id""").replace("lower(trim(supersedes))", "lower(trim(supersedes, ' ' || chr(9) || chr(10) || chr(13)))"))
def supersede(spark, d):
    f = v.fact(spark, d).withColumn("salience", F.coalesce("confidence", F.lit(0.0)))
    pairs = f.where(F.nullif(norm("supersedes"), F.lit("")).isNotNull()).select(norm("supersedes").alias("old_id"), F.col("id").alias("new_id"))
    return revise.supersede_many(f, pairs, as_of()).select("id", r6("salience", "salience"), "status", "superseded_by")


@query("ref_exact_fact", sql("fact", "SELECT subject, predicate, object, min(id) AS id FROM fact WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2, 3"))
def exact_fact(spark, d):
    f = v.fact(spark, d)
    asked = f.where(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()).select("subject", "predicate", "object").distinct()
    return store.find_exact(f, asked)


def _revised(spark, d):
    """Facts without an object are retracted, and those that another names as its better one are contested by it."""
    f = v.fact(spark, d)
    rows = store.as_records(f.withColumns({"type": F.lit("semantic"), "salience": F.coalesce("confidence", F.lit(0.0)), "payload_json": F.lit('{"kind":"semantic"}'), "superseded_by": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("string")}))
    change = lambda op, new: F.struct(F.lit(op).alias("op"), F.col("id").alias("old_id"), new.alias("new_id"), F.lit("curator").alias("actor"), F.lit("review").alias("rationale"))
    gone = f.where(F.coalesce(norm("object"), F.lit("")) == "").select(F.inline(F.array(change("retract", F.lit(None).cast("string")))))
    doubted = f.where(v.norm_id("superseded_by").isNotNull()).select(F.inline(F.array(change("contest", v.norm_id("superseded_by")))))
    snap = store.empty(spark).having(records=rows)
    return revise.revise_many(snap, gone.unionByName(doubted), rows.limit(0), as_of())


DOUBTS = f"SELECT id AS old_id, {v._NORM.format('superseded_by')} AS new_id FROM fact WHERE {v._NORM.format('superseded_by')} IS NOT NULL"
BARE = f"coalesce({v._NORM.format('f.object')}, '') = ''"


@query("ref_revise_many", sql("fact", f"""SELECT f.id, round(CASE WHEN {BARE} THEN 0 ELSE coalesce(confidence, 0) END, 6) AS salience, CASE WHEN {BARE} THEN 'retracted' WHEN f.id IN (SELECT old_id FROM doubts WHERE new_id IN (SELECT id FROM fact)) THEN 'contested' ELSE status END AS status FROM fact f WHERE f.id IS NOT NULL""", doubts=DOUBTS))
def revise_many(spark, d):
    return _revised(spark, d)[0].records.select("id", r6("salience", "salience"), "status")


@query("ref_revise_refused", sql("fact", "SELECT 'contest' AS op, old_id, new_id, 'contesting record not found' AS reason FROM doubts WHERE new_id NOT IN (SELECT id FROM fact WHERE id IS NOT NULL)", doubts=DOUBTS))
def revise_refused(spark, d):
    return _revised(spark, d)[1]


# --- metrics and evaluation


@query("ref_metrics", sql("rec", """SELECT count(*) AS total_records, count_if(salience > 0) AS active_records, count_if(pinned) AS pinned_records, round(avg(salience), 6) AS avg_salience, round(avg(confidence), 6) AS avg_confidence,
    round(count_if(created_at > as_of - INTERVAL 24 HOUR) / count(*), 6) AS memory_growth_rate, round(count_if(digit % 7 = 5) / count(*), 6) AS retrieval_usefulness, round(count_if(digit % 7 IN (1, 2, 3)) / count(*), 6) AS revision_rate FROM rec"""))
def metrics_snapshot(spark, d):
    rec = v.rec(spark, d)
    actions = F.array(*[F.lit(x) for x in ("create", "revise", "fork", "merge", "delete", "reinforce", "decay")])
    audit = rec.select(F.element_at(actions, (v.digit() % 7 + 1).cast("int")).alias("action"))
    out = metrics.collect(rec, audit, as_of())
    rates = ["avg_salience", "avg_confidence", "memory_growth_rate", "retrieval_usefulness", "revision_rate"]
    return out.select("total_records", "active_records", "pinned_records", *[r6(c, c) for c in rates])


@query("ref_histogram", sql("rec", """SELECT b.bucket, count(rec.id) AS records FROM (VALUES ('0.0-0.2', -1.0, 0.2), ('0.2-0.4', 0.2, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.8', 0.6, 0.8), ('0.8-1.0', 0.8, 1e9)) b(bucket, lo, hi)
    LEFT JOIN rec ON salience >= lo AND salience < hi GROUP BY 1"""))
def histogram(spark, d):
    return metrics.histogram(v.rec(spark, d))


def _recall(spark, d):
    """Queries and records of the evaluation set, and a ranking by the numbers that both name."""
    rows = table(spark, d, "recall_dataset").dropDuplicates(["type", "key"])
    asked = rows.where("type = 'query'").select(F.col("key").alias("query_id"), F.when(F.coalesce("k", F.lit(0)) > 0, F.col("k")).otherwise(5).alias("k"), "text", "expected")
    nums = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1)))
    a = asked.select("query_id", F.explode(nums("text")).alias("w"))
    b = rows.where("type = 'record'").select(F.col("key").alias("id"), F.explode(nums("text")).alias("w"))
    hits = a.join(b, "w").groupBy("query_id", "id").agg(F.count("*").alias("n"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "id")))
    return asked, asked.select("query_id", F.explode("expected").alias("id")), ranked


@query("ref_recall_at_k", sql("", """SELECT q.query_id, round(CASE WHEN n = 0 THEN 1.0 ELSE hit / n END, 6) AS recall, round(hit / q.k, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr, round(CASE WHEN n = 0 THEN 1.0 ELSE dcg / ideal END, 6) AS ndcg
    FROM (SELECT q.query_id, q.k, (SELECT count(*) FROM want w WHERE w.query_id = q.query_id) AS n, coalesce(h.hit, 0) AS hit, h.first, coalesce(h.dcg, 0) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + greatest(1, least(q.k, (SELECT count(*) FROM want w WHERE w.query_id = q.query_id)))) r(i)) AS ideal
    FROM asked q LEFT JOIN (SELECT query_id, count(*) AS hit, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN want USING (query_id, id) JOIN asked USING (query_id) WHERE rank <= k GROUP BY 1) h USING (query_id)) q""",
    rows_="SELECT DISTINCT ON (type, key) * FROM recall_dataset", asked="SELECT key AS query_id, CASE WHEN coalesce(k, 0) > 0 THEN k ELSE 5 END AS k, text, expected FROM rows_ WHERE type = 'query'",
    want="SELECT DISTINCT query_id, id FROM (SELECT query_id, unnest(expected) AS id FROM asked)",
    a="SELECT DISTINCT query_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS w FROM asked", b="SELECT DISTINCT key AS id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS w FROM rows_ WHERE type = 'record'",
    ranked="SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id) AS rank FROM a JOIN b USING (w) GROUP BY query_id, id"))
def recall_at_k(spark, d):
    asked, want, ranked = _recall(spark, d)
    return evalkit.at_k(ranked, want, asked).select("query_id", *[r6(c, c) for c in ("recall", "precision", "mrr", "ndcg")])


# --- capture


@query("ref_policy", """SELECT kind AS source_kind, t AS type, CASE kind WHEN 'event' THEN 0.8 WHEN 'tool_output' THEN 0.9 WHEN 'observation' THEN 0.7 WHEN 'outcome' THEN 0.85 WHEN 'working_state' THEN 1.0 ELSE 0.5 END::DOUBLE AS policy_confidence,
    CASE t WHEN 'episodic' THEN 3600 WHEN 'working' THEN 86400 ELSE 2592000 END AS half_life_seconds, count(*) AS n FROM (SELECT kind, CASE kind WHEN 'observation' THEN 'semantic' WHEN 'working_state' THEN 'working' ELSE 'episodic' END AS t FROM
    (SELECT CASE memory_type WHEN 'episodic' THEN 'event' WHEN 'semantic' THEN 'observation' WHEN 'working' THEN 'working_state' WHEN 'competence' THEN 'tool_output' ELSE 'other' END AS kind FROM documents)) GROUP BY 1, 2, 3, 4""")
def policy(spark, d):
    kind = F.coalesce(ex.pick(F.col("memory_type"), {"episodic": "event", "semantic": "observation", "working": "working_state", "competence": "tool_output"}), F.lit("other"))
    rows = capture.policy(table(spark, d, "documents").select(kind.alias("source_kind"), F.lit(None).cast("string").alias("sensitivity")))
    return rows.groupBy("source_kind", "type", "policy_confidence", "half_life_seconds").agg(F.count("*").alias("n"))


@query("ref_resolve_mentions", sql("ent mention rec", """SELECT m.mention_id, coalesce(e.entity_id, (SELECT t.entity_id FROM terms t WHERE t.term = lower(trim(m.surface)) AND (t.scope = coalesce(r.scope, '') OR t.scope = '') ORDER BY t.scope <> coalesce(r.scope, ''), t.entity_id LIMIT 1)) AS entity_id
    FROM mention m LEFT JOIN rec r ON r.id = m.id LEFT JOIN ent e ON e.entity_id = m.entity_id WHERE e.entity_id IS NOT NULL OR lower(trim(coalesce(m.surface, ''))) <> ''""", terms=TERMS))
def resolve_mentions(spark, d):
    m = v.mention(spark, d).join(v.rec(spark, d).select("id", "scope"), "id", "left").select("mention_id", F.col("id").alias("record_id"), "scope", "surface", "entity_kind", F.col("entity_id").alias("canonical_entity_id"), "confidence")
    e = v.ent(spark, d)
    resolved, _ = capture.resolve_mentions(m, e, store.entity_terms(e))
    return resolved.select("mention_id", F.when(~F.col("is_new"), F.col("entity_id")).alias("entity_id"))


INVERSE = "CASE predicate " + " ".join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for a, b in ex.INVERSES.items()) + " ELSE 'inverse_of_' || predicate END"
PAIRS = f"SELECT source_id, predicate, target_id, round(max(weight), 6) AS weight FROM (SELECT source_id, predicate, target_id, weight FROM l UNION ALL SELECT target_id, {INVERSE}, source_id, weight FROM l) GROUP BY 1, 2, 3"
WEIGHT = "CASE WHEN coalesce({0}, 0) = 0 THEN 1.0 ELSE least(greatest({0}, 0), 1) END"


@query("ref_edge_pairs", sql("mention", PAIRS, l=f"SELECT id AS source_id, 'mentions_entity' AS predicate, entity_id AS target_id, {WEIGHT.format('confidence')} AS weight FROM mention WHERE id IS NOT NULL AND entity_id IS NOT NULL AND id <> entity_id"))
def edge_pairs(spark, d):
    m = v.mention(spark, d).select(F.col("id").alias("source_id"), F.lit(" Mentions_Entity").alias("predicate"), F.col("entity_id").alias("target_id"), "confidence")
    return capture.edge_pairs(m.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()), as_of()).select("source_id", "predicate", "target_id", r6("weight", "weight"))


def _relations(spark, d):
    nodes = flatten.flatten(table(spark, d, "interpretations"), "record_id", "interpretation_json", "interpreted_at", INTERPRETATION_ARRAYS, tables=("relation_candidates[]",))
    get = lambda k: F.get_json_object("fields", f"$.{k}")
    asked = nodes.select(v.norm_id("record_id").alias("source_id"), get("predicate").alias("predicate"), v.norm_id(get("target_record_id")).alias("target_record_id"), v.norm_id(get("target_entity_id")).alias("target_entity_id"), get("confidence").try_cast("double").alias("confidence"))
    return capture.resolve_relations(asked, v.everything(spark, d).select("id"))


ASKED = f"""SELECT id AS source_id, lower(trim(json_extract_string(o, '$.predicate'))) AS predicate, {v._NORM.format("json_extract_string(o, '$.target_record_id')")} AS r, {v._NORM.format("json_extract_string(o, '$.target_entity_id')")} AS e,
    TRY_CAST(json_extract_string(o, '$.confidence') AS DOUBLE) AS confidence FROM (SELECT id, unnest({items_sql('relation_candidates')}) AS o FROM ({JSON_OF.format(key=v._NORM.format('record_id'), at='interpreted_at', col='interpretation_json', table='interpretations')})) WHERE json_type(o) = 'OBJECT'"""
RELATED = "SELECT *, coalesce(CASE WHEN r IN (SELECT id FROM nodes) THEN r END, CASE WHEN e IN (SELECT id FROM nodes) THEN e END) AS target_id FROM asked"


@query("ref_relation_edges", sql("rec ent", PAIRS, nodes=NODES, asked=ASKED, related=RELATED, l=f"SELECT source_id, predicate, target_id, {WEIGHT.format('confidence')} AS weight FROM related WHERE target_id IS NOT NULL AND target_id <> source_id AND coalesce(predicate, '') <> ''"))
def relation_edges(spark, d):
    """The edges that the relation candidates of all interpretations make."""
    return capture.edge_pairs(_relations(spark, d).where("resolved"), as_of()).select("source_id", "predicate", "target_id", r6("weight", "weight"))


# --- ingestion: the tables' rows as requests


def _requests(spark, d):
    line = v.line(spark, d).where(F.col("id").isNotNull()).select(F.concat_ws("/", F.lit("event"), "id", "pos").alias("request_id"), F.lit("event").alias("kind"), F.col("t").alias("timestamp"), "scope", "event_kind", "ref", "summary")
    node = v.node(spark, d).where(F.col("id").isNotNull()).select(F.concat_ws("/", F.lit("tool"), "id", "node_id").alias("request_id"), F.lit("tool_output").alias("kind"), F.col("called_at").alias("timestamp"), F.col("tool").alias("tool_name"), F.col("deps").alias("depends_on"))
    fact = v.fact(spark, d).where(F.col("id").isNotNull()).select(F.concat_ws("/", F.lit("fact"), "id").alias("request_id"), F.lit("observation").alias("kind"), "subject", "predicate", ingest.text_json(F.col("object")).alias("object"))
    said = v.mention(spark, d).join(v.rec(spark, d).select("id", "scope"), "id", "left").select(
        F.concat_ws("/", F.lit("mention"), "mention_id").alias("request_id"), F.lit("observation").alias("kind"), "scope", F.col("surface").alias("subject"), F.lit("is_a").alias("predicate"), ingest.text_json(F.col("entity_kind")).alias("object")
    )
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [line, node, fact, said]).withColumn("source", F.lit("loader"))
    return ingest.ingest(all_, store.as_records(v.rec(spark, d)), store.entity_terms(v.ent(spark, d)), as_of())


BLANK = "coalesce({0}, '') = ''"
REQUESTS = f"""SELECT concat_ws('/', 'event', id, pos) AS request_id, 'event' AS kind, event_kind AS a, ref AS b, CAST(NULL AS VARCHAR) AS object, '' AS scope, CASE WHEN {BLANK.format('event_kind')} THEN 'event_kind is required' WHEN {BLANK.format('ref')} THEN 'ref is required' END AS reason FROM line WHERE id IS NOT NULL
    UNION ALL SELECT concat_ws('/', 'tool', id, node_id), 'tool_output', tool, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), '', CASE WHEN {BLANK.format('tool')} THEN 'tool_name is required' END FROM node WHERE id IS NOT NULL
    UNION ALL SELECT concat_ws('/', 'fact', id), 'observation', subject, predicate, object, '', CASE WHEN {BLANK.format('subject')} THEN 'subject is required' WHEN {BLANK.format('predicate')} THEN 'predicate is required' END FROM fact WHERE id IS NOT NULL
    UNION ALL SELECT concat_ws('/', 'mention', mention_id), 'observation', surface, 'is_a', entity_kind, coalesce(r.scope, ''), CASE WHEN {BLANK.format('surface')} THEN 'subject is required' END FROM mention m LEFT JOIN rec r ON r.id = m.id"""
SIDES = f"SELECT 'rec-' || substr(sha256(request_id), 1, 32) AS id, a AS subject, {_entity_of('a', 'q.scope')} AS s, {_entity_of('object', 'q.scope')} AS o, object FROM req q WHERE kind = 'observation' AND reason IS NULL"


@query("ref_policy_errors", sql("line node mention rec fact", "SELECT reason, count(*) AS n FROM req WHERE reason IS NOT NULL GROUP BY 1", req=REQUESTS))
def policy_errors(spark, d):
    return _requests(spark, d).refused.groupBy("reason").agg(F.count("*").alias("n"))


@query("ref_ingest_records", sql("line node mention rec fact ent", """SELECT 'rec-' || substr(sha256(request_id), 1, 32) AS id, CASE kind WHEN 'observation' THEN 'semantic' ELSE 'episodic' END AS type, CASE kind WHEN 'event' THEN 0.8 WHEN 'tool_output' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence,
    CASE kind WHEN 'observation' THEN 2592000 ELSE 3600 END AS half_life_seconds, CASE kind WHEN 'event' THEN a WHEN 'tool_output' THEN 'tool_call' ELSE coalesce(s, a) END AS what, CASE kind WHEN 'observation' THEN coalesce(o, x.object) WHEN 'tool_output' THEN a END AS more,
    CASE kind WHEN 'event' THEN 'event' WHEN 'tool_output' THEN 'tool_call' ELSE 'observation' END AS source_kind FROM req LEFT JOIN sides x ON x.id = 'rec-' || substr(sha256(request_id), 1, 32) WHERE reason IS NULL""", terms=TERMS, req=REQUESTS, sides=SIDES))  # fmt: skip
def ingest_records(spark, d):
    """The records made of all timeline events, tool calls and facts, read back from their payloads."""
    get = lambda k: F.get_json_object("payload_json", f"$.{k}")
    fact = F.col("type") == "semantic"
    return _requests(spark, d).records.select(
        "id", "type", "confidence", "half_life_seconds", F.when(fact, get("subject")).otherwise(get("timeline[0].event_kind")).alias("what"), F.when(fact, get("object")).otherwise(get("tool_graph[0].tool")).alias("more"),
        F.col("provenance")[0]["kind"].alias("source_kind"),
    )


@query("ref_ingest_edges", sql("line node mention rec fact ent", """SELECT id AS source_id, 'subject_entity' AS predicate, s AS target_id FROM sides WHERE s IS NOT NULL UNION ALL SELECT s, 'fact_subject_of', id FROM sides WHERE s IS NOT NULL
    UNION ALL SELECT id, 'object_entity', o FROM sides WHERE o IS NOT NULL UNION ALL SELECT o, 'fact_object_of', id FROM sides WHERE o IS NOT NULL""", terms=TERMS, req=REQUESTS, sides=SIDES))
def ingest_edges(spark, d):
    return _requests(spark, d).relations.select("source_id", "predicate", "target_id")


@query("ref_outcomes", sql("rec", "SELECT id, 'outcome:' || id || ':' || CASE WHEN digit % 2 = 0 THEN 'success' ELSE 'failure' END AS ref, CASE WHEN digit % 2 = 0 THEN 'success' ELSE 'failure' END AS outcome FROM rec WHERE type = 'episodic'"))
def outcomes(spark, d):
    """An outcome for every record; those that are no episodes refuse it."""
    rec = store.as_records(v.rec(spark, d).withColumns({"payload_json": F.concat(F.lit('{"kind":"'), "type", F.lit('"}'))}))
    said = rec.select(F.col("id").alias("request_id"), F.lit("outcome").alias("kind"), F.lit("loader").alias("source"), F.col("id").alias("target_record_id"), F.when(v.digit() % 2 == 0, "success").otherwise("failure").alias("outcome"))
    changed = ingest.ingest(said, rec, store.entity_terms(v.ent(spark, d)), as_of()).changed
    return changed.select("id", F.col("provenance")[0]["ref"].alias("ref"), F.get_json_object("payload_json", "$.outcome").alias("outcome"))


@query("ref_trigger_text", """SELECT key AS id, CASE memory_type WHEN 'episodic' THEN CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE coalesce(event_kind, '') || ' ' || coalesce(ref, '') END
    WHEN 'working' THEN concat_ws(' ', nullif(state, ''), CASE WHEN len(next_actions) > 0 THEN array_to_string(next_actions, ' ') END)
    WHEN 'semantic' THEN trim(coalesce(subject, '') || ' ' || coalesce(predicate, '') || ' ' || coalesce(object, '')) WHEN 'competence' THEN trim(coalesce(skill_name, '') || ' ' || coalesce(array_to_string([t FOR t IN triggers IF coalesce(t, '') <> ''], ' '), ''))
    WHEN 'plan_graph' THEN coalesce(nullif(intent, ''), array_to_string([n.op FOR n IN nodes IF coalesce(n.op, '') <> ''], ' '), '') ELSE '' END AS text FROM (SELECT DISTINCT ON (key) * FROM recall_dataset WHERE type = 'record')""")
def trigger_text(spark, d):
    """The text each record is embedded by."""
    rows = table(spark, d, "recall_dataset").where("type = 'record'").dropDuplicates(["key"])
    return rows.select(F.col("key").alias("id"), texts.trigger_text(rows).alias("text"))


OPEN = "len(list_filter(coalesce({0}, []), lambda x: json_type(x) = 'OBJECT' AND trim(coalesce(json_extract_string(x, '$.{1}'), '')) <> '' AND {2})) > 0"
UNDONE = "coalesce(json_extract_string(x, '$.resolved'), 'false') <> 'true'"
STATUS = f"""SELECT i.id, CASE WHEN j.id IS NULL OR {OPEN.format(items_sql('mentions'), 'surface', "coalesce(json_extract_string(x, '$.canonical_entity_id'), '') = ''")} OR {OPEN.format(items_sql('reference_candidates'), 'ref', UNDONE)}
    OR {OPEN.format(items_sql('relation_candidates'), 'predicate', UNDONE)} THEN 'tentative' ELSE 'resolved' END AS status FROM (SELECT DISTINCT {v._NORM.format('record_id')} AS id FROM interpretations) i
    LEFT JOIN ({JSON_OF.format(key=v._NORM.format('record_id'), at='interpreted_at', col='interpretation_json', table='interpretations')}) j USING (id) WHERE i.id IS NOT NULL"""


@query("ref_interpretation_status", f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY 1")
def interpretation_status(spark, d):
    """The interpretations by the status that their open parts give them."""
    i = F.from_json(flatten.record_texts(F.col("interpretation_json"), INTERPRETATION_ARRAYS), texts.INTERPRETATION)
    rows = v.newest(table(spark, d, "interpretations"), v.norm_id("record_id"), ["interpreted_at"], ["interpretation_json"], "id").withColumn("i", i)
    return rows.groupBy(texts.final_status(F.col("i")).alias("status")).agg(F.count("*").alias("n"))


@query("ref_capture_candidates", sql("rec", """SELECT request_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, created_at DESC, id) AS rank FROM (
    SELECT request_id, id, created_at, CASE WHEN q_scope <> '' AND q_scope = scope THEN 100 ELSE 0 END + CASE WHEN type = 'semantic' THEN 10 ELSE 0 END + 8 * len(list_distinct(list_intersect(list_transform(coalesce(q_tags, []), lambda x: lower(trim(x))), list_transform(tags, lambda x: lower(trim(x))))))
      + 25 * CASE WHEN scope <> '' AND coalesce(subject, '') <> '' AND (contains(lower(trim(scope)), lower(trim(subject))) OR list_contains(string_split_regex(lower(trim(subject)), '\\s+'), lower(trim(scope)))) THEN 1 ELSE 0 END
      + 1 / (1 + greatest((epoch_us(as_of) - epoch_us(created_at)) / 1e6, 0) / 86400) AS score FROM seen)) WHERE rank <= 20""",
    r="SELECT key AS request_id, coalesce(scope, '') AS q_scope, tags AS q_tags, subject FROM (SELECT DISTINCT ON (key) * FROM recall_dataset WHERE type = 'query' ORDER BY key)",
    own="SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY scope ORDER BY salience DESC, created_at DESC, id) <= 80", every="SELECT * FROM rec ORDER BY salience DESC, created_at DESC, id LIMIT 80",
    seen="SELECT r.*, own.* FROM r JOIN own ON q_scope <> '' AND scope = q_scope UNION SELECT r.*, every.* FROM r, every"))
def capture_candidates(spark, d):
    """For each query of the evaluation set, the existing records it may refer to, best first."""
    asked = table(spark, d, "recall_dataset").where("type = 'query'").dropDuplicates(["key"])
    requests = asked.select(F.col("key").alias("request_id"), "scope", F.lit("semantic").alias("type"), "tags", F.array("subject").alias("terms"))
    rec = v.rec(spark, d).select("id", "type", "scope", "tags", F.array("scope").alias("terms"), "salience", "created_at")
    return capture.score_candidates(requests, rec, as_of()).select("request_id", "id", r6("score", "score"), "rank")
