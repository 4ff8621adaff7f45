"""The store's operators on the fixtures of the model: expected values, nulls, ties, repeated rows and empty tables."""

import datetime as dt
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from engram.functions import exprs as ex
from engram.functions.text import norm, norm_id
from engram.operators import capture, consolidate, evalkit, graph, ingest, lifecycle, metrics, retrieve, revise, store, texts, trust
from engram.sources import io
from engram.streaming import jobs

NOW = dt.datetime(2026, 2, 5, 12, tzinfo=dt.timezone.utc)
AS_OF = None  # a column, once there is a session
EXTRA = ", success_count int, failure_count int, failure_rate double, has_payload boolean"


@pytest.fixture(autouse=True, scope="module")
def as_of(spark):
    global AS_OF
    AS_OF = F.lit("2026-02-05 12:00:00").cast("timestamp")


def ago(**kw):
    return NOW - dt.timedelta(**kw)


def record(id, **kw):
    base = dict(
        id=id, type="semantic", sensitivity="low", confidence=0.9, salience=0.8, scope="", tags=[], created_at=ago(hours=2), updated_at=ago(hours=2), last_reinforced_at=ago(hours=1),
        half_life_seconds=3600, min_salience=0.1, max_age_seconds=0, reinforcement_gain=0.3, pinned=False, deletion_policy="auto_prune", payload_json='{"kind":"semantic","evidence":[{"source_id":"e"}]}',
        status="active", success_count=None, failure_count=None, failure_rate=None, has_payload=True,
    )
    return {**base, **kw}


def records(spark, *rows, extra=False):
    df = spark.createDataFrame(list(rows), store.RECORDS + EXTRA)
    return df if extra else df.drop("success_count", "failure_count", "failure_rate", "has_payload")


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def snapshot(spark, *rows):
    e = store.empty(spark)
    return e.having(records=records(spark, *rows))


# --- scalars


def test_text_rules(spark):
    assert value(spark, norm(F.lit("　 A\tb "))) == "a\tb" and value(spark, norm_id(F.lit(" \n"))) is None
    assert value(spark, ex.lexical_match(F.lit(" Orchid "), F.lit("the orchid deploy"))) and not value(spark, ex.lexical_match(F.lit(""), F.lit("x"))) and value(spark, ex.lexical_match(F.lit(None).cast("string"), F.lit("x"))) is False
    assert value(spark, ex.unique_folded(F.array(*[F.lit(x).cast("string") for x in (" A", "a", None, "", "B", "b ")]))) == ["A", "B"]
    assert value(spark, ex.first_text(F.lit(None).cast("string"), F.lit(" "), F.lit(" x"))) == " x"
    assert value(spark, ex.term_match(F.lit("deploy"), F.lit("the deploy target"))) and value(spark, ex.without_fences(F.lit("```json\n[1]\n```"))) == "[1]"
    assert value(spark, ex.inverse_predicate(F.lit("used_by"))) == "uses" and value(spark, ex.inverse_predicate(F.lit("zzz"))) == "inverse_of_zzz"
    assert [value(spark, ex.relation_boost(F.lit(p))) for p in ("mentioned_in", "fact_subject_of", "depends_on", "other")] == [20, 25, 10, 0]


@pytest.mark.parametrize(
    "kw,want",
    [
        (dict(salience=0.8, min_salience=0.2), 0.4), (dict(salience=0.3, min_salience=0.2, last_reinforced_at=ago(hours=10)), 0.2), (dict(salience=0.1, min_salience=0.2, half_life_seconds=0), 0.2),
        (dict(last_reinforced_at=NOW + dt.timedelta(hours=1)), 0.8), (dict(max_age_seconds=1, min_salience=0.0), 0.0), (dict(salience=float("nan")), 0.1), (dict(salience=-1.0), 0.0), (dict(salience=0.0, min_salience=0.3), 0.0),
    ],
)
def test_decay(spark, kw, want):
    row = records(spark, record("r", **kw)).select(lifecycle.decayed_salience(AS_OF).alias("s")).first()
    assert row["s"] == pytest.approx(want)


def test_vector_rules(spark):
    cos = lambda a, b: value(spark, ex.cosine01(F.array(*[F.lit(x) for x in a]), F.array(*[F.lit(x) for x in b])))
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1 and cos([1.0, 0.0], [-1.0, 0.0]) == 0 and cos([0.0, 0.0], [1.0, 0.0]) == 0.5 and cos([1.0], [1.0, 2.0]) is None
    assert value(spark, ex.recency(F.lit(None).cast("timestamp"), AS_OF)) == 0.5 and value(spark, ex.recency(AS_OF - F.expr("interval 60 days"), AS_OF)) == pytest.approx(0.25)
    assert value(spark, io.parse_vector(io.vector_text(F.array(F.lit(1.5), F.lit(-2.0))))) == [1.5, -2.0]


def test_untyped_values(spark):
    from engram.functions import values as va

    j = lambda fn, x: value(spark, fn(F.lit(x).cast("string")))
    assert j(va.as_object, '{"a":1,"b":{"c":"x"},"d":null}') == {"a": "1", "b": '{"c":"x"}', "d": None} and j(va.as_object, "[1]") == j(va.as_object, None) == {}
    assert j(va.string_list, '[" a","A",1,null,""]') == ["a", "1"] and j(va.string_list, '"a"') == [] and j(va.string_list, None) == []
    assert [j(va.bool_value, x) for x in ("true", '"true"', "1", None)] == [True, False, False, False]
    got = j(va.constraint_list, '[{"type":" t ","key":"k","value":{"x":1},"required":true},"x",{"required":"true"}]')
    assert [tuple(c) for c in got] == [("t", "k", '{"x":1}', True), ("", "", None, False)] and j(va.constraint_list, "{}") is None
    assert [j(va.plain_text, x) for x in ('"a\\"b"', '{"x":1}', "null", None, "5")] == ['a"b', '{"x":1}', "", "", "5"]
    assert j(va.answer_text, '[{"type":"text","text":"a"},{"type":"x"},{"text":"b"}]') == "ab" and j(va.answer_text, '"c"') == "c"
    assert value(spark, va.format_time(va.parse_time(F.lit("2026-02-05T13:00:00.5+01:00")))) == "2026-02-05T12:00:00.500000Z" and [j(va.parse_time, x) for x in ("", "yesterday", None, "2026-13-01T00:00:00Z")] == [None] * 4 and value(spark, va.format_time(F.lit(None).cast("timestamp"))) == ""
    ms = F.from_json(F.lit('[{"surface":" A"},{"surface":"a"},{"surface":""},{"surface":"b"},{}]'), "array<struct<surface:string>>")
    assert [m["surface"] for m in value(spark, va.unique_mentions(ms))] == [" A", "b"] and value(spark, va.entity_types(F.lit("Tool"), F.array(F.lit("tool"), F.lit(" x "), F.lit("")))) == ["Tool", "x"]
    none = F.array().cast("array<string>")
    d = value(spark, va.derived_interpretation(F.lit(None).cast("string"), none, F.lit(0.0), F.array(F.lit("e1"), F.lit(None))))
    assert (d["status"], d["extraction_confidence"], [m["canonical_entity_id"] for m in d["mentions"]]) == ("resolved", 0.7, ["e1"]) and value(spark, va.derived_interpretation(F.lit(""), none, F.lit(0.5), none)) is None
    df = spark.createDataFrame([(1, 0.0, "exponential"), (0, 0.0, "exponential"), (1, -1.0, "exponential"), (1, 0.0, "odd"), (None, None, None)], "half_life_seconds long, min_salience double, curve string")
    assert [r[0] and r[0].split()[0] for r in df.select(va.storage_violation({c: F.col(c) for c in df.columns})).collect()] == [None, "half-life", "minimal", "curve", "curve"]
    assert [value(spark, va.edge_violation(F.lit(x).cast("double"))) is None for x in (0, 1, None, 1.1, -0.1)] == [True, True, True, False, False]


def test_payload_variants(spark):
    from engram.functions import values as va

    texts_ = ['{"kind":"entity","canonical_name":"Orchid","aliases":["a",{"value":"b","kind":"x"},{"value":" "}]}', '{"kind":"semantic","object":{"x":1},"revision":{"status":"active"}}', '{"kind":"zzz"}', "{", None]
    rows = spark.createDataFrame([(t,) for t in texts_], "p string").select(*va.payloads(F.col("p"))).collect()
    assert rows[0]["p_entity"]["aliases"] == ["a", "b"] and rows[0]["p_semantic"] is None and rows[1]["p_semantic"]["object"] == '{"x":1}' and rows[1]["p_semantic"]["revision"]["status"] == "active"
    assert all(all(x is None for x in r) for r in rows[2:]) and set(va.VARIANTS) == set(ex.TYPES)


# --- lifecycle


def test_lifecycle_scenarios(spark):
    """Retraction, reinforcement, supersession and decay as a caller sees them."""
    e = store.empty(spark)
    snap = e.having(records=records(spark, record("fact"), record("other", salience=0.5), record("skill", type="competence", salience=0.4), extra=True))
    seen = lambda s: [r["id"] for r in retrieve.retrieve(s.records, trust.Trust("low"), AS_OF, min_salience=0.01, types=("semantic",)).collect()]
    assert seen(snap) == ["fact", "other"] and seen(revise.retract(snap, "fact", "me", "wrong", AS_OF)) == ["other"]
    new = revise.supersede(snap, "fact", records(spark, record("fact2", salience=0.9), extra=True), "me", "newer", AS_OF)
    assert seen(new) == ["fact2", "other"]
    up = snap.having(records=lifecycle.reinforce(snap.records, spark.createDataFrame([("other",)], "id string"), AS_OF))
    assert up.records.where("id = 'other'").first()["salience"] == pytest.approx(0.8)
    later = F.lit("2026-02-05 13:00:00").cast("timestamp")
    assert {r["id"]: round(r["salience"], 3) for r in lifecycle.decay_and_prune(up, later).records.collect()} == {"fact": 0.2, "other": 0.4, "skill": 0.1}


def test_reinforce_penalize_prune(spark):
    df = records(spark, record("a", salience=0.95), record("b", salience=0.8), record("c", salience=1.5))
    ids = spark.createDataFrame([("a",), ("a",), ("c",), ("none",)], "id string")
    assert {r["id"]: r["salience"] for r in lifecycle.reinforce(df, ids, AS_OF).collect()} == {"a": 1.0, "b": 0.8, "c": 1.0}
    out = {r["id"]: r["salience"] for r in lifecycle.penalize(df, spark.createDataFrame([("a", 100.0), ("b", 0.25)], "id string, amount double"), AS_OF).collect()}
    assert out == {"a": 0.1, "b": pytest.approx(0.55), "c": 1.5}
    for bad in (float("nan"), float("inf"), -1.0, None):
        with pytest.raises(store.Invalid):
            lifecycle.penalize(df, spark.createDataFrame([("a", bad)], "id string, amount double"), AS_OF)
    zero = dict(salience=0.0, min_salience=0.0)
    snap = snapshot(spark, record("gone", **zero), record("pin", **zero, pinned=True), record("man", **zero, deletion_policy="manual_only"), record("floor", salience=0.1))
    left, tomb = lifecycle.prune(snap, AS_OF)
    assert {r["id"] for r in left.records.collect()} == {"pin", "man", "floor"} and [r["record_id"] for r in tomb.collect()] == ["gone"]
    noted = lifecycle.penalized(lifecycle.reinforced(snap, spark.createDataFrame([("pin",), ("zz",)], "id string"), "me", "used", AS_OF), spark.createDataFrame([("floor", 0.01)], "id string, amount double"), "me", "wrong", AS_OF)
    assert {(r["record_id"], r["action"], r["rationale"]) for r in noted.audit.collect()} == {("pin", "reinforce", "used"), ("floor", "decay", "penalty: wrong")}
    after = lifecycle.decay_and_prune(snap, AS_OF)
    assert "decay applied: 0.1000 -> 0.1000 (elapsed 3600s)" in {r["rationale"] for r in after.audit.collect()}
    assert lifecycle.sweep(snap.records.limit(0), AS_OF).collect() == []


# --- trust and retrieval


def test_trust(spark):
    df = records(spark, record("lowAlpha", scope="project:alpha"), record("highAlpha", scope="project:alpha", sensitivity="high"), record("midAlpha", scope="project:alpha", sensitivity="medium"), record("midBeta", scope="b", sensitivity="medium"), record("odd", sensitivity="secret"), record("none", scope=None))
    seen = lambda t: {r["id"]: r for r in trust.visible(df, t).collect()}
    low = seen(trust.Trust("low", ("project:alpha",)))
    assert set(low) == {"lowAlpha", "midAlpha", "none"} and low["midAlpha"]["redacted"] and low["midAlpha"]["payload_json"] is None and low["midAlpha"]["half_life_seconds"] == 0
    assert set(seen(trust.Trust("high", ("project:alpha",)))) == {"lowAlpha", "highAlpha", "midAlpha", "none"} and seen(trust.Trust("odd")) == {} and len(seen(None)) == 6
    assert retrieve.by_id(df, "lowAlpha", trust.Trust("low")).count() == 1
    with pytest.raises(store.Denied):
        retrieve.by_id(df, "midAlpha", trust.Trust("low", ("project:alpha",)))
    with pytest.raises(store.NotFound):
        retrieve.by_id(df, "zzz", trust.Trust("low"))
    assert trust.up_to(df, "low").count() == 2 and trust.up_to(df, "zzz").count() == 0


def test_ranked_recall(spark):
    s = {"A": 1.0, "B": 0.9, "C": 0.95, "D": 0.85, "E": 0.2, "F": 0.05}
    scope = {"A": "project:alpha", "B": "project:alpha", "C": "project:alpha", "D": "project:beta", "E": "", "F": "project:alpha"}
    df = records(spark, *[record(k, salience=v, scope=scope[k], sensitivity="high" if k == "C" else "low") for k, v in s.items()], extra=True)
    got = lambda *a, **kw: [r["id"] for r in retrieve.retrieve(df, trust.Trust(*a), AS_OF, **kw).collect()]
    assert got("low", ("project:alpha",), min_salience=0.2, limit=2) == ["A", "B"] and got("high", ("project:alpha",), limit=3) == ["A", "C", "B"] and got("low", min_salience=0.8, limit=3) == ["A", "B", "D"]
    assert len(got("low", types=("semantic", "semantic"))) == 10 and got("low", types=("nothing",)) == []


def test_selection_and_bands(spark):
    rows = [
        record("cand-a", type="competence", confidence=0.95, success_count=90, failure_count=10, last_reinforced_at=ago(hours=1)),
        record("cand-b", type="competence", confidence=0.7, success_count=50, failure_count=50, last_reinforced_at=ago(days=15)),
        record("cand-c", type="competence", confidence=0.4, success_count=20, failure_count=80, last_reinforced_at=ago(days=60)),
        record("nil", type="plan_graph", has_payload=False), record("fact", salience=0.99),
    ]
    df = records(spark, *rows, extra=True)
    picks = retrieve.select(df.where("type <> 'semantic'"), AS_OF)
    order = [r["id"] for r in picks.orderBy(F.desc("selection_score")).collect()]
    assert order.index("cand-a") < order.index("cand-b") < order.index("cand-c") and {r["id"]: r["selection_score"] for r in picks.collect()}["nil"] == 0.5
    one = lambda f: retrieve.selection_confidence(picks.where(f)).first()
    assert one("false")["confidence"] == 0 and one("false")["needs_more"] and one("id = 'cand-a'")["confidence"] <= 1 and 0 < one("id like 'cand%'")["confidence"] < 1
    assert [r["id"] for r in retrieve.retrieve(df, None, AS_OF, query="deploy").collect()][-1] == "fact" and [r["id"] for r in retrieve.retrieve(df, None, AS_OF).collect()][0] == "fact"
    emb = spark.createDataFrame([("fact", [1.0, 0.0], "m", NOW), ("other", [0.9, 0.1], "m", NOW)], store.EMBEDDINGS)
    out = retrieve.retrieve(df, None, AS_OF, embeddings=emb, vector=[1.0, 0.0]).collect()
    assert [r["band"] for r in out] == [0, 0, 0, 0, 1] and out[-1]["vector_score"] == 1.0 and out[-1]["hybrid_score"] == pytest.approx(0.7 + 0.3 * 0.99)
    near = spark.createDataFrame([("cand-c", [1.0, 0.1], "m", NOW), ("cand-a", [-1.0, 0.0], "m", NOW)], store.EMBEDDINGS)
    order = [r["id"] for r in retrieve.retrieve(df.where("id in ('cand-a', 'cand-c')"), None, AS_OF, embeddings=near, vector=[1.0, 0.0]).collect()]
    far = df.where("id in ('cand-a', 'cand-c')").withColumns({"success_count": F.lit(0), "failure_count": F.lit(0), "last_reinforced_at": AS_OF})
    assert order == ["cand-a", "cand-c"] and [r["id"] for r in retrieve.retrieve(far, None, AS_OF, embeddings=near, vector=[1.0, 0.0]).collect()] == ["cand-c", "cand-a"]  # the near one, of less confidence
    plain = retrieve.retrieve(df, None, AS_OF, embeddings=emb.limit(0), vector=[1.0, 0.0]).collect()
    assert plain[0]["id"] == "fact"


# --- graph


EDGE = "source_id string, predicate string, target_id string, weight double, created_at timestamp, seq long"


def expand(spark, edges, nodes, limits, roots=("root",), t=None):
    e = spark.createDataFrame([(a, p, b, 1.0, NOW, i) for i, (a, p, b) in enumerate(edges)], EDGE)
    r = records(spark, *[record(n, salience=s, **(k[0] if k else {})) for n, s, *k in nodes])
    roots_ = spark.createDataFrame([(x, i) for i, x in enumerate(roots)], "id string, root_rank int")
    n, ed = graph.expand(roots_, e, r, t, limits)
    return [(x["id"], x["hop"]) for x in graph.order_nodes(n, r, t).collect()], [(x["source_id"], x["predicate"], x["target_id"]) for x in ed.orderBy("place").collect()]


def test_expansion(spark):
    nodes = [("root", 1.0), ("first", 0.9), ("second", 0.8), ("leaf", 0.7), ("secret", 0.9, dict(sensitivity="hyper"))]
    edges = [("root", "related", "first"), ("root", "related", "first"), ("root", "supports", "second"), ("first", "related", "leaf"), ("root", "x", "missing"), ("root", "x", "secret"), ("first", "back", "root")]
    n, e = expand(spark, edges, nodes, graph.Limits(1, 9, 1, 1))
    assert n == [("root", 0), ("first", 1)] and e == [("root", "related", "first")]
    n, e = expand(spark, edges, nodes, graph.Limits(1, 4, 9, 2), t=trust.Trust("low"))
    assert n == [("root", 0), ("first", 1), ("second", 1), ("leaf", 2)] and len(e) == 4
    n, e = expand(spark, edges, nodes, graph.Limits(1, 2, 9, 2))
    assert n == [("root", 0), ("first", 1)] and e == [("root", "related", "first"), ("first", "back", "root")]
    assert expand(spark, edges, nodes, graph.Limits(1, 9, 9, 0)) == ([("root", 0)], [])


def test_redacted_nodes_show_nothing(spark):
    r = records(spark, record("root"), record("mid", sensitivity="medium"))
    nodes = spark.createDataFrame([("root", 0, 0, True), ("mid", 1, 1, False)], "id string, hop int, place long, root boolean")
    got = {x["id"]: (x["redacted"], x["payload_json"]) for x in graph.order_nodes(nodes, r, trust.Trust("low")).collect()}
    assert got["mid"] == (True, None) and got["root"][1]
    same = records(spark, *[record(i, salience=x) for i, x in (("a", 0.1), ("b", 0.9), ("c", 0.5))])
    flat = spark.createDataFrame([("c", 0, 0, True), ("b", 1, 1, False), ("a", 1, 2, False)], "id string, hop int, place long, root boolean")
    assert [[x["id"] for x in graph.order_nodes(flat, same, None, by).collect()] for by in ("salience", "id")] == [["c", "b", "a"], ["c", "a", "b"]]


def test_retrieve_graph(spark):
    rows = [record("entity-3", type="entity", salience=0.1), record("linked", salience=0.2), record("plain", salience=1.0), record("mid", sensitivity="medium", salience=0.9), record("high", sensitivity="high", salience=0.95)]
    recs = records(spark, *rows, extra=True)
    rel = spark.createDataFrame([("linked", " Subject_Entity ", "entity-3", 1.0, NOW, 1), ("entity-3", "fact_subject_of", "linked", 1.0, NOW, 2), ("entity-3", "mentioned_in", "mid", 1.0, NOW, 3), ("entity-3", "x", "high", 1.0, NOW, 4)], EDGE)
    ents = spark.createDataFrame([("entity-3", "Orchid", ["deploy target"], ["Service"], "", "low")], "id string, canonical_name string, aliases array<string>, types array<string>, scope string, sensitivity string")
    none = spark.createDataFrame([], "id string, mentions array<struct<surface:string,aliases:array<string>>>")
    ask = lambda t="low", **kw: graph.retrieve_graph(recs, rel, ents, none, trust.Trust(t), AS_OF, **kw)
    got = ask(query="Orchid deploy target", types=("semantic",), limits=graph.Limits(1, 3, 9, 1))
    assert [r["id"] for r in got.roots.collect()] == ["linked"] and [(r["id"], r["hop"]) for r in got.nodes.collect()] == [("linked", 0), ("entity-3", 1)] and got.edges.count() == 1
    got = ask(query="orchid", limits=graph.Limits(1, 9, 9, 1))
    assert [r["id"] for r in got.roots.collect()] == ["entity-3"] and {r["id"]: r["payload_json"] is None for r in got.nodes.collect()} == {"entity-3": False, "linked": False, "mid": True}
    got = ask(limits=graph.Limits(2, 9, 9, 0))
    assert [r["id"] for r in got.roots.orderBy("root_rank").collect()] == ["plain", "mid"] and got.selection.first()["needs_more"]


def test_boosts(spark):
    e = spark.createDataFrame([("Orchid", ["staging deploy target"], ["Service"])], "canonical_name string, aliases array<string>, types array<string>")
    assert e.select(graph.entity_boost(F.lit("orchid")).alias("b")).first()["b"] == 100 and e.select(graph.entity_boost(F.lit("orchid staging deploy target service")).alias("b")).first()["b"] == 190
    m = spark.createDataFrame([([("x", ["orchid"]), ("Orchid", []), ("orchid", [])],), (None,)], "m array<struct<surface:string,aliases:array<string>>>")
    assert [r["b"] for r in m.select(graph.mention_boost(F.col("m"), F.lit("orchid")).alias("b")).collect()] == [50, 0]
    base = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, place int")
    boosts = spark.createDataFrame([("c", 80)], "id string, boost int")
    assert [(r["id"], r["root_rank"]) for r in graph.rank_roots(base, boosts, 2).orderBy("root_rank").collect()] == [("c", 0), ("a", 1)]


# --- store and revision


def test_store(spark, tmp_path):
    snap = store.create(store.empty(spark), records(spark, record("a", tags=["x", "y"]), record("b", salience=0.3)))
    rel = spark.createDataFrame([("a", "uses", "b", 0.0, NOW, 1), ("a", "uses", "b", 0.4, NOW, 2), ("b", "x", "a", 0.0, NOW, 3)], EDGE)
    snap = snap.having(relations=store.add_relations(snap.relations, rel))
    assert {(r["source_id"], r["weight"], r["seq"]) for r in snap.relations.collect()} == {("a", 0.4, 1), ("b", 1.0, 3)}
    with pytest.raises(store.AlreadyExists):
        store.create(snap, records(spark, record("a")))
    for bad in (dict(confidence=2.0), dict(payload_json=None), dict(payload_json="null"), dict(type="working"), dict(sensitivity=""), dict(salience=-0.1)):
        with pytest.raises(store.Invalid):
            store.create(snap, records(spark, record("c", **bad)))
    with pytest.raises(store.NotFound):
        store.link(snap, rel.limit(1).withColumn("source_id", F.lit("zz")))
    assert [r["target_id"] for r in store.relations_of(snap, "a").collect()] == ["b"] and [r["id"] for r in retrieve.by_type(snap.records, "semantic", trust.Trust("low")).collect()] == ["a", "b"]
    with pytest.raises(store.NotFound):
        store.relations_of(snap, "zz")
    assert store.get(snap, "a").first()["relations"][0]["target_id"] == "b" and [r["id"] for r in store.get_batch(snap, ["b", "zz", "a"]).collect()] == ["b", "a"]
    with pytest.raises(store.NotFound):
        store.get(snap, "zz")
    up = store.update(snap, records(spark, record("a", salience=0.2, created_at=NOW)), rel.limit(0))
    assert up.records.where("id = 'a'").first()["created_at"] == ago(hours=2).replace(tzinfo=None) and [r["source_id"] for r in up.relations.collect()] == ["b"]
    assert store.delete(snap, spark.createDataFrame([("b",)], "id string")).relations.count() == 0
    assert [r["id"] for r in store.list_records(snap.records, tags=["x", "y"]).collect()] == ["a"] and store.list_records(snap.records, min_salience=0.5, limit=5, offset=1).count() == 0
    path = f"file://{tmp_path}/s"
    store.publish(snap, path, 1)
    store.publish(up, path, 2)
    assert store.current(spark, path).records.where("id = 'a'").first()["salience"] == 0.2
    with pytest.raises(store.AlreadyExists):
        store.publish(snap, path, 2)
    jobs.decay_job(spark, path)(0)
    assert store.current(spark, path).records.count() == 2 and store.current(spark, path).audit.count() == 2
    emb = spark.createDataFrame([("a", [1.0, 2.0], NOW)], "record_id string, embedding array<float>, created_at timestamp")
    kept = store.store_embeddings(snap.embeddings, emb, "m", 2)
    assert [list(r["embedding"]) for r in store.get_embeddings(kept, spark.createDataFrame([("a",), ("a",), ("q",)], "id string")).collect()] == [[1.0, 2.0]]
    facts = spark.createDataFrame([("f2", "s", "p", "o"), ("f1", "s", "p", "o"), ("f3", "s", "p", None)], "id string, subject string, predicate string, object string")
    asked = spark.createDataFrame([("s", "p", "o"), ("s", "p", "x")], "subject string, predicate string, object string")
    assert {r["object"]: r["id"] for r in store.find_exact(facts, asked).collect()} == {"o": "f1", "x": None}
    with pytest.raises(store.Invalid):
        store.store_embeddings(kept, emb, "other", 2)


def test_revision(spark):
    snap = snapshot(spark, record("old"), record("other"), record("epi", type="episodic"))
    new = lambda i, **kw: records(spark, record(i, **kw))
    s = revise.supersede(snap, "old", new("new"), "me", "fresh", AS_OF)
    rows = {r["id"]: r for r in s.records.collect()}
    assert rows["old"]["salience"] == 0 and rows["old"]["status"] == "retracted" and rows["new"]["status"] == "active"
    assert [(r["source_id"], r["predicate"], r["target_id"]) for r in s.relations.collect()] == [("new", "supersedes", "old")]
    assert {r["rationale"] for r in s.audit.collect()} == {"superseded by new: fresh", "supersedes old: fresh"}
    m = revise.merge(snap, ["old", "other"], new("m"), "me", "same", AS_OF)
    assert m.relations.count() == 2 and {r["salience"] for r in m.records.where("id in ('old','other')").collect()} == {0.0}
    f = revise.fork(snap, "old", new("f"), "me", "try", AS_OF)
    assert f.records.where("salience = 0").count() == 0 and f.relations.first()["predicate"] == "derived_from"
    c = revise.contest(snap, "old", "other", "me", "no", AS_OF)
    assert c.records.where("status = 'contested' and salience = 0.8").count() == 1
    assert revise.retract(snap, "old", "me", "x", AS_OF).audit.first()["action"] == "delete"
    assert (rows["old"]["superseded_by"], rows["new"]["supersedes"]) == ("new", "old") and [(x["kind"], x["ref"], x["created_by"]) for x in rows["new"]["provenance"]] == [("event", "old", "me")]
    source = [("observation", "x", "me", NOW)]
    assert revise.fork(snap, "old", new("g", payload_json='{"kind":"semantic"}', provenance=source), "me", "y", AS_OF).records.where("id = 'g'").count() == 1
    for call, err in (
        (lambda: revise.retract(snap, "epi", "m", "x", AS_OF), store.NotRevisable), (lambda: revise.retract(snap, "zz", "m", "x", AS_OF), store.NotFound),
        (lambda: revise.supersede(snap, "old", new("n", payload_json="{}"), "m", "x", AS_OF), store.NotRevisable), (lambda: revise.fork(snap, "old", new("other"), "m", "x", AS_OF), store.AlreadyExists),
        (lambda: revise.contest(snap, "old", "zz", "m", "x", AS_OF), store.NotFound), (lambda: revise.merge(snap, [], new("n"), "m", "x", AS_OF), store.Invalid),
    ):
        with pytest.raises(err):
            call()


def test_many_revisions(spark):
    snap = snapshot(spark, *[record(i) for i in "abcdefg"], record("epi", type="episodic"), record("work", type="working"))
    rows = [
        ("supersede", "a", "a2", "me", "why"), ("merge", "b", "m", "me", "one"), ("merge", "c", "m", "me", "one"), ("fork", "d", "d2", "me", "try"), ("retract", "e", None, "me", "gone"), ("retract", "work", None, "me", "gone"),
        ("contest", "f", "g", "me", "no"), ("retract", "epi", None, "me", ""), ("retract", "zz", None, "me", ""), ("merge", "g", "m2", "me", ""), ("merge", "zz", "m2", "me", ""), ("fork", "g", "bare", "me", ""), ("fork", "g", "none", "me", ""),
        ("contest", "g", "zz", "me", ""), ("odd", "g", "d3", "me", ""), ("supersede", "g", "b", "me", ""), ("retract", "e", None, "me", "gone"),
    ]
    changes = spark.createDataFrame(rows, "op string, old_id string, new_id string, actor string, rationale string")
    new = records(spark, *[record(i) for i in ("a2", "m", "d2", "m2", "b")], record("bare", payload_json='{"kind":"semantic"}'))
    after, refused = revise.revise_many(snap, changes, new, AS_OF)
    got = {r["id"]: (r["salience"], r["status"], r["superseded_by"], r["supersedes"]) for r in after.records.collect()}
    assert got["a"] == (0.0, "retracted", "a2", None) and got["a2"] == (0.8, "active", None, "a") and got["b"][:2] == got["c"][:2] == got["e"][:2] == (0.0, "retracted") and got["work"][:2] == (0.0, "active")
    assert got["f"][:2] == (0.8, "contested") and got["d"][:2] == got["g"][:2] == (0.8, "active") and not {"m2", "bare"} & set(got) and len(got) == 12
    assert {(r["source_id"], r["predicate"], r["target_id"]) for r in after.relations.collect()} == {("a2", "supersedes", "a"), ("m", "derived_from", "b"), ("m", "derived_from", "c"), ("d2", "derived_from", "d"), ("f", "contested_by", "g")}
    assert {(r["old_id"], r["new_id"], r["reason"].split()[0]) for r in refused.collect()} == {("epi", None, "episodic"), ("zz", None, "record"), ("g", "m2", "record"), ("zz", "m2", "record"), ("g", "bare", "a"), ("g", "none", "new"), ("g", "zz", "contesting"), ("g", "d3", "unknown"), ("g", "b", "new")}
    log = {(r["record_id"], r["action"], r["rationale"]) for r in after.audit.collect()}
    assert {("m", "create", "merged from b, c: one"), ("a", "revise", "superseded by a2: why"), ("e", "delete", "gone"), ("f", "revise", "no"), ("d2", "create", "forked from d: try")} <= log and after.audit.count() == 10
    one = revise.supersede(snap, "a", records(spark, record("a2")), "me", "why", AS_OF)
    same = lambda s, i: s.records.where(F.col("id") == i).first().asDict()
    assert same(one, "a2") == same(after, "a2") and same(one, "a") == same(after, "a")
    none, _ = revise.revise_many(snap, changes.limit(0), new, AS_OF)
    assert none.records.count() == 9 and none.audit.count() == 0


def test_ingest(spark):
    rows = [
        dict(request_id="e", kind="event", source="app", timestamp=NOW, tags=["t"], scope="s", event_kind='say "hi"', ref="r\\1", summary="ok\n"),
        dict(request_id="t", kind="tool_output", source="app", timestamp=NOW, tool_name="bash", args='{"a":[1]}', result='"done"', depends_on=["n0"]),
        dict(request_id="o", kind="observation", source="app", timestamp=NOW, scope="s", subject="ORCHID", predicate="is", object='"orchid"', sensitivity="high"),
        dict(request_id="o2", kind="observation", source="app", timestamp=NOW, scope="z", subject="nobody", predicate="is", object='{"x":1}'),
        dict(request_id="w", kind="working_state", source="app", thread_id="th", state="planning", next_actions=["a"], open_questions=[]),
        dict(request_id="x", kind="outcome", source="app", timestamp=NOW, target_record_id="epi", outcome="success"), dict(request_id="x2", kind="outcome", source="app", timestamp=ago(hours=1), target_record_id="epi", outcome="failure"),
        dict(request_id="y", kind="outcome", source="app", timestamp=NOW, target_record_id="sem", outcome="success"), dict(request_id="z", kind="outcome", source="app", timestamp=NOW, target_record_id="zz", outcome="success"),
        dict(request_id="b1", kind="event", source="app", timestamp=NOW, event_kind="k", ref=""), dict(request_id="b2", kind="outcome", source="app", timestamp=NOW, target_record_id="epi", outcome="great"),
        dict(request_id="b3", source="app"), dict(request_id="b4", kind="tool_output", source="app", tool_name="x", sensitivity="odd"), dict(request_id=None, kind="event", source="a"),
    ]
    req = spark.createDataFrame(rows, ingest.REQUESTS)
    req = req.unionByName(req.where("request_id = 'e'"))
    terms = spark.createDataFrame([("orchid", "entity-1", "s"), ("orchid", "entity-2", "")], "term string, entity_id string, scope string")
    snap = snapshot(spark, record("epi", type="episodic", payload_json='{"kind":"episodic","timeline":[{"ref":"a\\"b"}],"outcome":"partial"}'), record("sem"))
    got = ingest.ingest(req, snap.records, terms, AS_OF)
    assert {(r["request_id"], r["reason"]) for r in got.refused.collect()} == {("y", "target record is not episodic"), ("z", "target record not found"), ("b1", "ref is required"), ("b2", "outcome is unknown"), ("b3", "kind is required"), ("b4", "sensitivity is unknown")}
    made = {json.loads(r["payload_json"]).get("thread_id") or r["provenance"][0]["kind"] + str(len(r["tags"])) + r["scope"]: (r, json.loads(r["payload_json"])) for r in got.records.collect()}
    e, o, o2 = made["event1s"], made["observation0s"], made["observation0z"]
    assert e[1]["timeline"] == [{"t": "2026-02-05T12:00:00.000000Z", "event_kind": 'say "hi"', "ref": "r\\1", "summary": "ok\n"}] and (e[0]["confidence"], e[0]["half_life_seconds"], e[0]["created_by"]) == (0.8, 3600, "ingestion-service")
    t = made["tool_call0"][1]
    assert t["tool_graph"][0]["args"] == {"a": [1]} and t["tool_graph"][0]["result"] == "done" and t["tool_graph"][0]["id"] == t["timeline"][0]["ref"] and t["timeline"][0]["summary"] == "tool_call: bash"
    assert (o[1]["subject"], o[1]["object"], o[0]["sensitivity"], o[0]["type"]) == ("entity-1", "entity-1", "high", "semantic") and (o2[1]["subject"], o2[1]["object"]) == ("nobody", {"x": 1}) and o[1]["evidence"][0]["source_id"] == "app"
    assert made["th"][1] == {"kind": "working", "thread_id": "th", "state": "planning", "next_actions": ["a"]} and made["th"][0]["confidence"] == 1.0
    assert sorted(r["predicate"] for r in got.relations.collect()) == ["fact_object_of", "fact_subject_of", "object_entity", "subject_entity"]
    after = ingest.apply(snap, got)
    epi = after.records.where("id = 'epi'").first()
    assert json.loads(epi["payload_json"]) == {"kind": "episodic", "timeline": [{"ref": 'a"b'}], "outcome": "success"} and [x["ref"] for x in epi["provenance"]] == ["outcome:epi:failure", "outcome:epi:success"]
    assert after.records.count() == 7 and after.audit.count() == 7 and {r["rationale"] for r in after.audit.where("record_id = 'epi'").collect()} == {"Outcome recorded: success", "Outcome recorded: failure"}
    empty = ingest.ingest(req.limit(0), snap.records, terms, AS_OF)
    assert empty.records.count() == empty.relations.count() == empty.changed.count() == empty.refused.count() == 0


# --- metrics and evaluation


def test_metrics(spark):
    rows = [
        record("semantic-1", confidence=0.8, salience=0.1, created_at=ago(hours=2), pinned=True), record("competence-1", type="competence", confidence=0.6, salience=0.3, created_at=ago(hours=48)),
        record("plan-1", type="plan_graph", confidence=1.0, salience=0.5, created_at=ago(minutes=30)), record("working-1", type="working", confidence=0.4, salience=0.7, created_at=ago(hours=25)),
        record("episode-1", type="episodic", confidence=0.2, salience=0.9, created_at=ago(hours=72)),
    ]
    df = records(spark, *rows).withColumn("success_rate", F.when(F.col("id") == "competence-1", 0.75)).withColumn("execution_count", F.when(F.col("id") == "plan-1", 4))
    audit = spark.createDataFrame([("reinforce",), ("revise",), ("fork",)], "action string")
    m = metrics.collect(df, audit, AS_OF).first()
    assert (m["total_records"], m["active_records"], m["pinned_records"], m["total_audit_entries"]) == (5, 5, 1, 3)
    assert [m[k] for k in ("avg_salience", "avg_confidence", "memory_growth_rate", "retrieval_usefulness", "revision_rate", "competence_success_rate", "plan_reuse_frequency")] == pytest.approx([0.5, 0.6, 0.4, 1 / 3, 2 / 3, 0.75, 4])
    assert {r["records"] for r in metrics.histogram(df).collect()} == {1} and metrics.histogram(df).count() == 5
    zero = metrics.collect(df.limit(0), audit.limit(0), AS_OF).first()
    assert all(v == 0 for v in zero.asDict().values())


def test_evaluation(spark):
    q = spark.createDataFrame([("q1", 2), ("q2", 5), ("q3", 3)], "query_id string, k int")
    ranked = spark.createDataFrame([("q1", "x", 1), ("q1", "a", 2), ("q1", "b", 3), ("q2", "z", 1)], "query_id string, id string, rank int")
    want = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q1", "a"), ("q3", "n")], "query_id string, id string")
    got = {r["query_id"]: r for r in evalkit.at_k(ranked, want, q).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert [got["q1"][c] for c in ("recall", "precision", "mrr", "ndcg")] == pytest.approx([0.5, 0.5, 0.5, (1 / math.log2(3)) / ideal])
    assert (got["q2"]["recall"], got["q2"]["ndcg"], got["q2"]["precision"], got["q3"]["recall"]) == (1, 1, 0, 0)
    assert evalkit.macro(evalkit.at_k(ranked, want, q)).first()["mrr"] == pytest.approx(0.5 / 3)
    base = evalkit.baseline(ranked, spark.createDataFrame([("q1", "a"), ("q1", "b")], "query_id string, id string"))
    assert {(r["id"], r["rank"]) for r in base.collect()} == {("a", 1), ("b", 2)}
    assert evalkit.compare(evalkit.at_k(base, want, q), evalkit.at_k(ranked, want, q)).first()["wins"] == 1


# --- consolidation


def test_consolidation(spark):
    ev = spark.createDataFrame([("e1", 1, "build", "done"), ("e1", 2, "build", "again"), ("e2", 3, "note", " "), ("e2", 4, "known", "s"), ("e2", 5, None, "s")], "record_id string, place int, event_kind string, summary string")
    old = spark.createDataFrame([("known", "f1", 0.95)], "subject string, fact_id string, salience double")
    new, more = consolidate.semantic_facts(ev, old)
    assert sorted((r["subject"], r["object"], r["reinforcements"]) for r in new.collect()) == [("", "s", 0), ("build", "done", 1), ("note", " ", 0)] and [(r["fact_id"], r["salience"]) for r in more.collect()] == [("f1", 1.0)]
    other = spark.createDataFrame([("known", "is", "f0", 0.1), ("known", "observed_in", "f2", 0.3), ("known", "observed_in", "f3", 0.4), ("build", "is", "f4", 0.5)], "subject string, predicate string, fact_id string, salience double")
    new, more = consolidate.semantic_facts(ev, other)
    assert {r["subject"] for r in new.collect()} == {"", "build", "note"} and [(r["fact_id"], r["salience"]) for r in more.collect()] == [("f2", 0.4)]
    tools = spark.createDataFrame([("e1", 1, "bash"), ("e1", 2, "apt"), ("e2", 1, "apt"), ("e2", 2, " bash "), ("e3", 1, "")], "record_id string, place int, tool string")
    eps = spark.createDataFrame([("e1", 1, "project:beta", "high"), ("e2", 2, "project:alpha", "zz"), ("e3", 3, "", "low")], "record_id string, place int, scope string, sensitivity string")
    none = spark.createDataFrame([], "skill_name string, skill_id string, salience double")
    r = consolidate.skills(tools, eps, none)[0].collect()
    assert [(x["skill_name"], x["success_count"], x["scope"], x["sensitivity"], x["recipe"]) for x in r] == [("skill:apt+bash", 2, "consolidated:mixed-scope", "high", ["bash", "apt"])]
    assert r[0]["scope_note"] == "scope=consolidated:mixed-scope from project:alpha, project:beta"
    nodes = spark.createDataFrame([("e1", n, n, "t", d) for n, d in (("build", []), ("test", ["build"]), ("deploy", ["test"]))] + [("e2", "a", "a", "t", [])], "record_id string, place string, node string, tool string, deps array<string>")
    plans, edges = consolidate.plans(nodes, ev, spark.createDataFrame([("e9",)], "record_id string"))
    assert [(p["record_id"], p["intent"], p["n_nodes"]) for p in plans.collect()] == [("e1", "build", 3)] and edges.count() == 2
    ans = spark.createDataFrame([("e1", '```json\n[{"subject":" a","predicate":"b","object":"c"},{"subject":"a","predicate":"b ","object":"c"},{"subject":"","predicate":"x","object":"y"}]\n```'), ("e2", "no json"), ("e3", None)], "record_id string, answer string")
    assert [tuple(x) for x in consolidate.triples(ans).collect()] == [("e1", "a", "b", "c")]


def test_extraction_queue(spark):
    eps = spark.createDataFrame([(f"e{i}", ago(hours=i)) for i in range(5)], "record_id string, created_at timestamp")
    log = spark.createDataFrame([("e4", 3, ago(hours=9)), ("e3", -1, ago(minutes=10)), ("e2", -1, ago(hours=2))], "record_id string, triple_count int, claimed_at timestamp")
    todo, log2 = consolidate.claim(eps, log, AS_OF, batch=2)
    assert [r["record_id"] for r in todo.collect()] == ["e2", "e1"] and log2.count() == 4
    out = consolidate.release(log2, spark.createDataFrame([("e2", 5)], "record_id string, triple_count int"), spark.createDataFrame([("e1",)], "record_id string"))
    assert {(r["record_id"], r["triple_count"]) for r in out.collect()} == {("e4", 3), ("e3", -1), ("e2", 5)}
    df = records(spark, record("x", type="episodic", created_at=ago(hours=30)), record("y", type="episodic"), record("z", type="episodic", created_at=ago(hours=30), salience=0.06))
    assert {r["id"]: r["salience"] for r in consolidate.compress(df, AS_OF).collect()} == {"x": 0.4, "y": 0.8, "z": 0.05}


# --- capture


def test_capture(spark):
    kinds = ["event", "tool_output", "observation", "outcome", "working_state", "zzz", None]
    rows = capture.policy(spark.createDataFrame([(k, "" if k == "event" else None) for k in kinds], "source_kind string, sensitivity string")).collect()
    assert [(r["type"], r["policy_confidence"]) for r in rows] == [("episodic", 0.8), ("episodic", 0.9), ("semantic", 0.7), ("episodic", 0.85), ("working", 1.0), ("episodic", 0.5), ("episodic", 0.5)] and {r["sensitivity"] for r in rows} == {"low"}
    req = spark.createDataFrame([("event", json.dumps({"ref": "evt-1", "text": "t", "project": "Orchid", "n": 3}), None, None, ["A", "a"])], "source_kind string, content string, summary string, reason_to_remember string, tags array<string>")
    r = capture.fallback(req).first()
    assert [(m["surface"], m["entity_kind"]) for m in r["i_mentions"]] == [("Orchid", "project")] and [x["ref"] for x in r["i_references"]] == ["evt-1"] and r["i_summary"] == "t" and r["i_labels"] == ["A"]
    ents = spark.createDataFrame([("entity-1", "Orchid", "s1"), ("entity-2", "orchid", "")], "entity_id string, canonical_name string, scope string")
    terms = ents.select(F.lower("canonical_name").alias("term"), "entity_id", "scope")
    ms = spark.createDataFrame([("r1", "s1", "ORCHID ", "tool", None), ("r2", "s2", "orchid", None, None), ("r3", "s2", "New", "person", None), ("r4", "s2", "new", "tool", None), ("r5", "", "", None, "entity-2"), ("r6", "", None, None, None)], "record_id string, scope string, surface string, entity_kind string, canonical_entity_id string")
    res, made = capture.resolve_mentions(ms, ents, terms)
    got = {r["record_id"]: r["entity_id"] for r in res.collect()}
    assert got["r1"] == "entity-1" and got["r2"] == "entity-2" and got["r3"] == got["r4"] and got["r5"] == "entity-2" and "r6" not in got and made.count() == 1
    links = spark.createDataFrame([("a", "uses", "b", 0.0), ("a", "uses", "a", 0.5), ("a", "mine", "c", 3.0)], "source_id string, predicate string, target_id string, confidence double")
    assert {(r["source_id"], r["predicate"], r["weight"]) for r in capture.edge_pairs(links, AS_OF).collect()} == {("a", "uses", 1.0), ("b", "used_by", 1.0), ("a", "mine", 1.0), ("c", "inverse_of_mine", 1.0)}
    obs = spark.createDataFrame([("q", "s", "low", "observation", None, None, '{"subject":"Orchid","predicate":"deploy_target_for","object":"staging"}'), ("w", "s", "low", "event", None, 0.4, "{}")], "request_id string, scope string, sensitivity string, source_kind string, proposed_type string, extraction_confidence double, content string")
    assert [(f["subject"], f["object"], f["confidence"]) for f in capture.facts_of(obs, AS_OF).collect()] == [("Orchid", "staging", 0.8)]


def test_candidate_scores(spark):
    c = spark.createDataFrame([("same", "semantic", "s", ["T"], ["gate"], 0.1, ago(days=1)), ("ent", "entity", "", [], [], 0.9, None), ("far", "working", "z", [], [], 0.5, ago(days=1))], "id string, type string, scope string, tags array<string>, terms array<string>, salience double, created_at timestamp")
    q = spark.createDataFrame([("q", "s", "semantic", ["t"], ["the gate", None]), ("n", None, None, None, None)], "request_id string, scope string, type string, tags array<string>, terms array<string>")
    got = {(r["request_id"], r["id"]): (r["score"], r["rank"]) for r in capture.score_candidates(q, c, AS_OF).collect()}
    assert got["q", "same"] == (pytest.approx(100 + 10 + 8 + 25 + 0.5), 1) and got["q", "ent"][0] == 15 and got["n", "far"][0] == pytest.approx(0.5) and len(got) == 6
    assert len(capture.score_candidates(q, c, AS_OF, pool=1, kept=1).collect()) == 2


def test_texts(spark):
    lit = lambda t, x: F.from_json(F.lit(json.dumps(x)) if x is not None else F.lit(None).cast("string"), t)
    ep = lit(texts.EPISODIC, {"timeline": [{"event_kind": "a", "ref": "r#1 ", "summary": "one"}, {"event_kind": "b", "summary": " "}, {"event_kind": "c"}], "tool_graph": [{"tool": "bash", "result": " ok "}, {"tool": "apt"}], "outcome": "success"})
    assert value(spark, texts.episode_content(ep)) == "a: one\ntool bash -> ok\ntool apt\noutcome: success"
    assert value(spark, texts.episodic_text(ep["timeline"])) == " " and value(spark, texts.names_reference(ep["timeline"], F.lit("R#1"))) and not value(spark, texts.names_reference(ep["timeline"], F.lit("")))
    bare = lit(texts.EPISODIC, {"timeline": [{"event_kind": "a", "ref": "x"}]})
    assert value(spark, texts.episodic_text(bare["timeline"])) == "a x" and value(spark, texts.episodic_text(lit(texts.EPISODIC, {"timeline": []})["timeline"])) == ""
    assert value(spark, texts.working_text(F.lit("s"), F.lit(""), F.array(F.lit("x"), F.lit("y")))) == "s x y" and value(spark, texts.competence_text(F.lit("k"), F.array(F.lit(""), F.lit("t")))) == "k t"
    a = lit(texts.INTERPRETATION, {"status": "resolved", "summary": "s", "topical_labels": ["X"], "mentions": [{"surface": "m", "canonical_entity_id": "e"}], "extraction_confidence": 0.3})
    b = lit(texts.INTERPRETATION, {"summary": "", "topical_labels": ["x", "y"], "reference_candidates": [{"ref": "r"}], "extraction_confidence": 0.0})
    m = value(spark, texts.merged(a, b))
    assert (m["summary"], m["topical_labels"], m["mentions"][0]["surface"], m["extraction_confidence"]) == ("s", ["X", "y"], "m", 0.3)
    assert value(spark, texts.final_status(a)) == "resolved" and value(spark, texts.final_status(b)) == "tentative" and value(spark, texts.final_status(lit(texts.INTERPRETATION, None))) == "tentative"
    none = F.lit(None).cast("array<string>")
    assert value(spark, texts.query_terms(F.array(F.lit("T")), none, F.lit('{"project":"P"}'), a)) == ["T", "P", "X", "m"] and value(spark, texts.search_terms(F.array(F.lit("id")), none, a)) == ["id", "s", "X", "m"]
    assert value(spark, texts.derived_tags(F.array(F.lit("Consolidated"), F.lit("z")))) == ["consolidated", "z"] and value(spark, texts.looks_like_entity_id(F.lit("a-b-c-d-e"))) and not value(spark, texts.looks_like_entity_id(F.lit("a-b")))
    nodes = F.array(F.struct(F.lit("build").alias("op"), F.lit('{"repo":"r","x":1}').alias("params")), F.struct(F.lit("").alias("op"), F.lit(None).cast("string").alias("params")))
    assert value(spark, texts.plan_entity_terms(nodes)) == ["build", "r"] and value(spark, texts.matches_term(F.array(F.lit("The Gate")), F.lit("gate")))


REQUEST = "request_id string, source string, source_kind string, content string, summary string, reason_to_remember string, tags array<string>, scope string, sensitivity string, proposed_type string, extraction_confidence double"


def test_capture_batch(spark):
    rows = [
        ("r1", "app", "event", json.dumps({"ref": "evt-1", "text": "t", "project": "Orchid"}), None, "why", ["A"], "s1", None, None, None),
        ("r2", "app", "observation", json.dumps({"subject": "Orchid", "predicate": "deploy_target_for", "object": "staging"}), None, None, None, "s2", None, None, None),
        ("r3", None, None, None, None, None, None, None, None, None, None), (None, None, "event", "{}", None, None, None, None, None, None, None),
    ]
    req = spark.createDataFrame(rows + rows[:1], REQUEST)
    ents = spark.createDataFrame([("entity-1", "Orchid", "s1")], "entity_id string, canonical_name string, scope string")
    terms = ents.select(F.lower("canonical_name").alias("term"), "entity_id", "scope")
    line = spark.createDataFrame([("old", "EVT-1 "), ("old2", None)], "id string, ref string")
    out = {k: df.collect() for k, df in capture.capture_batch(req, records(spark, record("old")), ents, terms, line, AS_OF).items()}
    assert sorted(r["type"] for r in out["records"]) == ["episodic"] * 3 and len(out["facts"]) == 1 and [e["canonical_name"] for e in out["entities"]] == ["Orchid"]
    kinds = sorted((e["predicate"], e["target_id"] in ("entity-1", "old")) for e in out["edges"])
    assert kinds == sorted([("mentions_entity", True), ("mentioned_in", False), ("references_record", True), ("referenced_by", False), ("mentions_entity", False), ("mentioned_in", False), ("derived_semantic", False), ("derived_from", False), ("subject_entity", False), ("fact_subject_of", False)])
    assert {e["weight"] for e in out["edges"]} == {1.0} and out["facts"][0]["subject"] == out["entities"][0]["entity_id"] and out["entities"][0]["aliases"] == ["Orchid"]
    assert len(out["audit"]) == 3 and all(json.loads(r["payload_json"])["timeline"] for r in out["records"]) and {r["status"] for r in out["interpretations"]} == {"resolved"}
    payload = json.loads(next(r for r in out["records"] if r["provenance"][0]["ref"] == "evt-1")["payload_json"])
    assert payload["environment"] == {"context": {"capture_content": {"ref": "evt-1", "text": "t", "project": "Orchid"}, "reason_to_remember": "why"}}
    snap = snapshot(spark, record("old"))
    after = capture.write(snap, capture.capture_batch(req, snap.records, ents, terms, line, AS_OF), AS_OF)
    rows = {r["id"]: r for r in after.records.collect()}
    assert sorted(r["type"] for r in rows.values()) == ["entity", "episodic", "episodic", "episodic", "semantic", "semantic"] and after.relations.count() == 10 and after.audit.count() == 5
    fact = next(r for i, r in rows.items() if r["type"] == "semantic" and i != "old")
    assert json.loads(fact["payload_json"])["object"] == "staging" and json.loads(fact["interpretation_json"])["mentions"][0]["canonical_entity_id"] in rows and fact["salience"] == 1.0
    again = capture.write(after, capture.capture_batch(req, after.records, ents, terms, line, AS_OF), AS_OF)
    assert again.records.count() == len(rows) and again.relations.count() == 10 and again.audit.count() == 5
    none = {k: df.collect() for k, df in capture.capture_batch(req.limit(0), records(spark, record("old")), ents, terms, line, AS_OF).items()}
    assert all(v == [] for v in none.values())


def test_capture_with_an_interpreter(spark):
    from engram.operators import embed

    said = {
        "summary": "a deploy", "proposed_type": "semantic", "topical_labels": ["b", "A"], "extraction_confidence": 0.9,
        "mentions": [{"surface": "The flower", "entity_kind": "project", "aliases": ["Orchid"]}, {"surface": "the FLOWER "}, {"surface": "known", "canonical_entity_id": "entity-9"}],
        "reference_candidates": [{"ref": "nothing"}], "relation_candidates": [{"predicate": " Supports ", "target_record_id": "old", "confidence": 0.4}, {"predicate": "uses", "target_record_id": "gone"}],
    }
    model = lambda ts: ["```json\n" + json.dumps(said) + "\n```" if "orchid" in t else None for t in ts]
    rows = [("r1", "app", "event", json.dumps({"text": "orchid", "subject": "the flower", "predicate": "is", "object": "red"}), None, None, ["a"], "s1", None, None, None), ("r2", "app", "event", '{"project":"Rose"}', None, None, [], "s1", None, None, None)]
    req = spark.createDataFrame(rows, REQUEST).withColumn("interpretation", embed.interpretation(embed.answers(F.col("content"), model)))
    ents = spark.createDataFrame([("entity-1", "Orchid", "s1"), ("entity-9", "nine", "")], "entity_id string, canonical_name string, scope string")
    terms = ents.select(F.lower("canonical_name").alias("term"), "entity_id", "scope")
    out = {k: df.collect() for k, df in capture.capture_batch(req, records(spark, record("old")), ents, terms, spark.createDataFrame([], "id string, ref string"), AS_OF).items()}
    edges = {(e["predicate"], e["target_id"], e["weight"]) for e in out["edges"]}
    assert {("mentions_entity", "entity-1", 1.0), ("mentions_entity", "entity-9", 1.0), ("supports", "old", 0.4)} <= edges and not any(p == "uses" for p, _, _ in edges) and [e["canonical_name"] for e in out["entities"]] == ["Rose"]
    assert [(f["subject"], f["object"], f["confidence"]) for f in out["facts"]] == [("entity-1", "red", 0.9)] and out["facts"][0]["tags"] == ["a", "b"]
    assert sorted((r["status"], r["summary"]) for r in out["interpretations"]) == [("resolved", None), ("tentative", "a deploy")]


def test_run_all(spark):
    recs = records(spark, *[record(f"e{i}", type="episodic", created_at=ago(hours=30 + i)) for i in range(2)]).withColumn("outcome", F.lit("success"))
    line = spark.createDataFrame([("e0", 1, "build", "ok"), ("e1", 1, "known", "ok")], "record_id string, place int, event_kind string, summary string")
    nodes = spark.createDataFrame([(e, i, f"n{i}", t, []) for e in ("e0", "e1") for i, t in enumerate("abc")], "record_id string, place int, node string, tool string, deps array<string>")
    facts = spark.createDataFrame([("known", "f", 0.5)], "subject string, fact_id string, salience double")
    skill = spark.createDataFrame([], "skill_name string, skill_id string, salience double")
    out, counts = consolidate.run_all(recs, line, nodes, facts, skill, spark.createDataFrame([("e1",)], "record_id string"), AS_OF)
    assert {r["counter"]: r["n"] for r in counts.collect()} == {"episodes_compressed": 2, "facts_created": 1, "facts_reinforced": 1, "skills_created": 1, "skills_reinforced": 0, "plans_created": 1}
    assert out["skills"].first()["skill_name"] == "skill:a+b+c"


def test_consolidation_writes(spark):
    episode = lambda i, **kw: record(i, type="episodic", created_at=ago(hours=1), payload_json='{"kind":"episodic","outcome":"success"}', tags=["x"], **kw)
    snap = snapshot(spark, episode("e0", scope="s"), episode("e1", scope="s", sensitivity="medium"), record("old", salience=0.5, payload_json='{"kind":"semantic","subject":"known","predicate":"observed_in","object":"o"}'))
    line = spark.createDataFrame([("e0", 1, "build", "Orchid"), ("e1", 1, "known", "ok"), ("e1", 2, "known", "ok")], "record_id string, place int, event_kind string, summary string")
    nodes = spark.createDataFrame([(e, i, f"n{i}", t, [f"n{i - 1}"] if i else []) for e in ("e0", "e1") for i, t in enumerate(("bash", "apt", "git"))], "record_id string, place int, node string, tool string, deps array<string>")
    terms = spark.createDataFrame([("orchid", "entity-1", ""), ("bash", "entity-2", "s")], "term string, entity_id string, scope string")
    answers = spark.createDataFrame([("e0", '[{"subject":"a","predicate":"b","object":"c"},{"subject":"known","predicate":"observed_in","object":"o"}]'), ("e1", '[{"subject":"a","predicate":"b","object":"c"}]')], "record_id string, answer string")
    after, counters = consolidate.consolidate(snap, line, nodes, terms, AS_OF, answers)
    n = {r["counter"]: r["n"] for r in counters.collect()}
    assert n == {"episodes_compressed": 0, "facts_created": 1, "facts_reinforced": 1, "skills_created": 1, "skills_reinforced": 0, "plans_created": 2, "triples_created": 1, "triples_reinforced": 1}
    rows = {r["id"]: r for r in after.records.collect()}
    body = {i: json.loads(r["payload_json"]) for i, r in rows.items()}
    fact = next(r for i, r in rows.items() if body[i].get("subject") == "build")
    assert (body[fact["id"]]["object"], fact["tags"], fact["scope"], fact["provenance"][0]["ref"]) == ("entity-1", ["consolidated", "x"], "s", "e0") and rows["old"]["salience"] == pytest.approx(0.8)
    skill = next(r for r in rows.values() if r["type"] == "competence")
    assert (body[skill["id"]]["skill_name"], [x["step"] for x in body[skill["id"]]["recipe"]][0], skill["sensitivity"], skill["tags"]) == ("skill:apt+bash+git", "Step 1: invoke bash", "medium", ["consolidated", "auto-competence"])
    plans = [r for r in rows.values() if r["type"] == "plan_graph"]
    assert len(plans) == 2 and all(len(body[p["id"]]["edges"]) == 2 and len(body[p["id"]]["nodes"]) == 3 for p in plans) and len(rows) == 8
    edges = {(r["source_id"], r["predicate"], r["target_id"]) for r in after.relations.collect()}
    assert {(skill["id"], "derived_from", "e0"), (skill["id"], "derived_from", "e1"), (skill["id"], "uses", "entity-2"), ("entity-2", "used_by", skill["id"]), (fact["id"], "object_entity", "entity-1"), ("entity-1", "fact_object_of", fact["id"])} <= edges
    again, counters = consolidate.consolidate(after, line, nodes, terms, AS_OF, answers)
    n = {r["counter"]: r["n"] for r in counters.collect()}
    assert again.records.count() == 8 and (n["facts_created"], n["skills_created"], n["plans_created"], n["triples_created"]) == (0, 0, 0, 0) and n["skills_reinforced"] == 1


def test_embedding_seam(spark, tmp_path):
    from engram.operators import embed

    model = lambda ts: [[float(len(t)), 1.0] for t in ts]
    texts_ = spark.createDataFrame([("a", "xyz"), ("b", " "), ("c", None), ("d", "xyz"), ("e", "q")], "id string, text string")
    old = spark.createDataFrame([("e", [1.0, 1.0], "m", NOW)], store.EMBEDDINGS)
    out, added = embed.backfill(old, texts_, model, "m", 2, AS_OF)
    assert {r["record_id"]: list(r["embedding"]) for r in out.collect()} == {"a": [3.0, 1.0], "d": [3.0, 1.0], "e": [1.0, 1.0]} and added.count() == 2
    assert {(r["id"], round(r["similarity"], 3), r["known"]) for r in embed.similarity(out, texts_, [3.0, 1.0]).where("id in ('a', 'b')").collect()} == {("a", 1.0, True), ("b", 0.5, False)}
    with pytest.raises(store.Invalid):
        embed.backfill(old, texts_, model, "other", 2, AS_OF)
    snap = snapshot(spark, record("p", type="plan_graph", payload_json='{"kind":"plan_graph","intent":"ship it"}'), record("s", payload_json='{"kind":"semantic","subject":"a","predicate":"is","object":"b"}'), record("n", type="entity", payload_json='{"kind":"entity","canonical_name":"x"}'))
    got = {r["id"]: r["text"] for r in embed.record_texts(snap.records).collect()}
    assert got == {"p": "ship it", "s": "a is b", "n": ""}
    path = f"file://{tmp_path}/store"
    store.publish(snap, path, 1)
    jobs.backfill_job(spark, path, model, "m", 2)(0)
    assert {r["record_id"] for r in store.current(spark, path).embeddings.collect()} == {"p", "s"}
    jobs.consolidation_job(spark, path, lambda s: (spark.createDataFrame([], "record_id string, place int, event_kind string, summary string"), spark.createDataFrame([], "record_id string, place int, node string, tool string, deps array<string>"), spark.createDataFrame([], "term string, entity_id string, scope string")))(0)
    assert store.current(spark, path).records.count() == 3


# --- sources and streams


def test_sources(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"type":"record","key":"k","text":"x"}\n{"type":"query","key":"q","text":"y","expected":["k"],"k":0}\n')
    recs, qs = io.recall_set(spark, str(p))
    assert recs.count() == 1 and qs.first()["k"] == 5
    p.write_text('{"type":"odd"}\n')
    with pytest.raises(store.Invalid):
        io.recall_set(spark, str(p))
    df = records(spark, record("a"), record("b", payload_json='{"kind":"zzz"}'), record("c", payload_json=None))
    back = {r["id"]: r["payload_json"] for r in io.from_json(io.to_json(df), "id string, salience double").collect()}
    assert json.loads(back["a"])["kind"] == "semantic" and back["b"] is None and back["c"] is None
    assert io.ranges("id", ["8", "4", "8"]) == ["(id < '4' OR id IS NULL)", "(id >= '4' AND id < '8')", "(id >= '8')"] and io.ranges("id", []) == ["1 = 1"]
    assert io.Settings.load({"graph_hops": 2}).hops(0) == 2 and io.Settings().hops(-1) == 0
    for call in (lambda: io.Settings.load({"x": 1}), lambda: io.check_retrieve("zz"), lambda: io.check_retrieve("low", 10_001), lambda: io.check_penalty(math.nan), lambda: io.check_capture({"tags": ["x"] * 101}), lambda: io.check_capture({"summary": "x" * 100_001})):
        with pytest.raises(store.Invalid):
            call()


def test_token_bucket_and_streams(spark, tmp_path):
    rows = [("a", i, NOW + dt.timedelta(seconds=s)) for i, s in enumerate((0, 0, 0, 1, 400))] + [("b", 9, NOW)]
    df = spark.createDataFrame(rows, "client string, request_id long, t timestamp")
    assert {r["request_id"]: r["admitted"] for r in jobs.admit(df, 1.0, 2.0).collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}
    assert jobs.running_requests(df, 5).where("client = 'a'").agg(F.max("recent")).first()[0] == 4
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = jobs.admit_stream(spark.readStream.schema(df.schema).parquet(src), 1.0, 2.0).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    until = time.time() + 60  # with time-outs there is always a next batch, so the stream has no end to wait for
    while spark.table("admitted").count() < 6 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert {r["request_id"]: r["admitted"] for r in spark.table("admitted").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}
    got = []
    req = spark.createDataFrame([("r1", NOW), ("r1", NOW), ("r2", NOW)], "request_id string, timestamp timestamp")
    req.write.parquet(str(tmp_path / "req"))
    s = jobs.capture_stream(spark.readStream.schema(req.schema).parquet(str(tmp_path / "req")), lambda b, n: got.extend(r["request_id"] for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert s.awaitTermination(90)
    assert sorted(got) == ["r1", "r2"]


# --- queries over whole tables


def test_consolidation_takes_every_episode(spark, sf):
    import pandas as pd

    from engram.plans.reference import QUERIES

    filled = lambda c: c.fillna("").str.strip() != ""
    line = pd.read_parquet(f"{sf}/timeline_events.parquet")
    line = line.assign(id=line["record_id"].str.strip().str.lower()).sort_values("ingested_at").drop_duplicates(["id", "pos"], keep="last")
    told = int((line["summary"].fillna("") != "").sum())
    new = QUERIES["ref_semantic_new"](spark, sf).agg(F.sum(F.col("reinforcements") + 1)).first()[0]
    assert new + QUERIES["ref_semantic_reinforced"](spark, sf).agg(F.sum("matches")).first()[0] == told
    node = pd.read_parquet(f"{sf}/tool_nodes.parquet")
    node = node.assign(id=node["record_id"].str.strip().str.lower()).sort_values("called_at").drop_duplicates(["id", "node_id"], keep="last")
    big = node.groupby("id").filter(lambda g: len(g) >= 3)
    assert QUERIES["ref_plans"](spark, sf).count() == big["id"].nunique()
    assert QUERIES["ref_plan_edges"](spark, sf).count() == sum(0 if x is None else len(x) for x in big["depends_on"])
    bags = node[filled(node["tool"])].groupby("id")["tool"].agg(lambda t: "+".join(sorted(x.strip() for x in t))).value_counts()
    assert {r["skill_name"]: r["success_count"] for r in QUERIES["ref_skills"](spark, sf).collect()} == {f"skill:{k}": n for k, n in bags.items() if n >= 2}


def test_vector_rank_of_a_query_set(spark):
    vecs = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0], "z": [0.0, 0.0], "long": [1.0, 0.0, 0.0]}
    emb = spark.createDataFrame(list(vecs.items()), "record_id string, embedding array<double>")
    cand = spark.createDataFrame([("a",), ("b",), ("none",)], "id string")
    asked = emb.where("record_id in ('a', 'b', 'z')").withColumnRenamed("record_id", "query_id")
    got = {(r["query_id"], r["id"]): (r["vector_rank"], r["vector_score"], r["similarity"]) for r in retrieve.vector_rank(cand, emb, asked).collect()}
    assert len(got) == 9 and got["a", "a"] == (0, 1.0, 1.0) and got["b", "b"] == (0, 1.0, 1.0) and got["a", "none"] == (None, None, None)
    assert got["a", "b"] == (2, 0.5, 0.5) and got["z", "b"] == (1, 0.75, 0.5)
    for q in ("a", "b", "z"):
        one = {r["id"]: (r["vector_rank"], r["vector_score"]) for r in retrieve.vector_rank(cand, emb, vecs[q]).collect()}
        assert one == {i: x[:2] for (k, i), x in got.items() if k == q}


def test_vector_index(spark):
    import numpy as np

    from engram.operators import vectors

    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 8)) + 3 * rnd.normal(size=(12, 8))[rnd.integers(0, 12, 600)]
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8), ("long", [1.0] * 9), ("null", None)]
    emb = spark.createDataFrame(rows, "record_id string, embedding array<double>")
    asked = spark.createDataFrame([(r, v) for r, v in rows[::40]] + [("bad", [1.0])], "query_id string, embedding array<double>")
    index = vectors.build(emb, 8, lists=16, sample=300)
    assert index.rows.count() == 601 and index.centroids.shape == (16, 8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    true = {f"v{i:03d}": [f"v{j:03d}" for j in np.argsort(-(unit(x) @ unit(x[i])), kind="stable")[:5]] for i in range(0, 600, 40)}
    got = {}
    for r in vectors.search(index, asked, 5, 16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["record_id"])
    assert got.pop("bad", None) is None and {q: got[q] for q in true} == true
    assert vectors.recall(index, asked, 5, 6).agg(F.avg("recall")).first()[0] >= 0.9
    empty = vectors.build(emb.limit(0), 8)
    assert vectors.search(empty, asked, 5).count() == 0


def test_expansion_without_limits(spark):
    nodes = [("root", 1.0), ("first", 0.9), ("second", 0.8), ("leaf", 0.7)]
    edges = [("root", "related", "first"), ("root", "related", "first"), ("root", "supports", "second"), ("first", "related", "leaf"), ("root", "x", "missing"), ("first", "back", "root")]
    n, e = expand(spark, edges, nodes, graph.Limits(1, None, None, 2))
    assert (n, e) == expand(spark, edges, nodes, graph.Limits(1, 99, 99, 2)) and len(n) == 4 and len(e) == 4
    assert len(expand(spark, edges, nodes, graph.Limits(1, None, 1, 2))[1]) == 1 and len(expand(spark, edges, nodes, graph.Limits(1, 2, None, 2))[0]) == 2
    many = spark.range(25_000).select(F.concat(F.lit("r"), "id").alias("target_id"), F.col("id").alias("seq"))
    rel = many.select(F.lit("e").alias("source_id"), F.lit("mentioned_in").alias("predicate"), "target_id", F.lit(1.0).alias("weight"), "seq")
    root, all_ = spark.createDataFrame([("e", 0)], "id string, root_rank int"), many.select(F.col("target_id").alias("id")).unionByName(spark.createDataFrame([("e",)], "id string"))
    n, e = graph.expand(root, rel, all_, None, graph.Limits(1, None, None, 1))
    assert n.count() == 25_001 and e.agg(F.count_distinct("place"), F.min("place"), F.max("place"), F.count_if(F.col("place") == F.substring("target_id", 2, 9).cast("int") + 1)).first()[:] == (25_000, 1, 25_000, 25_000)


def test_interpretation_status_reads_every_form(spark, tmp_path):
    from engram.plans.reference import QUERIES

    open_, done = {"surface": "m", "confidence": 0.5}, {"surface": "m", "canonical_entity_id": "e"}
    forms = [{"mentions": open_}, json.dumps({"mentions": [open_]}), {"relation_candidates": {"predicate": "p"}}, {"reference_candidates": ["x", {"ref": "r", "resolved": False}]}]
    forms += [{"mentions": done}, json.dumps({"mentions": [done]}), {"relation_candidates": {"predicate": "p", "resolved": True}}]
    rows = [(f"r{i}", json.dumps(x), NOW) for i, x in enumerate(forms)]
    spark.createDataFrame(rows, "record_id string, interpretation_json string, interpreted_at timestamp").write.parquet(f"{tmp_path}/interpretations.parquet")
    assert {r["status"]: r["n"] for r in QUERIES["ref_interpretation_status"](spark, str(tmp_path)).collect()} == {"tentative": 4, "resolved": 3}


def test_linked_boost_counts_aliases_and_longer_names(spark, tmp_path):
    from engram.plans.reference import QUERIES

    alias = "array<struct<value:string,kind:string,locale:string>>"
    ents = [("e1", "obsidian-registry", []), ("e2", "The Obsidian-Registry mirror", None), ("e3", "other", [("obsidian-registry", "x", None)]), ("e4", "far", [])]
    rows = [(*e, "", None, [], [], NOW) for e in ents]
    schema = f"entity_id string, canonical_name string, aliases {alias}, scope string, primary_type string, types array<string>, identifiers array<struct<namespace:string,value:string>>, created_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/entities.parquet")
    ms = [(i, f"r{i}", 0, "s", None, f"e{i}", 0.5, None) for i in range(1, 5)]
    spark.createDataFrame(ms, "mention_id long, record_id string, pos int, surface string, entity_kind string, canonical_entity_id string, confidence double, aliases array<string>").write.parquet(f"{tmp_path}/mentions.parquet")
    assert {r["id"]: r["linked"] for r in QUERIES["ref_linked_boost"](spark, str(tmp_path)).collect()} == {"r1": 80, "r2": 80, "r3": 65}
