"""Orphan references, hierarchies and nested records against plain Python on small fixtures and whole small tables."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram.operators.flatten import child_table, child_tables, flatten, infer_schema, read_record, record_key, unread
from engram.operators.hierarchy import HELD, _peel, descendants, hierarchy, one_parent
from engram.operators.references import as_number, check_references
from engram.plans import general

T = dt.datetime(2025, 3, 1)


def at(days):
    return T + dt.timedelta(days=days)


def norm(s):
    s = None if s is None or (isinstance(s, float)) else s.strip().lower()
    return s or None


# --- references


REFS = "ref_field string, parent_table string, target string, ref_time timestamp, n int, status_ string"
PARENTS = "parent_table string, id string, first_seen timestamp, deleted boolean"


def states(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, REFS)
    p = spark.createDataFrame(parents, PARENTS)
    return {x["n"]: x["status"] for x in check_references(r, p, **kw).collect()}


def test_reference_states(spark):
    parents = [("a", f"rec-{i:012x}", at(i), False) for i in range(1, 40) if i != 20]
    parents += [("a", "REC-000000000005 ", at(-9), False), ("a", "rec-000000000007", at(50), True), ("b", "plain", None, None), ("a", None, at(0), False), ("a", " ", at(0), True)]
    refs = [
        ("f", "a", " Rec-000000000001\t", at(1), 1, "x"),
        ("f", "a", "rec-000000000014", at(90), 2, "x"),  # 20: the gap between two runs
        ("f", "a", "rec-000000000007", at(90), 3, "x"),
        ("f", "a", "rec-000000000009", at(8), 4, "x"),
        ("f", "a", "rec-000000000005", at(0), 5, "x"),  # its first arrival counts
        ("f", "b", "plain", at(0), 6, "x"),
        ("f", "b", "rec-000000000001", at(90), 7, "x"),  # another table's key
        ("f", "a", "rec-1", at(90), 8, "x"),  # the same number in another width
        ("f", "a", "", at(90), 9, "x"),
        ("f", "a", None, at(90), 10, "x"),
        ("f", "a", "rec-000000000009", None, 11, "x"),
        ("f", "a", "rec-000000000027", at(99), 12, "x"),
        ("f", "a", "rec-000000000028", at(99), 13, "x"),  # just beyond the last run's end
        ("f", "a", "", None, 14, "x"),
    ]
    want = {1: "ok", 2: "missing", 3: "deleted", 4: "late", 5: "ok", 6: "ok", 7: "missing", 8: "missing", 11: "ok", 12: "ok", 13: "missing"}
    assert states(spark, refs, parents) == want
    assert states(spark, refs, parents, partitions=1) == want


def test_reference_empty_tables(spark):
    assert states(spark, [], []) == {}
    assert states(spark, [("f", "a", "x", T, 1, "")], []) == {1: "missing"}
    assert states(spark, [], [("a", "x", T, False)]) == {}


def test_reference_hot_key_and_small_batches(spark):
    refs = [("f", "a", "rec-000000000003", at(9), i, "") for i in range(500)] + [("f", "a", f"rec-{i:012x}", at(9), 1000 + i, "") for i in range(300)]
    parents = [("a", f"rec-{i:012x}", at(0), False) for i in range(300) if i % 7]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = states(spark, refs, parents)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all(got[i] == "ok" for i in range(500))
    assert all(got[1000 + i] == ("ok" if i % 7 else "missing") for i in range(300))


def test_ids_stay_apart(spark):
    ids = ["rec-01", "rec-1", "rec-", "rec", "", "cafe0000000000000000001", "afe0000000000000000001", "x/1", "1", "g1"]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select(*as_number(F.lit("t"), F.col("i")))
    assert df.distinct().count() == len(ids)


def test_p2_against_python(spark, sf):
    d = f"{sf}"
    read = lambda t: pd.read_parquet(f"{d}/{t}.parquet")
    seen, dead = {}, set()
    for t, k, c in (("memory_records", "id", "ingested_at"), ("entities", "entity_id", "created_at")):
        for i, s, x in read(t)[[k, c, "deleted_at"]].itertuples(index=False):
            key = (t, norm(i))
            seen[key] = min(seen.get(key, s), s)
            if not pd.isna(x):
                dead.add(key)
    bad = lambda t, v, when: norm(v) and ((t, norm(v)) not in seen or (t, norm(v)) in dead or seen[t, norm(v)] > when)
    want = set()
    for rid, text, when in read("interpretations").drop_duplicates("record_id")[["record_id", "interpretation_json", "interpreted_at"]].itertuples(index=False):
        o = read_record(text) or {}
        for field, col, t in (("relation_candidates", "target_record_id", "memory_records"), ("reference_candidates", "target_entity_id", "entities")):
            items = o.get(field)
            for i, v in enumerate([items] if isinstance(items, dict) else items or []):
                if isinstance(v, dict) and bad(t, v.get(col), when):
                    want.add((f"{field}.{col}", rid, i))
    facts = read("semantic_facts").sort_values("updated_at").drop_duplicates("record_id", keep="last")
    for rid, v, when in facts[["record_id", "superseded_by", "updated_at"]].itertuples(index=False):
        if bad("memory_records", v, when):
            want.add(("revision.superseded_by", rid, 0))
    got = [tuple(r) for r in general.p2_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


# --- hierarchies


def brute(pairs):
    parent = dict(pairs)
    out = {}
    for x in {*parent, *parent.values()}:
        way, seen = [x], {x}
        while way[-1] in parent and parent[way[-1]] not in seen:
            way.append(parent[way[-1]])
            seen.add(way[-1])
        out[x] = ("", -1, None) if way[-1] in parent else (way[-1], len(way) - 1, way[::-1])
    return out


def sizes(pairs):
    """Each node with all below it, where its way up ends."""
    out = {}
    for x, (_, _, path) in brute(pairs).items():
        for y in path or []:
            out[y] = out.get(y, 0) + 1
    return {x: out.get(x, 0) for x in brute(pairs)}


def tree(spark, pairs, bound):
    df = spark.createDataFrame([(*x, "clash") for x in pairs], "id string, parent string, size string")
    rows = hierarchy(df, bound).collect()
    short = {r["id"]: (r["root_id"], r["depth"], r["size"]) for r in hierarchy(df, bound, paths=False).collect()}
    full = {r["id"]: (r["root_id"], r["depth"], r["path"]) for r in rows}
    assert len(rows) == len(full) and {r["id"]: r["size"] for r in rows} == sizes([x for x in pairs if None not in x])
    assert short == {r["id"]: (r["root_id"], r["depth"], r["size"]) for r in rows}
    return full


@pytest.mark.parametrize("bound", [0, 900, 4 << 20])
def test_hierarchy_shapes(spark, bound):
    rnd = random.Random(bound)
    pairs = [(f"c{i}", f"c{i - 1}") for i in range(1, 24)]  # a chain
    pairs += [(f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 20)]
    pairs += [("c7b", "c7"), ("c9b", "c9"), ("c9c", "c9b")]
    pairs += [("self", "self"), ("below", "self"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("hang", "l1"), ("hang2", "hang")]
    assert tree(spark, pairs, bound) == brute(pairs)


def test_hierarchy_empty_null_and_one_parent(spark):
    assert tree(spark, [], 10) == {} and tree(spark, [(None, "a"), ("a", None)], 10) == {}
    links = spark.createDataFrame([("a", "z", 1), ("a", "b", 1), ("a", "y", 2), (None, "q", 0), ("a", "b", 1)], "id string, parent string, rank int")
    assert [tuple(r) for r in one_parent(links).collect()] == [("a", "b")]


def test_local_peel_of_a_long_chain_holds_no_square():
    n = 20_000
    pdf = pd.DataFrame({"id": [f"n{i}" for i in range(n)], "parent": [None, *[f"n{i}" for i in range(n - 1)]], "hops": [0] + [1] * (n - 1), "acc": 1, "extra": 0})
    got = pd.concat(_peel(False)(iter([pdf])))
    assert got["depth"].tolist() == list(range(n)) and got["size"].tolist() == list(range(n, 0, -1)) and set(got["root"]) == {"n0"}
    pdf = pdf.iloc[:3000].assign(via=[[] for _ in range(3000)])
    parts = [(len(p), p["path"].map(len).sum()) for p in _peel(True)(iter([pdf]))]
    assert sum(x for x, _ in parts) == 3000 and max(y for _, y in parts) <= HELD + 3000


def test_descendants(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "b"), ("s", "s")]
    got = {tuple(r) for r in descendants(hierarchy(spark.createDataFrame(pairs, "id string, parent string"))).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_p4_against_python(spark, sf):
    facts = pd.read_parquet(f"{sf}/semantic_facts.parquet").sort_values("updated_at").drop_duplicates("record_id", keep="last")
    ids = {norm(r): r for r in facts["record_id"]}
    pairs = {}
    for r, older, newer in facts[["record_id", "supersedes", "superseded_by"]].itertuples(index=False):
        if norm(newer) in ids:
            pairs.setdefault(norm(newer), norm(r))
    for r, older, newer in facts[["record_id", "supersedes", "superseded_by"]].itertuples(index=False):
        if norm(older) in ids:
            pairs[norm(r)] = norm(older)
    want = {(ids[x], ids.get(root, ""), depth) for x, (root, depth, _) in brute(pairs.items()).items()}
    assert {tuple(r) for r in general.p4_found(spark, sf).collect()} == want


def test_p4_keeps_records_whose_link_was_not_chosen(spark, tmp_path):
    rows = [("X", "A", None), ("A", None, None), ("b", None, "x "), ("alone", None, "gone")]
    df = spark.createDataFrame(rows, "record_id string, supersedes string, superseded_by string").withColumn("updated_at", F.lit(T))
    df.write.parquet(f"{tmp_path}/semantic_facts.parquet")
    assert {tuple(r) for r in general.p4_found(spark, str(tmp_path)).collect()} == {("X", "A", 1), ("A", "A", 0), ("b", "b", 0)}
    assert {(r["id"], r["path"]) for r in general.p4_paths(spark, str(tmp_path)).collect()} == {("x", "a > x"), ("a", "a"), ("b", "b")}


# --- nested records


def paths(o, at=""):
    for k, v in o.items() if isinstance(o, dict) else enumerate(o):
        here = f"{at}[{k}]" if isinstance(o, list) else f"{at}.{k}" if at else k
        if isinstance(o, list) and isinstance(v, dict):
            yield here
        if isinstance(v, (dict, list)):
            yield from paths(v, here)


TEXTS = [
    ("a", json.dumps({"x": [{"y": [{"z": 1}, 2, {"w": []}]}, "s", {}], "o": {"p": {"q": [[{"r": [{"deep": None}]}]]}}})),
    ("b", json.dumps(json.dumps({"one": {"k": [{"v": 1}]}}))),
    ("c", '{"x": [{"y": 1}'),
    ("d", ""),
    ("e", None),
    ("f", "[{}]"),
    ("g", "null"),
    ("h", '{"x": null, "one": [], "y": {}}'),
    (None, '{"x": [{}]}'),
    (" ", '{"x": [{}]}'),
]


def test_flatten_cases(spark):
    df = spark.createDataFrame([(k, t, "clash", i) for i, (k, t) in enumerate(TEXTS + TEXTS[:2])], "key string, text string, path string, fields int")
    got = flatten(df, "key", "text", None, ["one"])
    want = {("a", p) for p in paths(json.loads(TEXTS[0][1]))} | {("b", "one[0]"), ("b", "one[0].k[0]")}
    rows = [(r["record_id"], r["path"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    by_id = {r["row_id"]: r for r in got.collect()}
    deep = next(r for r in by_id.values() if r["path"] == "x[0].y[2]")
    assert by_id[deep["parent_id"]]["path"] == "x[0]" and deep["ordinal"] == 2
    assert json.loads(next(r["fields"] for r in by_id.values() if r["path"] == "one[0]")) == {"k": [{"v": 1}]}
    schema = infer_schema(df, "text", ["one"])
    assert schema["x[].y[]"] == {"w": "json", "z": "long"} and schema["one[]"] == {"k": "json"} and schema["o.p.q[][].r[]"] == {"deep": "string"}
    typed = child_tables(df, "key", "text", None, ["one"])
    assert set(typed) == set(schema) and {r["f_z"] for r in typed["x[].y[]"].collect()} == {1, None}
    assert {(r["record_id"], r["parent_id"]) for r in typed["x[]"].collect()} == {("a", spark.range(1).select(record_key(F.lit("a"))).first()[0])}
    flat = child_table(got, "x[].y[]", ["z", "w", "none"]).collect()
    assert sorted((r["ordinal"], r["f_z"], r["f_w"], r["f_none"]) for r in flat) == [(0, "1", None, None), (2, None, "[]", None)]


def test_unread_records_are_reported(spark):
    more = [("i", "3"), ("j", " \t"), ("k", json.dumps(json.dumps(json.dumps(json.dumps(json.dumps({"x": []})))))), ("l", json.dumps("{"))]
    df = spark.createDataFrame([(k, t, "clash") for k, t in TEXTS + more], "key string, text string, reason string")
    got = {r["record_id"]: r["reason"] for r in unread(df, "key", "text").collect()}
    assert got == {"c": "not JSON", "d": "blank", "e": "null", "f": "no object", "g": "no object", "i": "no object", "j": "blank", "l": "not JSON"}
    assert unread(df.limit(0), "key", "text").collect() == []


def test_schema_types_merge(spark):
    texts = ['{"x": [{"a": 1, "b": 1, "c": true, "d": "s", "e": {}, "f": null}]}', '{"x": [{"a": 2.5, "b": "t", "c": null, "d": "s", "e": 1}, {"a": 99999999999999999999}]}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    assert infer_schema(df, "t") == {"x[]": {"a": "double", "b": "string", "c": "boolean", "d": "string", "e": "json", "f": "string"}}
    rows = child_tables(df, "k", "t")["x[]"].orderBy("record_id", "ordinal").collect()
    assert [(r["f_a"], r["f_b"], r["f_c"], r["f_e"], r["f_f"]) for r in rows] == [(1.0, "1", True, "{}", None), (2.5, "t", None, "1", None), (1e20, None, None, None, None)]


def test_flatten_takes_the_newest_row(spark):
    df = spark.createDataFrame([("A ", '{"x":[{"a":1},{}]}', at(1)), ("a", '{"x":[{"a":2}]}', at(2))], "k string, t string, w timestamp")
    got = flatten(df, "k", "t", "w", carry_order=True).collect()
    assert [(r["record_id"], r["path"], r["fields"], r["w"]) for r in got] == [("a", "x[0]", '{"a":2}', at(2))]
    assert flatten(df.limit(0), "k", "t", "w").collect() == []


def test_p5_against_python(spark, sf):
    want = set()
    for name, text, lone in (("payloads", "payload_json", general.PAYLOAD_ARRAYS), ("interpretations", "interpretation_json", general.INTERPRETATION_ARRAYS)):
        for rid, t in pd.read_parquet(f"{sf}/{name}.parquet")[["record_id", text]].itertuples(index=False):
            o = read_record(t) or {}
            o = {k: [v] if k in lone and isinstance(v, dict) else v for k, v in o.items()}
            want |= {(name, rid, p) for p in paths(o)}
    got = [tuple(r) for r in general.p5_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_deep_records(spark):
    from engram.operators.flatten import _deep_loads, _dumps

    n = 5_000
    deep = '{"a":[' * n + "1" + "]}" * n
    assert read_record(deep) is not None and read_record(json.dumps(deep)) is not None and read_record(deep[:-1]) is None and read_record(deep + "x") is None
    assert _dumps(read_record(deep)) == deep
    for t in ('{}', ' { "a" : [ 1 , -2.5e3, "x\\n", null , true, {"b": {}, "b": [[]]} ] } ', "[]", '"s"', "3"):
        assert _deep_loads(t) == json.loads(t)
    for t in ("", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "{1:2}", "[,1]", "tru", "]", "[}", '{"a":}', "1 2"):
        with pytest.raises(ValueError):
            _deep_loads(t)
    m = 1_500
    got = flatten(spark.createDataFrame([("k", '{"a":[' * m + "{}" + "]}" * m)], "k string, t string"), "k", "t")
    assert got.count() == m and got.agg(F.max(F.length("path"))).first()[0] == 5 * m - 1
