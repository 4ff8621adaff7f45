"""Single rows for each key, ranks over ranges, and staged tables, with nulls, ties, repeated rows and empty inputs."""

import os

import pytest
from pyspark.sql import functions as F

from engram.operators.ranks import numbered
from engram.plans import staging
from engram.sources.tables import newest, one_row_each

ROWS = [("a", 1, "x"), ("a", 2, "w"), ("a", 2, None), ("b", None, "y"), ("b", None, "y"), ("c", 3, None), (None, 9, "z"), *[("hot", i % 7, str(i)) for i in range(200)]]


@pytest.mark.parametrize("limit", [None, 0])
def test_one_row_each(spark, limit):
    df = spark.createDataFrame(ROWS, "k string, n int, best string")
    got = {r["k"]: (r["n"], r["best"]) for r in one_row_each(df, "k", limit=limit).collect()}
    assert got == {"a": (2, "w"), "b": (None, "y"), "c": (3, None), "hot": (6, "97")}
    low = {r["k"]: (r["n"], r["best"]) for r in one_row_each(df, "k", F.min, limit).collect()}
    assert low["a"] == (1, "x") and low["hot"] == (0, "0") and len(low) == 4
    two = one_row_each(df, ["k", "n"], limit=limit).collect()
    assert len(two) == len({(r["k"], r["n"]) for r in two}) == 3 + 7 and one_row_each(df.limit(0), "k", limit=limit).collect() == []


def test_newest_wide_is_newest(spark):
    df = spark.createDataFrame(ROWS, "k string, n int, best string")
    plain, wide = (sorted(map(tuple, newest(df, F.upper("k"), ["n"], ["best", "k"], "key", wide=w).collect()), key=repr) for w in (False, True))
    assert plain == wide and len(wide) == 4


def test_numbered(spark):
    rows = [(g, i % 50, i) for g in ("p", None) for i in range(300)] + [("q", 1, 1)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = sorted((r["no"], r["v"], r["id"]) for r in numbered(df.where("g = 'p'"), [F.desc("v"), "id"], "no").collect())
    assert [x[0] for x in got] == list(range(300)) and [x[1:] for x in got] == sorted(((i % 50, i) for i in range(300)), key=lambda x: (-x[0], x[1]))
    by = {}
    for r in numbered(df, ["v", "id"], "no", ["g"], start=1).collect():
        by.setdefault(r["g"], []).append(r["no"])
    assert {g: sorted(n) == list(range(1, len(n) + 1)) for g, n in by.items()} == {"p": True, None: True, "q": True}
    assert numbered(df.limit(0), ["v"], "no", ["g"]).collect() == []


def test_staged_tables_go_at_the_end_of_the_block(spark):
    with staging.staged(spark):
        df = staging.stage(spark.range(5).toDF("id"))
        path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Away:
        master = "spark://away:7077"

    class Session:
        sparkContext = Away()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError):
        staging.staging_dir(Session())
