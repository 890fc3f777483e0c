"""Graph, ranking, gates, state and sharded windows on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import evidence, gates, stateful
from quern.operators import retrieval as r
from quern.operators.graph import components, degrees, expand, next_edges
from quern.operators.sharded import last_value, prefix_sum, previous_value


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def sharded_rows(spark, n=200, seed=1):
    rnd = random.Random(seed)
    data = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(50), i, rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return data, spark.createDataFrame(data, "g string, o int, i int, v int")


@pytest.mark.parametrize("shards", [1, 7])
def test_sharded_windows(spark, shards):
    data, df = sharded_rows(spark)
    expected_sum, expected_last, expected_previous = {}, {}, {}
    for g in {x[0] for x in data}:
        total, last, before = 0, None, None
        for _, _, i, v in sorted((x for x in data if x[0] == g), key=lambda x: x[1:3]):
            expected_sum[i], expected_previous[i] = total, before
            total += v or 0
            last = v if v is not None else last
            expected_last[i] = last
            before = i
    assert {x.i: x.s for x in prefix_sum(df, ["g"], ["o", "i"], "v", "s", shards).collect()} == expected_sum
    assert {x.i: x.s for x in last_value(df, ["g"], ["o", "i"], "v", "s", shards).collect()} == expected_last
    assert {x.i: x.s for x in previous_value(df, ["g"], ["o", "i"], "i", "s", shards).collect()} == expected_previous
    assert prefix_sum(df.limit(0), ["g"], ["o", "i"], "v", "s", shards).count() == 0


def test_next_edges(spark):
    df = spark.createDataFrame([("a", "p", 2), ("b", "p", 1), ("c", "p", None), ("d", None, 1), ("e", "q", 1)], "n string, p string, o int")
    assert rows(next_edges(df, "n", "p", ["o"])) == [("b", "a"), ("c", "b")]


def test_degrees_loops_and_expand(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("b", "d"), ("d", "e")], "source string, target string")
    assert rows(degrees(edges)) == [("a", 1, 1, 2), ("b", 2, 1, 3), ("c", 1, 1, 2), ("d", 1, 1, 2), ("e", 0, 1, 1)]
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    assert rows(expand(seeds, edges, 2)) == [("a", 0), ("b", 1), ("d", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    data = [(f"n{rnd.randrange(120):03d}", f"n{rnd.randrange(120):03d}") for _ in range(70)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(40)] + [(None, "x"), ("loop", "loop")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in data:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.id: x.component for x in components(spark.createDataFrame(data, "source string, target string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_dense_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8))
    data = [(i, [float(v) for v in x[i]]) for i in range(90)] + [(90, None), (91, [0.0] * 8)]
    index = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    got = r.dense(index, index.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 4)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(0, 90, 10):
        s = np.round(unit @ unit[q], 6)
        s[q] = -9
        assert [z.vec_id for z in got.where(f"query_id = {q}").orderBy("rank").collect()] == list(np.lexsort((np.arange(90), -s))[:4])
    assert got.where("query_id = 90 OR vec_id >= 90").count() == 0


def test_bm25_empty_null_and_tie(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c c c")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a a"), (2, "zzz"), (3, None)], "query_id long, text string")
    assert [(x.doc_id, x.rank) for x in r.bm25(docs, queries, 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_fuse_zero_weight_and_repeats(spark):
    c = spark.createDataFrame([(1, "x", "a", 3.0), (1, "x", "a", 1.0), (1, "x", "b", 2.0), (1, "y", "b", 9.0), (1, "z", "c", 9.0), (1, "w", "d", 1.0)], "query_id long, channel string, id string, score double")
    got = [(x.id, x.rank) for x in r.fuse(c, {"x": 1.0, "y": 1.0, "z": 0.0}).orderBy("rank").collect()]
    assert got == [("b", 1), ("a", 2)]


def test_look_up_levels(spark):
    index = spark.createDataFrame([(1, "n", "1", 5), (2, "n", "1", 9), (3, "n", "2", 1), (4, "", "1", 1), (5, None, None, 1)], "id long, number string, article string, at int")
    asked = spark.createDataFrame([(1, "n", "1"), (2, "n", None), (3, "n", "77"), (4, "", "1"), (5, None, None)], "query_id long, number string, article string")
    got = [(x.query_id, x.id, x.rank, x.level) for x in r.look_up(asked, index, ["number", "article"], ["at"], 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1, 2), (1, 1, 2, 2), (2, 2, 1, 1), (2, 1, 2, 1), (3, 2, 1, 1), (3, 1, 2, 1)]


def test_nearest_rank(spark):
    data = [("g", float(v)) for v in [5, 1, 1, 3, 9, 2, 2, 8]] + [("h", 7.0), ("h", None)]
    got = rows(r.nearest_rank(spark.createDataFrame(data, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}))
    assert got == [("g", 2.0, 9.0), ("h", 7.0, 7.0)]


def test_bootstrap_is_stable_and_covers(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "k int, v double")
    a, b = r.bootstrap(df, "k", "v", 100, 1).first(), r.bootstrap(df.repartition(5), "k", "v", 100, 1).first()
    assert a == b and a.low < a.mean < a.high


def test_bootstrap_query_takes_all_resamples(spark, data, monkeypatch):
    from quern.plans import retrieval

    asked = []
    monkeypatch.setattr(retrieval.r, "bootstrap", lambda df, key, value, samples, seed: asked.append((samples, seed)))
    retrieval.eval_bootstrap(spark, data)
    assert asked == [(2000, 42)]


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "x", 1)], "query_id long, id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (1, "b"), (2, "y"), (3, "z")], "query_id long, id string")
    got = {x.query_id: (x.recall, x.precision, x.mrr) for x in r.ir_metrics(ranked, relevant, 2).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_evidence(spark):
    df = spark.createDataFrame([(1, "u", 1, "x"), (2, "u", 1, "y"), (3, "u", 2, "x"), (4, "v", None, None)], "id long, unit string, start int, same string")
    assert [x[0] for x in rows(evidence.dedupe(df, ["unit", "start"], ["unit", "same"], ["id"]).select("id"))] == [1, 4]
    wanted = spark.createDataFrame([(1, "g1"), (1, "g2"), (2, "g1")], "query_id long, group string")
    found = spark.createDataFrame([(1, "g1"), (1, "g1")], "query_id long, group string")
    assert rows(evidence.coverage(wanted, found)) == [(1, 2, 1, 0.5, "g2"), (2, 1, 0, 0.0, "g1")]
    turns = spark.createDataFrame([(1, "a", 9.0, 1), (1, "a", 8.0, 2), (1, "b", 1.0, 3)], "q long, b string, s double, i long")
    assert [x.i for x in evidence.round_robin(turns, "q", "b", "s", "i", 2).orderBy("turn").collect()] == [1, 3]


def test_gates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, v int")
    assert rows(gates.duplicate_keys(df, "k")) == [("a", 2, 1), ("b", 2, 2)]
    assert gates.fingerprint(df, ["k", "v"]).first() == gates.fingerprint(df.orderBy(F.desc("k")).repartition(4), ["k", "v"]).first()
    assert gates.fingerprint(df, ["k", "v"]).first() != gates.fingerprint(df.distinct(), ["k", "v"]).first()
    assert gates.multiset_difference(df, df.orderBy("v")).count() == 0
    assert rows(gates.multiset_difference(df, df.distinct())) == [("a", 1, 1)]
    assert rows(gates.rule_rows(df, "k", {"NULL": F.col("v").isNull(), "TWO": F.col("v") == 2})) == [("b", "TWO"), ("c", "NULL")]
    catalog = spark.createDataFrame([("a", "x", " "), ("b", "y", "z")], "k string, p string, q string")
    got = {x.k: (x.status, x.missing) for x in gates.resolved(df.select("k").distinct(), catalog, "k", ["p", "q"]).collect()}
    assert got == {"a": ("UNVERIFIED", "q"), "b": ("VERIFIED", ""), "c": ("UNVERIFIED", "p,q")}


def test_state(spark):
    e = spark.createDataFrame([("u", 0, "a", 1), ("u", 10, "a", 2), ("u", 10, "b", 3), ("u", 65, "a", 4), (None, 1, "a", 5)], "k string, s int, p string, i int").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(stateful.rolling_counts(e, "k", "ts", 60)) == [("u", 0, 1, 1), ("u", 10, 2, 3), ("u", 65, 1, 3)]
    assert rows(stateful.idempotent(e.where("k = 'u'"), ["k"], "p", ["ts", "i"])) == [("u", 1, 2, 1)]
    b = {x.i: x.allowed for x in stateful.budgets(e, "k", ["ts", "i"], "i", 3).collect()}
    assert b == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_text_functions(spark):
    x = spark.createDataFrame([("Điều  KHOẢN\tđã Lập",), (None,), ("",)], "x string")
    assert [r[0] for r in x.select(t.fold(F.col("x"))).collect()] == ["dieu khoan da lap", None, ""]
    assert [r[0] for r in x.select(t.words(F.col("x"))).collect()] == [["điều", "khoản", "đã", "lập"], [], []]
    page = spark.createDataFrame([("một\n- 12 -\r\nhai \t ba\nTrang 3/9\n\n\n\nbốn",)], "x string")
    assert page.select(t.clean_lines(F.col("x"))).first()[0] == "một\nhai ba\n\nbốn"
    urls = spark.createDataFrame([("HTTPS://A.Example/x/#y",), ("https://u@b.example/",), ("nichts",), (None,)], "x string")
    assert [r[0] for r in urls.select(t.normal_url(F.col("x"))).collect()] == ["https://a.example/x", None, None, None]
    assert [r[0] for r in urls.select(t.host(F.col("x"))).collect()] == ["a.example", "b.example", None, None]


def test_dense_of_many_tiles(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(r, "BLOCK", 16)
    monkeypatch.setattr(r, "TILE", 40)
    x = np.random.default_rng(2).integers(-2, 3, size=(300, 3)).astype(float)  # many equal vectors and equal scores
    index = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "vec_id long, embedding array<float>").repartition(4)
    monkeypatch.setattr(type(index), "toLocalIterator", None)  # the vectors stay in Spark
    got = {(z.query_id, z.rank): (z.vec_id, z.score) for z in r.dense(index, index.withColumnRenamed("vec_id", "query_id"), 5).collect()}
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.maximum(norms, 1e-300)[:, None]
    expected = {}
    for q in np.flatnonzero(norms):
        s = np.round(unit @ unit[q], 6)
        s[[q, *np.flatnonzero(norms == 0)]] = -9
        expected |= {(int(q), n + 1): (int(v), float(s[v])) for n, v in enumerate(np.lexsort((np.arange(300), -s))[:5])}
    assert got == expected
