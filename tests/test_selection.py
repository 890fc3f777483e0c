"""Choosing from ranked lists, on small fixtures with nulls, ties and repeated rows."""

import math

from quern.operators import selection as s
from quern.operators.graph import best_first, blocked
from quern.operators.hierarchy import hierarchy

RANKED = "query_id string, id string, rank int"


def test_group_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a2", 2), ("q", "x", 3), ("q", "b", 4), ("q", "b", 4), ("q", None, 5), ("r", "z", 1)], RANKED)
    groups = spark.createDataFrame([("q", "A", "a"), ("q", "A", "a2"), ("q", "B", "b"), ("q", "B", "b"), ("q", "C", None), ("r", "A", "a"), ("q", None, "x"), (None, "A", "a")], "query_id string, group string, id string")
    got = {r.query_id: r for r in s.group_metrics(ranked, groups, 4).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert math.isclose(got["q"].group_recall, round(2 / 3, 6)) and got["q"].novel_precision == 0.5 and got["q"].mrr == 1.0 and not got["q"].all_found
    assert math.isclose(got["q"].group_ndcg, (1 + 1 / math.log2(5)) / ideal, abs_tol=1e-6)
    assert (got["r"].group_recall, got["r"].mrr, got["r"].group_ndcg) == (0, 0, 0) and set(got) == {"q", "r"}
    assert s.group_metrics(ranked.limit(0), groups.limit(0), 3).count() == 0


def test_prioritized_and_retained(spark):
    items = spark.createDataFrame([("q", "a", 1, "A"), ("q", "b", 2, "A"), ("q", "c", 3, "B"), ("q", "c", 3, "A"), ("q", "d", 4, None), ("q", "d", 4, None)], RANKED + ", group string")
    assert [(r.id, r.reason) for r in s.prioritized(items).orderBy("place").collect()] == [("a", "GROUP"), ("c", "GROUP"), ("b", "RANK"), ("d", "RANK")]
    ranked = spark.createDataFrame([("q", "d", 1), ("q", "e", 2), ("q", "a", 3), ("q", "a", 3)], RANKED)
    kept = s.retained(ranked, items.where("group IS NOT NULL").withColumn("rank", items.rank), 3).orderBy("place").collect()
    assert [(r.id, r.origin) for r in kept] == [("a", "ITEM"), ("c", "ANCHOR"), ("d", "ITEM")]
    assert s.retained(ranked.limit(0), items.limit(0), 3).count() == 0


def test_union_promoted_and_recall(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 7)], RANKED)
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("q", "d", 3), ("q", "e", 4), ("p", "x", 1)], RANKED)
    assert [(r.query_id, r.id, r.rank, r.origin) for r in s.union_lists(a, b, 2).orderBy("query_id", "rank").collect()] == [("p", "x", 1, "ADDED"), ("q", "a", 1, "BASE"), ("q", "b", 2, "BASE"), ("q", "c", 3, "ADDED"), ("q", "d", 4, "ADDED")]
    links = spark.createDataFrame([("b", "e"), ("b", "d"), ("b", "d"), ("b", "b"), ("c", "b"), ("b", None)], "source string, target string")
    assert [r.id for r in s.promoted(b.where("query_id = 'q'"), links, 4).orderBy("new_rank").collect()] == ["b", "d", "e", "c"]
    assert [r.id for r in s.promoted(b.where("query_id = 'q'"), links, 2).orderBy("new_rank").collect()] == ["b", "d", "c", "e"]
    assert [r.id for r in s.promoted(b.where("query_id = 'q'"), links, 1).orderBy("new_rank").collect()] == ["b", "c", "d", "e"]
    wanted = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z"), ("q", None), ("n", "a")], "query_id string, id string")
    got = {r.query_id: (r.n_relevant, r.n_found, r.passed) for r in s.union_recall(a.unionByName(b), wanted, 2, 0.6).collect()}
    assert got == {"q": (3, 2, True), "n": (1, 0, False)}


def test_outcome_and_schedule(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, None), (1.0, -1.0), (1e-13, None), (None, None)], "x double, y double")
    assert [r[0] for r in df.select(s.outcome([df.x, df.y])).collect()] == ["IMPROVED", "HARMED", "MIXED", "UNCHANGED", "UNCHANGED"]
    rows = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1), ("n", 1)], "method string, id int")
    assert {tuple(r) for r in s.schedule_faults(rows, ["method", "id"]).collect()} == {("n", 1, 2), ("n", 2, 0)}
    assert s.schedule_faults(rows.limit(0), ["method", "id"]).count() == 0


def test_best_first(spark):
    edges = spark.createDataFrame([("s", "a", "T"), ("s", "b", "T"), ("s", "c", "U"), ("a", "d", "T"), ("d", "s", "T"), ("b", "b", "T"), ("a", "d", "T"), ("c", "e", "U")], "source string, target string, type string")
    seeds = spark.createDataFrame([("s",), ("s",), ("lone",)], "id string")
    got = {(r.seed, r.id): (r.hop, r.score) for r in best_first(seeds, edges, {"T": 1.0}, 2, 2, 0.5, 0.0).collect()}
    assert got == {("s", "s"): (0, 0.0), ("lone", "lone"): (0, 0.0), ("s", "a"): (1, 1.0), ("s", "b"): (1, 1.0), ("s", "d"): (2, 1.5)}
    assert best_first(seeds.limit(0), edges, {"T": 1.0}, 2, 2).count() == 0


def test_blocked(spark):
    rows = [("a", None), ("b", "a"), ("c", "gone"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "y"), ("e", "")]
    tasks = spark.createDataFrame([(i, n, 1) for i, n in rows], "id string, needs string, at int")
    got = {r.id: r.status for r in blocked(tasks, hierarchy(tasks, "id", "needs", "at", with_path=False)).collect()}
    assert got == {"a": "READY", "b": "READY", "e": "READY", "c": "BLOCKED", "d": "BLOCKED", "x": "CYCLE", "y": "CYCLE", "z": "CYCLE"}
