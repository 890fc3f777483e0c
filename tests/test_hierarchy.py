"""Hierarchies against a walk in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators.hierarchy import CYCLE, descendants, hierarchy

SCHEMA = "id string, parent string, position int, at long, node string, size string, jump string"


def walked(rows):
    """id -> (root, depth, path) by following parents."""
    latest = {}
    for r in rows:
        if r[0] is not None:
            key = (r[3] if r[3] is not None else -1, r[1] or "", r[2] if r[2] is not None else -1)
            if r[0] not in latest or key > latest[r[0]][0]:
                latest[r[0]] = (key, r[1])
    out = {}
    for n in latest:
        path, seen, at = [n], {n}, n
        while True:
            p = latest[at][1]
            if not p or p not in latest:
                out[n] = (at, len(path) - 1, "/".join(reversed(path)))
                break
            if p in seen:
                out[n] = (CYCLE, -1, None)
                break
            seen.add(p)
            path.append(p)
            at = p
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return hierarchy(df, "id", "parent", "at", "position")


def check(spark, rows):
    nodes = run(spark, rows).cache()
    got = {r.node: (r.root, r.depth, r.path) for r in nodes.collect()}
    assert got == walked(rows)
    pairs = {(r.ancestor, r.descendant): r.distance for r in descendants(nodes).collect()}
    expected = {}
    for n, (_, depth, path) in got.items():
        if depth > 0:
            for i, a in enumerate(path.split("/")[:-1]):
                expected[a, n] = depth - i
    assert pairs == expected
    return nodes


def test_small_tree_order_and_ranges(spark):
    rows = [("r", None, 1, 1), ("b", "r", 2, 1), ("a", "r", 1, 1), ("a2", "a", 1, 1), ("q", "", 1, 1), ("o", "gone", 1, 1)]
    nodes = check(spark, rows)
    got = {r.node: (r.preorder, r.size) for r in nodes.collect()}
    assert got == {"r": (0, 4), "a": (1, 2), "a2": (2, 1), "b": (3, 1), "q": (0, 1), "o": (0, 1)}


def test_circles_and_below(spark):
    rows = [("a", "b", 1, 1), ("b", "a", 1, 1), ("c", "b", 1, 1), ("d", "c", 1, 1), ("self", "self", 1, 1), ("ok", None, 1, 1), ("kid", "ok", 1, 1)]
    check(spark, rows)


def test_latest_row_counts_and_repeats(spark):
    rows = [("x", "r", 1, 1), ("x", "s", 1, 5), ("x", "s", 1, 5), ("r", None, 1, 1), ("s", None, 1, 1), ("x", "r", 1, None), (None, "r", 1, 9), ("t", "r", None, 1)]
    check(spark, rows)


def test_ties_in_time_are_settled_the_same(spark):
    rows = [("x", "r", 1, 1), ("x", "s", 1, 1), ("r", None, 1, 1), ("s", None, 1, 1)]
    assert {r.root for r in run(spark, rows).where("node = 'x'").collect()} == {"s"}
    assert {r.root for r in run(spark, rows[::-1]).where("node = 'x'").collect()} == {"s"}


def test_empty(spark):
    assert run(spark, []).count() == 0
    assert descendants(run(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        parent = rnd.choice([None, "", "gone", *[f"n{rnd.randrange(300)}" for _ in range(12)]]) if rnd.random() < 0.1 else f"n{rnd.randrange(i)}" if i else None
        rows.append((f"n{i}", parent, rnd.choice([None, 1, 2, 3]), rnd.choice([None, 1, 2])))
    check(spark, rows + rnd.sample(rows, 30))


def test_long_chain_and_wide_parent(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, 1, 1) for i in range(130)] + [(f"w{i}", "c0", 1, 1) for i in range(400)]
    nodes = run(spark, rows)
    deep = nodes.where("node = 'c129'").first()
    assert (deep.root, deep.depth) == ("c0", 129)
    pre = sorted(r.preorder for r in nodes.collect())
    assert pre == list(range(530))
    assert nodes.agg(F.max("size")).first()[0] == 530
