"""Whole graphs of the registered queries against brute force."""

from collections import Counter

import numpy as np

from quern.operators.graph import communities
from quern.plans import graph as g
from quern.sources.tables import table


def test_every_vector_is_asked(spark, data):
    e = {r.vec_id: r.embedding for r in table(spark, data, "embeddings", "vec_id", "embedding").collect() if r.embedding}
    ids = np.array(sorted(e))
    x = np.array([e[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = set()
    for n, i in enumerate(ids):
        s = np.round(x @ x[n], 6)
        s[n] = -9
        expected |= {(int(i), int(ids[m])) for m in np.lexsort((ids, -s))[:5] if i < ids[m]}
    assert {(r.source, r.target) for r in g.graph_neighbours(spark, data).collect()} == expected


def test_communities_are_stable(spark):
    star, path = [(f"p{i}", "p") for i in range(4)], [(f"a{i:02}", f"a{i + 1:02}") for i in range(14)]
    edges = [*star, *path, ("x", "y"), ("z", "z"), *[(a, b) for a in "bcde" for b in "bcde"]]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    states = [{a: a for a in near}]
    while states[-1] not in states[:-1]:
        votes = {a: Counter(states[-1][b] for b in near[a]) for a in near}
        states.append({a: min(v, key=lambda x: (-v[x], x)) for a, v in votes.items()})
    assert len(states) > 6
    cycle = states[states.index(states[-1]) : -1]
    label = {a: min(s[a] for s in cycle) for a in near}
    expected = {a: x for a, x in label.items() if Counter(label.values())[x] >= 3}
    assert "x" not in expected and len({expected[a] for a in ("p", "p0", "p3")}) == 1
    assert {r.id: r.label for r in communities(spark.createDataFrame(edges, "source string, target string")).collect()} == expected
    assert communities(spark.createDataFrame([], "source string, target string")).count() == 0
