"""Intervals, orphans and as-of joins against brute force."""

import datetime as dt
import random

import pytest

from quern.functions.dates import parse_date
from quern.operators.asof import as_known
from quern.operators.intervals import periods_and_gaps
from quern.operators.references import live_runs, orphans, reference_rows
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "text,day",
    [("2020-02-29", "2020-02-29"), ("29/02/2020", "2020-02-29"), ("1/2/2020", "2020-02-01"), ("2020-02-31", None), ("31/02/2020", None), ("2021-13-05", None), ("", None), ("  ", None), (None, None), ("hôm qua", None), (" 2020-01-05 ", "2020-01-05"), ("2020", None)],
)
def test_parse_date(spark, text, day):
    got = spark.createDataFrame([(text,)], "x string").select(parse_date(F.col("x")).cast("string")).first()[0]
    assert got == day


def intervals(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "u string, a string, b string, kind string, __start int")
    return sorted(tuple(r) for r in periods_and_gaps(df, "u", "a", "b").collect())


def test_periods_touch_nest_and_gap(spark):
    rows = [("u", "2020-01-01", "2020-02-01"), ("u", "01/02/2020", "2020-03-01"), ("u", "2020-01-10", "2020-01-12"), ("u", "2020-05-01", None), ("u", "2020-06-01", "2020-07-01")]
    assert intervals(spark, rows + rows) == [("u", "GAP", "2020-03-01", "2020-05-01"), ("u", "PERIOD", "2020-01-01", "2020-03-01"), ("u", "PERIOD", "2020-05-01", "")]


def test_unusable_intervals_are_left_out(spark):
    rows = [("u", None, None), ("u", "", "2020-01-01"), ("u", "2020-02-30", None), ("u", "2020-01-01", "x"), ("u", "2020-01-05", "2020-01-05"), ("u", "2020-01-05", "2020-01-01"), (None, "2020-01-01", None), ("v", "2020-01-01", " ")]
    assert intervals(spark, rows) == [("v", "PERIOD", "2020-01-01", "")]
    assert intervals(spark, []) == []


def test_random_intervals(spark):
    rnd = random.Random(3)
    day = lambda n: (dt.date(2020, 1, 1) + dt.timedelta(n)).isoformat()
    rows, covered = [], {}
    for _ in range(300):
        u, a, n = rnd.choice("abc"), rnd.randrange(700), rnd.randrange(1, 12)
        rows.append((u, day(a), day(a + n)))
        covered.setdefault(u, set()).update(range(a, a + n))
    expected = []
    for u, days in covered.items():
        starts = sorted(d for d in days if d - 1 not in days)
        ends = sorted(d + 1 for d in days if d + 1 not in days)
        expected += [(u, "PERIOD", day(a), day(b)) for a, b in zip(starts, ends, strict=True)] + [(u, "GAP", day(a), day(b)) for a, b in zip(ends, starts[1:], strict=False)]
    assert intervals(spark, rows) == sorted(expected)


T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def test_orphans(spark):
    parents = [("k", T0, T0 + 2 * H), ("k", T0 + 5 * H, None), ("m", T0, None), ("m", T0, None), (None, T0, None), ("", T0, None), ("n", None, None), ("z", T0 + H, T0 + H)]
    refs = [
        ("live", "k", T0 + H), ("edge", "k", T0), ("gone", "k", T0 + 2 * H), ("between", "k", T0 + 3 * H), ("again", "k", T0 + 6 * H), ("early", "k", T0 - H), ("missing", "q", T0), ("null", None, T0), ("empty", "", T0),
        ("ok", "m", T0 + H), ("ok", "m", T0 + H), ("gone", "k", T0 + 2 * H), ("untimed", "q", None), ("never", "n", T0), ("zero", "z", T0 + H), (None, "q", T0),
    ]
    got = {(r[1], r[2]) for r in lost(spark, refs, parents)}
    assert got == {("2024-01", x) for x in ("gone", "between", "missing", "never", "zero", None)} | {("2023-12", "early")}
    assert len(lost(spark, refs, parents)) == len(got)
    assert lost(spark, [], parents) == []
    assert {r[2] for r in lost(spark, refs[:2], [])} == {"live", "edge"}


def lost(spark, refs, parents):
    r = spark.createDataFrame([(i, k, t, "x") for i, k, t in refs], "id string, ref string, t timestamp, key string")
    p = spark.createDataFrame([(*x, "y") for x in parents], "pk string, a timestamp, b timestamp, first string")
    found = orphans(reference_rows(r, "refs", "id", "ref", "t"), live_runs(p, "pk", "a", "b"))
    return [(x.table_name, x.ref_month, x.row_key) for x in found.collect()]


def test_random_orphans_with_a_hot_key(spark):
    rnd = random.Random(5)
    parents = [(f"k{rnd.randrange(6)}", T0 + H * (a := rnd.randrange(100)), None if rnd.random() < 0.2 else T0 + H * (a + rnd.randrange(0, 30))) for _ in range(30)]
    refs = [(f"r{i}", "k0" if rnd.random() < 0.5 else f"k{rnd.randrange(8)}", T0 + H * rnd.randrange(120)) for i in range(400)]
    expected = {i for i, k, t in refs if not any(p == k and a <= t and (b is None or t < b) for p, a, b in parents)}
    assert {r[2] for r in lost(spark, refs, parents)} == expected


def known(spark, events, versions, shard_rows):
    e = spark.createDataFrame([(*x, 1) for x in events], "entity string, event string, day int, version int")
    v = spark.createDataFrame([(*x, "s") for x in versions], "entity string, version long, start int, end int, known_day int, known long, event string")
    return sorted(tuple(r) for r in as_known(e, v, shard_rows).collect())


def brute(events, versions):
    out = set()
    for entity, event, day in events:
        ok = [(s, k, v) for e, v, s, t, kd, k in versions if e == entity and None not in (e, v, s, t, kd, k, entity, event, day) and s <= day < t and kd <= day]
        if ok:
            out.add((entity, event, max(ok)[2]))
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [5, 40, 100_000])
def test_as_known_random(spark, shard_rows):
    rnd = random.Random(shard_rows)
    versions = [(rnd.choice("aaab"), i % 50, s := rnd.randrange(200), s + rnd.choice([1, 5, 40, 500]), kd := s + rnd.randrange(-20, 30), kd * 10 + rnd.randrange(3)) for i in range(120)]
    events = [(rnd.choice("aaabc"), f"e{i % 90}", rnd.randrange(260)) for i in range(200)]
    once = {}
    for e in events:
        once[e[0], e[1]] = e
    events = list(once.values())
    assert known(spark, events + events[:20], versions + versions[:9], shard_rows) == brute(events, versions)


def test_as_known_nulls_ties_and_empty(spark):
    versions = [("a", 1, 0, 10, 0, 5), ("a", 2, 0, 10, 0, 5), ("a", None, 3, 9, 3, 3), (None, 4, 0, 9, 0, 0), ("a", 5, None, 9, 0, 0)]
    events = [("a", "x", 4), ("a", "y", 10), (None, "z", 4), ("a", None, 4), ("a", "w", None)]
    assert known(spark, events, versions, 100) == [("a", "x", 2)]
    assert known(spark, [], versions, 100) == [] == known(spark, events, [], 100)
