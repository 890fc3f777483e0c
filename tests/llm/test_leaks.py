"""Leaked test items against brute force over all runs of words."""

import random

import pytest

from quern.llm.leaks import GRAM, WINDOW, leaked_items, words

SHORTEST = GRAM + WINDOW - 1


def brute(docs, items):
    out = {}
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            best = 0
            run = [0] * (len(b) + 1)
            for x in a:
                run = [0, *[run[j] + 1 if x == y else 0 for j, y in enumerate(b)]]
                best = max(best, *run)
            if best >= SHORTEST and d is not None and i is not None:
                out[d, i] = best
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, task string")
    return {(r.doc_id, r.item_id): r.n_words for r in leaked_items(d, i, **kw).collect()}


def test_words():
    assert words("Người LAO-động, đi\nn​ăm 2020!") == ["nguoi", "lao", "dong", "di", "nam", "2020"]
    assert words(None) == [] == words(" .,")
    assert words("ệ ệ Đ") == ["e", "e", "d"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["lao", "động", "phải", "a", "b", "Có", "thể", "12"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 40))) for i in range(12)]
    docs = []
    for d in range(120):
        own = text(rnd.randrange(0, 60)).split()
        if d % 2:
            item = rnd.choice(items)[1].split()
            a = rnd.randrange(len(item))
            own[len(own) // 2 : len(own) // 2] = item[a : a + rnd.randrange(8, 20)]
        docs.append((d, ", ".join(own).upper() if d % 3 else "\n".join(own)))
    expected = brute(docs, items)
    assert expected
    assert found(spark, docs, items) == expected
    assert found(spark, docs, items, block=20) == expected


def test_boundary_lengths(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(n, "x " + " ".join(f"w{i}" for i in range(7, 7 + n)) + " y") for n in range(9, 16)]
    assert found(spark, docs, [(1, item)]) == {(n, 1): n for n in range(SHORTEST, 16)}


def test_run_does_not_cross_documents(spark):
    item = " ".join(f"w{i}" for i in range(24))
    docs = [(1, " ".join(f"w{i}" for i in range(11))), (2, " ".join(f"w{i}" for i in range(11, 22)))]
    assert found(spark, docs, [(1, item)]) == {}


def test_nulls_repeats_long_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "z " * 200_000 + item), (5, item + " " + item)]
    items = [(7, item), (7, item), (8, None), (None, item), (9, "")]
    assert found(spark, docs, items) == {(1, 7): 14, (4, 7): 14, (5, 7): 14}
    assert found(spark, [], items) == {} == found(spark, docs, [])
