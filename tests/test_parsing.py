"""Segments, structure and located phrases on written rows; communities; conversations."""

from pyspark.sql import functions as F

from quern.operators import parsing as p
from quern.operators.graph import propagated_labels
from quern.operators.stateful import conversation

TEXT = "QUYẾT ĐỊNH\r\nĐiều 1. Phạm vi\n1. Một.\na) Chữ a\nđ) Chữ đ\n2. Hai.\nĐiều 2. Hiệu lực\na) Lẻ\n\nPHỤ LỤC\n1. Bảng\nNơi nhận: ..."


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, i int")


def test_segments(spark):
    got = sorted((r.doc_id, r.segment, r.kind, r.n_lines) for r in p.segments(docs(spark, TEXT, None, "", "Chỉ một dòng"), "doc_id", "text").collect())
    assert got == [(0, 1, "PREAMBLE", 1), (0, 2, "MAIN_BODY", 7), (0, 3, "ANNEX", 2), (0, 4, "SIGNATURE", 1), (3, 1, "PREAMBLE", 1)]


def test_structure(spark):
    got = [(r.level, r.article, r.clause, r.point) for r in p.structure(docs(spark, TEXT, None, "1. Không có điều"), "doc_id", "text").orderBy("doc_id", "i").collect()]
    assert got == [
        ("ARTICLE", "1", None, None), ("CLAUSE", "1", "1", None), ("POINT", "1", "1", "a"), ("POINT", "1", "1", "đ"), ("CLAUSE", "1", "2", None),
        ("ARTICLE", "2", None, None), ("POINT", "2", None, "a"), ("CLAUSE", "2", "1", None),
    ]


def test_located(spark):
    df = spark.createDataFrame([(1, "a  Hợp\nđồng b", "hợp đồng"), (2, "x x", "x"), (3, "x", "y"), (4, None, "y"), (5, "x", None), (6, "x", " ")], "i int, t string, q string")
    assert {r.i: (r.status, r.start) for r in p.located(df, "t", "q").collect()} == {1: ("RESOLVED", 3), 2: ("AMBIGUOUS", None), 3: ("UNRESOLVED", None), 4: ("UNRESOLVED", None), 5: ("UNRESOLVED", None), 6: ("UNRESOLVED", None)}


def test_labels(spark):
    triangle = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "y"), ("z", "z")]
    got = {r.id: r.label for r in propagated_labels(spark.createDataFrame(triangle, "source string, target string"), 4).collect()}
    assert set(got) == {"a", "b", "c", "x", "y"}
    assert propagated_labels(spark.createDataFrame([], "source string, target string"), 2).count() == 0


def test_conversation(spark):
    rows = [("u", 1, "a"), ("u", 2, "b"), ("u", 3, "b"), ("u", 4, None), ("u", 5, "b"), ("v", 1, "a"), (None, 1, "a"), ("w", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, topic string")
    assert sorted(tuple(r) for r in conversation(df, "k", ["i"], "topic").collect()) == [("u", "b", 3, 1), ("v", "a", 1, 0)]
    long = spark.range(60).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.lit("t").alias("topic"))
    assert conversation(long, "k", ["i"], "topic", 20).first().n_turns == 20


def test_headings(spark):
    text = "PHẦN I\nChung\nChương II\nMục 1\nĐiều 3. Tên «x»\n1. a «\nĐiều 9. trích\n»\nMục 2\nChương III\nTên ba\nĐiều 4.\nPhần 2"
    df = spark.createDataFrame([("a", text, 1), ("a", text, 1), ("a", "Điều 1. B", 2), (None, "Điều 1.", 1), ("n", None, 1), ("e", "", 1), ("p", "văn bản", 1)], "id string, text string, i int")
    got = sorted((tuple(r) for r in p.headings(df, "id", "text").collect()), key=str)
    assert got == sorted([
        ("a", 0, "PART", "I", None, None, None, "Chung"), ("a", 2, "CHAPTER", "I", "II", None, None, ""), ("a", 3, "SECTION", "I", "II", "1", None, ""), ("a", 4, "ARTICLE", "I", "II", "1", "3", "Tên «x»"),
        ("a", 8, "SECTION", "I", "II", "2", None, ""), ("a", 9, "CHAPTER", "I", "III", None, None, "Tên ba"), ("a", 11, "ARTICLE", "I", "III", None, "4", ""), ("a", 12, "PART", "2", None, None, None, ""),
        ("a", 0, "ARTICLE", None, None, None, "1", "B"),
    ], key=str)
    assert p.headings(df.limit(0), "id", "text").count() == 0
