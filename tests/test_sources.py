"""Files in and out, and the streaming forms."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import files
from quern.streaming import events as s


def test_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.TXT").write_text("x")
    (tmp_path / "two.html").write_text("y")
    (tmp_path / "two.meta.json").write_text("{}")
    (tmp_path / "three.exe").write_text("z")
    got = files.manifest(spark, f"file:{tmp_path}").collect()
    assert sorted((r.relative_path, r.extension, r.size_bytes) for r in got) == [("a/one.TXT", "txt", 1), ("two.html", "html", 1)]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n[1]\n{"a": 2}\n{broken\n{"a": 3, "b": "' + "y" * 100 + '"}\n')
    good, bad = files.read_jsonl(spark, str(p), T.StructType().add("a", T.IntegerType()).add("b", T.StringType()), 80)
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x"), (2, None)]
    assert sorted(r.reason for r in bad.collect()) == ["NO_OBJECT", "NO_OBJECT", "TOO_LONG"]


def test_visible_text(spark):
    raw = "<html><head><title>t</title></head><body><nav>menu</nav><p>Một &amp; hai</p><script>x()</script><div>ba<br>bốn</div></body></html>"
    df = spark.createDataFrame([(1, raw), (2, None), (3, "")], "id long, html string")
    assert [r.text for r in files.visible_texts(df, "id", "html").orderBy("id").collect()] == ["Một & hai\nba\nbốn", None, ""]


def test_write_new_writes_once(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "out")
    assert files.write_new(df, path, ["id"], "s1") == 5
    assert files.write_new(spark.range(7).withColumn("v", F.col("id") * 2), path, ["id"], "s1") == 2
    assert files.write_new(df, path, ["id"], "s2") == 5


def test_csv_and_bounded(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, l array<string>")
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first().l == '["a","b"]'.replace('"', '"')
    assert files.bounded(df, None)[1] == "FULL_SCAN" and files.bounded(df, 1)[1] == "BOUNDED_SCAN"


def drained(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_streaming(spark, tmp_path):
    rows = [("u", i * 5, "a" if i < 9 else "b", i) for i in range(14)] + [("v", 3, None, 20), (None, 4, "a", 21)]
    src = spark.createDataFrame(rows, "k string, s int, topic string, i int").withColumn("ts", F.timestamp_seconds("s"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    hours = drained(spark, s.tumbling(stream(), "ts", "k"), "update", "hours", tmp_path)
    assert sorted((k or "", n) for k, _, n in hours) == [("", 1), ("u", 14), ("v", 1)]
    over = drained(spark, s.rate_exceeded(stream(), "ts", "k", 11), "update", "over", tmp_path)
    assert {k for k, _, _ in over} == {"u"} and max(n for _, _, n in over) == 12
    first = drained(spark, s.first_requests(stream(), "ts", ["k"]), "append", "first", tmp_path)
    assert len(first) == 3
    folded = drained(spark, s.folded_state(stream(), "k", "ts", "topic"), "update", "folded", tmp_path)
    assert ("u", 5, "b", 1) in folded and ("v", 0, None, 0) in folded
