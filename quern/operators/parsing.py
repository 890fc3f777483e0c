"""Structure of texts from their lines: segments, articles, clauses and points, located phrases.

Windows here run over the lines of one text, so a group is as large as a text and
no larger; texts are spread over tasks by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a line looks like that opens a segment or a level.
SEGMENTS = (("MAIN_BODY", r"^Điều \d+\."), ("ANNEX", r"^(?:PHỤ LỤC|Phụ lục)\b"), ("FINDINGS", r"^NHẬN ĐỊNH"), ("ANSWER", r"^Đáp:"), ("SIGNATURE", r"^Nơi nhận"))
ARTICLE, CLAUSE, POINT = r"^Điều (\d+)\.", r"^(\d+)\. ", r"^([a-zđ])\) "
#: Levels above the clause, widest first, and the line that opens one.
HEADINGS = (("PART", r"^(?:Phần|PHẦN) (?:thứ )?([IVXLC]+|[0-9]+)\b"), ("CHAPTER", r"^(?:Chương|CHƯƠNG) ([IVXLC]+|[0-9]+)\b"), ("SECTION", r"^(?:Mục|MỤC) ([0-9]+)\b"), ("ARTICLE", r"^Điều ([0-9]+)\."))
ANY_HEADING = r"^(?:Phần|PHẦN|Chương|CHƯƠNG|Mục|MỤC|Điều) "


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, line): the lines of each text, trimmed, empty ones left out; i counts from 0. NULL texts have none."""
    cut = F.filter(F.transform(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(cut).alias("i", "line"))


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, segment, kind, first_line, n_lines, n_chars): runs of lines, from each opening line to the next of another kind.

    Lines before the first opening are the PREAMBLE.
    """
    opened = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in SEGMENTS])
    by_line = Window.partitionBy(key).orderBy("i")
    kinds = lines(docs, key, text).withColumn("kind", F.coalesce(F.last(opened, ignorenulls=True).over(by_line), F.lit("PREAMBLE")))
    starts = kinds.withColumn("new", F.when(F.col("kind") == F.lag("kind").over(by_line), 0).otherwise(1))
    runs = starts.withColumn("segment", F.sum("new").over(by_line))
    return runs.groupBy(key, "segment", "kind").agg(F.min("i").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def structure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, level, article, clause, point): the lines that open an article, a clause or a point, with what they lie in.

    A clause belongs to the article before it, a point to the clause before it in the
    same article. Clauses and points before any article are left out.
    """
    number = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    rows = lines(docs, key, text).withColumn("a", number(ARTICLE)).withColumn("c", number(CLAUSE)).withColumn("p", number(POINT))
    by_line = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("article_at", F.max(F.when(F.col("a").isNotNull(), F.col("i"))).over(by_line)).withColumn("article", F.last("a", ignorenulls=True).over(by_line))
    rows = rows.withColumn("clause_at", F.max(F.when(F.col("c").isNotNull(), F.col("i"))).over(by_line)).withColumn("last_clause", F.last("c", ignorenulls=True).over(by_line))
    clause = F.when(F.col("clause_at") > F.col("article_at"), F.col("last_clause"))
    level = F.when(F.col("a").isNotNull(), "ARTICLE").when(F.col("c").isNotNull(), "CLAUSE").when(F.col("p").isNotNull(), "POINT")
    return rows.withColumn("level", level).where("level IS NOT NULL AND article IS NOT NULL").select(key, "i", "level", "article", F.when(F.col("level") != "ARTICLE", clause).alias("clause"), F.when(F.col("level") == "POINT", F.col("p")).alias("point"))


def located(rows: DataFrame, text: str, phrase: str) -> DataFrame:
    """``rows`` with ``status`` and ``start``: RESOLVED where the phrase occurs once, AMBIGUOUS where more often.

    Spaces and line ends are one, letter case does not count. ``start`` is the place
    in the text with collapsed spaces, from 1, of a RESOLVED phrase. An empty or NULL
    phrase or text is UNRESOLVED.
    """
    even = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    both = rows.withColumn("__t", F.coalesce(even(text), F.lit(""))).withColumn("__p", F.coalesce(even(phrase), F.lit("")))
    times = F.when(F.col("__p") == "", 0).otherwise((F.length("__t") - F.length(F.replace("__t", "__p", F.lit("")))) / F.greatest(F.length("__p"), F.lit(1)))
    status = F.when(times == 1, "RESOLVED").when(times > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return both.withColumn("status", status).withColumn("start", F.when(F.col("status") == "RESOLVED", F.expr("instr(__t, __p)"))).drop("__t", "__p")


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, level, part, chapter, section, article, title): lines that open a level above the clause, with what they lie in.

    A level ends where a wider one opens. The title of an article stands in its line,
    that of a wider level in the next one. Lines within quotation marks that an earlier
    line opened are quoted law and open nothing. Repeated rows count once,
    rows of one key with different texts are told apart by a hash.
    """
    rows = lines(docs.where(F.col(key).isNotNull()).withColumn("__k", F.struct(key, F.md5(text).alias("__h"))), "__k", text).dropDuplicates(["__k", "i"])
    names = [k.lower() for k, _ in HEADINGS]
    rows = rows.withColumns({n: F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for n, (_, p) in zip(names, HEADINGS, strict=True)})
    by_line = Window.partitionBy("__k").orderBy("i")
    marks = F.length(F.regexp_replace("line", "[^“«]", "")) - F.length(F.regexp_replace("line", "[^”»]", ""))
    rows = rows.withColumn("next", F.lead("line").over(by_line)).withColumn("depth", F.coalesce(F.sum(marks).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("depth <= 0")
    level = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n.upper())) for n in names])
    up_to = by_line.rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("level", level).withColumns({f"at_{n}": F.max(F.when(F.col(n).isNotNull(), F.col("i"))).over(up_to) for n in names} | {f"in_{n}": F.last(n, ignorenulls=True).over(up_to) for n in names})
    inside = {}
    for n, name in enumerate(names):
        open_still = F.lit(True)
        for wider in names[:n]:
            open_still = open_still & (F.col(f"at_{wider}").isNull() | (F.col(f"at_{wider}") <= F.col(f"at_{name}")))
        inside[name] = F.when(open_still, F.col(f"in_{name}"))
    title = F.when(F.col("level") == "ARTICLE", F.trim(F.regexp_replace("line", HEADINGS[-1][1], ""))).when(F.col("next").isNull() | F.col("next").rlike(ANY_HEADING), "").otherwise(F.col("next"))
    return seen.where("level IS NOT NULL").select(F.col("__k")[key].alias(key), "i", "level", *[v.alias(k) for k, v in inside.items()], title.alias("title"))
