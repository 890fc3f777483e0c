"""Required groups, anchors, unions, promotions and audits over questions and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dates import DATE_SQL, parse_date
from quern.operators import retrieval as r
from quern.operators import selection as s
from quern.plans.problems import SQL as PROBLEM_SQL
from quern.plans.problems import p7_found
from quern.plans.retrieval import _OV, _bm25_sql, _docs, _items, _overlap
from quern.session import checkpointed
from quern.sources.tables import table

#: Excerpts of a unit that a question may choose from, and how many it may keep.
EACH, LIMIT = 3, 4


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions", "query_id", "gold_unit_ids")
    return q.select("query_id", F.explode("gold_unit_ids").alias("group")).where("query_id IS NOT NULL AND group <> ''").distinct()


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """The EACH newest excerpts of each unit, chosen before any question is joined."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "recorded_at").where("unit_id <> ''").distinct()
    turn = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc_nulls_last("recorded_at"), F.desc("excerpt_id")))
    return g.withColumn("turn", turn).where(F.col("turn") <= EACH)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, rank, group): a question's excerpts, newest of each unit first."""
    return _wanted(spark, d).join(_newest(spark, d), F.col("group") == F.col("unit_id")).select("query_id", F.col("excerpt_id").alias("id"), F.col("turn").alias("rank"), "group")


def evidence_selected(spark: SparkSession, d: str) -> DataFrame:
    """At most four excerpts of each question: one of each required unit first, then by rank."""
    return s.prioritized(_candidates(spark, d)).where(F.col("place") <= LIMIT).select("query_id", F.col("id").alias("excerpt_id"), "place", "reason")


def evidence_unselected(spark: SparkSession, d: str) -> DataFrame:
    """Questions' excerpts by why they were kept or not: for a unit, by rank, or over the limit."""
    placed = s.prioritized(_candidates(spark, d))
    why = F.when(F.col("place") <= LIMIT, F.col("reason")).when(F.col("reason") == "GROUP", "GROUP_OVER_LIMIT").otherwise("OVER_LIMIT")
    return placed.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n_excerpts"), F.countDistinct("query_id").alias("n_questions"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts known at the question's date, ranked by age."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("excerpt_id"))
    return p7_found(spark, d).select("query_id", F.col("excerpt_id").alias("id"), rank.alias("rank"))


def evidence_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Two excerpts of each question: an anchor of each required unit first, then those known in time."""
    return s.retained(_known(spark, d), _candidates(spark, d), 2).withColumnRenamed("id", "excerpt_id")


def rank_union(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each item by BM25, then up to five more by shared terms."""
    a = r.bm25(_docs(spark, d), _items(spark, d), 10).select("query_id", F.col("doc_id").alias("id"), "rank")
    b = _overlap(spark, d, 10).select("query_id", F.col("doc_id").alias("id"), "rank")
    return s.union_lists(a, b, 5).withColumnRenamed("id", "doc_id")


def rank_promoted(spark: SparkSession, d: str) -> DataFrame:
    """BM25 results of each item, documents of the first one's number promoted behind it."""
    found = r.bm25(_docs(spark, d), _items(spark, d), 10).select("query_id", F.col("doc_id").alias("id"), "rank")
    n = table(spark, d, "documents", "doc_id", "document_number").where("document_number <> ''")
    seeds = found.where("rank = 1").select(F.col("id").alias("source")).distinct().join(n.select(F.col("doc_id").alias("source"), "document_number"), "source")
    # only documents that some query ranks can be promoted, so a number that a third of all share brings no more than those
    near = found.select(F.col("id").alias("target")).distinct().join(n.select(F.col("doc_id").alias("target"), "document_number"), "target")
    return s.promoted(found, seeds.join(near, "document_number"), 10).withColumnRenamed("id", "doc_id")


def _groups(spark: SparkSession, d: str, *rankings: DataFrame) -> DataFrame:
    """(query_id, group, id): the units of each question, and the ranked excerpts that serve them.

    Only ranked ids are looked up, each by itself: a unit with a third of all excerpts
    never meets all the questions that name it.
    """
    unit = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id").distinct().select(F.col("excerpt_id").alias("id"), F.col("unit_id").alias("group"))
    wanted = _wanted(spark, d)
    ranked = rankings[0].select("query_id", "id")
    for more in rankings[1:]:
        ranked = ranked.unionByName(more.select("query_id", "id"))
    serving = ranked.distinct().join(unit, "id").join(wanted, ["query_id", "group"]).select("query_id", "group", "id")
    return wanted.withColumn("id", F.lit(None).cast("long")).unionByName(serving)


def eval_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Group recall, novel precision, reciprocal rank and nDCG at 3: any of a unit's excerpts serves the unit."""
    known = _known(spark, d)
    return s.group_metrics(known, _groups(spark, d, known), 3)


def _channels_of_age(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of a question's units, by oldest and by newest excerpt known in time, and the units required."""
    known = p7_found(spark, d).select("query_id", F.col("unit_id").alias("id"), "excerpt_id")
    rank = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "id"))
    old, new = known.withColumn("rank", rank("excerpt_id")), known.withColumn("rank", rank(F.desc("excerpt_id")))
    channels = old.withColumn("channel", F.lit("old")).unionByName(new.withColumn("channel", F.lit("new")))
    return checkpointed(channels), _wanted(spark, d).withColumnRenamed("group", "id")


def eval_union_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's units that the first three of two rankings find together, and whether it is half at least."""
    return s.union_recall(*_channels_of_age(spark, d), 3, 0.5)


def eval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Questions by what anchors change against the excerpts known in time: group recall and reciprocal rank at 2."""
    known = checkpointed(_known(spark, d))
    kept = checkpointed(s.retained(known, _candidates(spark, d), 2).withColumnRenamed("place", "rank"))
    groups = checkpointed(_groups(spark, d, known, kept))
    before, after = s.group_metrics(known, groups, 2), s.group_metrics(kept, groups, 2)
    both = before.alias("b").join(after.alias("a"), "query_id")
    return both.groupBy(s.outcome([F.col("a.group_recall") - F.col("b.group_recall"), F.col("a.mrr") - F.col("b.mrr")]).alias("outcome")).agg(F.count(F.lit(1)).alias("n_questions"))


def eval_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of review status, kind and day of creation of questions that do not occur exactly once."""
    q = table(spark, d, "questions", "query_type", "review_status", "created_at").where("query_type IS NOT NULL AND review_status IS NOT NULL AND created_at IS NOT NULL")
    return s.schedule_faults(q.select("query_type", "review_status", F.date_format("created_at", "yyyy-MM-dd").alias("day")), ["query_type", "review_status", "day"])


def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    """Each excerpt with its ancestors before it, on one line: length and hash."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "ancestor_context", "source_text")
    whole = F.trim(F.regexp_replace(F.concat_ws(" ", "ancestor_context", "source_text"), r"\s+", " "))
    return g.select("excerpt_id", F.length(whole).cast("long").alias("n_chars"), F.md5(whole).alias("context_md5")).distinct()


def evidence_locators(spark: SparkSession, d: str) -> DataFrame:
    """Places (number, article, clause) and the units valid there on the day of each dated question: one, several or none.

    Places are those of the question's units; the versions of a place are counted per day and unit.
    """
    g = table(spark, d, "gold120_source_excerpts", "unit_id", "document_number", "article_number", "clause_number").where("unit_id <> '' AND document_number <> '' AND article_number <> ''")
    places = g.select("unit_id", F.concat_ws("|", "document_number", "article_number", F.coalesce("clause_number", F.lit(""))).alias("place")).distinct()
    units = places.groupBy("place").agg(F.countDistinct("unit_id").alias("n_units"), F.min("unit_id").alias("unit"))
    asked = _wanted(spark, d).join(places, F.col("group") == F.col("unit_id")).select("query_id", "place").distinct()
    status = F.when(F.col("n_units") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return asked.join(units, "place").select("query_id", "place", status.alias("status"), F.when(F.col("n_units") == 1, F.col("unit")).alias("unit_id"))


def text_resolved_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that documents cite and the documents they mean: RESOLVED (one), AMBIGUOUS (more) or MISSING.

    The document itself is none of its targets. Citing documents are counted, so a
    number that a third of them cites is one row.
    """
    docs = table(spark, d, "documents", "doc_id", "text", "document_number")
    cited = docs.where("text IS NOT NULL").select("doc_id", "document_number", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)))).alias("number"))
    cited = cited.where("document_number IS NULL OR number <> document_number").groupBy("number").agg(F.count(F.lit(1)).alias("n_citing"))
    held = docs.where("document_number <> ''").groupBy(F.col("document_number").alias("number")).agg(F.count(F.lit(1)).alias("n_held"), F.min("doc_id").alias("doc"))
    both = cited.join(held, "number", "left")
    status = F.when(F.col("n_held").isNull(), "MISSING").when(F.col("n_held") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return both.select("number", "n_citing", status.alias("status"), F.when(F.col("n_held") == 1, F.col("doc")).alias("doc_id"))


def temporal_relative_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What yesterday, this week, last month and the like mean on the day of each dated question."""
    days = table(spark, d, "questions", "query_date").select(parse_date(F.col("query_date")).alias("day")).where("day IS NOT NULL").distinct()
    return days.select("day", F.explode(F.array(*[F.struct(F.lit(k).alias("phrase"), a.alias("a"), b.alias("b")) for k, a, b in relative_ranges(F.col("day"))])).alias("x")).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "x.phrase", F.date_format("x.a", "yyyy-MM-dd").alias("start_date"), F.date_format("x.b", "yyyy-MM-dd").alias("end_date")
    )


def relative_ranges(day: Column) -> list[tuple]:
    """(phrase, first day, last day) of every relative phrase on a day."""
    out = [(phrase, F.date_add(day, n), F.date_add(day, n)) for phrase, n in RELATIVE_DAYS]
    week, month, year = F.trunc(day, "week"), F.trunc(day, "month"), F.trunc(day, "year")
    for phrase, n in RELATIVE_WEEKS:
        out.append((phrase, F.date_add(week, 7 * n), F.date_add(week, 7 * n + 6)))
    for phrase, n in RELATIVE_MONTHS:
        out.append((phrase, F.add_months(month, n), F.last_day(F.add_months(month, n))))
    for phrase, n in RELATIVE_YEARS:
        out.append((phrase, F.add_months(year, 12 * n), F.date_sub(F.add_months(year, 12 * n + 12), 1)))
    return out


# Phrases of relative time and how far they are from the day.
RELATIVE_DAYS = (("hôm kia", -2), ("hôm qua", -1), ("hôm nay", 0), ("ngày mai", 1))
RELATIVE_WEEKS = (("tuần trước", -1), ("tuần này", 0), ("tuần sau", 1))
RELATIVE_MONTHS = (("tháng trước", -1), ("tháng này", 0), ("tháng sau", 1))
RELATIVE_YEARS = (("năm ngoái", -1), ("năm nay", 0), ("năm sau", 1))
NUMBER = r"\d+/\d{4}/[A-ZĐ]+-[A-ZĐ]+"

QUERIES = {
    f.__name__: f
    for f in (
        evidence_selected, evidence_unselected, evidence_anchored, rank_union, rank_promoted, eval_group_metrics, eval_union_recall, eval_outcomes, eval_schedule,
        evidence_context, evidence_locators, text_resolved_numbers, temporal_relative_ranges,
    )
}

_WANT = "want AS (SELECT DISTINCT query_id, g FROM (SELECT query_id, unnest(gold_unit_ids) AS g FROM questions WHERE query_id IS NOT NULL) WHERE g <> '')"
_CAND = f"""{_WANT}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY recorded_at DESC NULLS LAST, excerpt_id DESC) AS turn FROM (SELECT DISTINCT excerpt_id, unit_id, recorded_at FROM gold120_source_excerpts WHERE unit_id <> '')) WHERE turn <= {EACH}),
 cand AS (SELECT query_id, excerpt_id AS id, turn AS rank, g FROM want JOIN newest ON g = unit_id)"""
_PRIO = f"""{_CAND}, firsts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, g ORDER BY rank, id) = 1 THEN g END AS f FROM cand),
 once AS (SELECT query_id, id, min(rank) AS rank, min(f) AS f FROM firsts GROUP BY 1, 2),
 prio AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f IS NULL, f, rank, id) AS place, CASE WHEN f IS NULL THEN 'RANK' ELSE 'GROUP' END AS reason FROM once)"""
_KNOWN = f"p7 AS ({PROBLEM_SQL['p7_found']}), known AS (SELECT query_id, excerpt_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY excerpt_id) AS rank FROM p7)"
_KEPT = f"""{_CAND}, {_KNOWN}, anch AS (SELECT query_id, id, min(g) AS g FROM (SELECT query_id, g, arg_min(id, struct_pack(r := rank, i := id)) AS id FROM cand GROUP BY 1, 2) GROUP BY 1, 2),
 kept AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY g IS NULL, g, k.rank, id) AS place, CASE WHEN k.rank IS NULL THEN 'ANCHOR' ELSE 'ITEM' END AS origin FROM known k FULL JOIN anch USING (query_id, id)) WHERE place <= 2)"""
_GROUPS = "grp AS (SELECT DISTINCT query_id, g, excerpt_id AS id FROM want LEFT JOIN gold120_source_excerpts ON g = unit_id), mem AS (SELECT query_id, id, max(g) AS g FROM grp WHERE id IS NOT NULL GROUP BY 1, 2), tot AS (SELECT query_id, count(DISTINCT g) AS n FROM grp GROUP BY 1)"


def _metrics_sql(name: str, ranking: str, rank: str, k: int) -> str:
    """Common table expression ``name`` of the group metrics of a ranking; mem and tot must be there."""
    return f"""{name}h AS (SELECT query_id, count(*) AS h, min(r) AS b, sum(1 / log2(r + 1)) AS dcg FROM (SELECT query_id, g, min({rank}) AS r FROM {ranking} JOIN mem USING (query_id, id) WHERE {rank} <= {k} GROUP BY 1, 2) GROUP BY 1),
 {name} AS (SELECT query_id, round(coalesce(h / n, 0), 6) AS group_recall, round(coalesce(h / {k}, 0), 6) AS novel_precision, round(coalesce(1 / b, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, CAST(least(n, {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS group_ndcg, coalesce(h, 0) = n AS all_found FROM tot LEFT JOIN {name}h USING (query_id))"""


_DAY = f"(SELECT DISTINCT {DATE_SQL.format(c='query_date')} AS day FROM questions)"
_BM = _bm25_sql("", "text")
SQL = {
    "evidence_selected": f"WITH {_PRIO} SELECT query_id, id AS excerpt_id, place, reason FROM prio WHERE place <= {LIMIT}",
    "evidence_unselected": f"WITH {_PRIO} SELECT CASE WHEN place <= {LIMIT} THEN reason WHEN reason = 'GROUP' THEN 'GROUP_OVER_LIMIT' ELSE 'OVER_LIMIT' END AS outcome, count(*) AS n_excerpts, count(DISTINCT query_id) AS n_questions FROM prio GROUP BY 1",
    "evidence_anchored": f"WITH {_KEPT} SELECT query_id, id AS excerpt_id, place, origin FROM kept",
    "rank_union": f"""WITH {_BM}, {_OV}, a AS (SELECT query_id, doc_id, rank, 'BASE' AS origin FROM bm WHERE rank <= 10), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS m FROM ov WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = ov.query_id AND a.doc_id = ov.doc_id)),
 u AS (SELECT query_id, doc_id, rank, origin FROM a UNION ALL SELECT query_id, doc_id, rank, 'ADDED' FROM n WHERE m <= 5) SELECT query_id, doc_id, origin, row_number() OVER (PARTITION BY query_id ORDER BY origin DESC, rank, doc_id) AS rank FROM u""",
    "rank_promoted": f"""WITH {_BM}, a AS (SELECT query_id, b.doc_id, rank, document_number AS nr FROM bm b JOIN documents d ON b.doc_id = d.doc_id WHERE rank <= 10), l AS (SELECT a.*, coalesce(a.rank > 1 AND a.nr <> '' AND a.nr = f.nr, false) AS linked FROM a JOIN a f ON a.query_id = f.query_id AND f.rank = 1),
 m AS (SELECT *, CASE WHEN rank = 1 THEN 0 WHEN linked AND sum(CAST(linked AS INT)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 5 THEN 1 ELSE 2 END AS tier FROM l) SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS new_rank FROM m""",
    "eval_group_metrics": f"WITH {_WANT}, {_KNOWN}, {_GROUPS}, {_metrics_sql('gm', 'known', 'rank', 3)} SELECT * FROM gm",
    "eval_union_recall": f"""WITH {_WANT}, p7 AS ({PROBLEM_SQL['p7_found']}), f AS (SELECT DISTINCT query_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY excerpt_id, unit_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY excerpt_id DESC, unit_id) AS b FROM p7) WHERE a <= 3 OR b <= 3)
 SELECT w.query_id, count(*) AS n_relevant, count(f.unit_id) AS n_found, round(count(f.unit_id) / count(*), 6) AS recall, round(count(f.unit_id) / count(*), 6) >= 0.5 AS passed FROM want w LEFT JOIN f ON w.query_id = f.query_id AND w.g = f.unit_id GROUP BY 1""",
    "eval_outcomes": f"""WITH {_KEPT}, {_GROUPS}, {_metrics_sql('b', 'known', 'rank', 2)}, {_metrics_sql('a', 'kept', 'place', 2)}, d AS (SELECT a.group_recall - b.group_recall AS x, a.mrr - b.mrr AS y FROM a JOIN b USING (query_id))
 SELECT CASE WHEN (x > 1e-12 OR y > 1e-12) AND (x < -1e-12 OR y < -1e-12) THEN 'MIXED' WHEN x > 1e-12 OR y > 1e-12 THEN 'IMPROVED' WHEN x < -1e-12 OR y < -1e-12 THEN 'HARMED' ELSE 'UNCHANGED' END AS outcome, count(*) AS n_questions FROM d GROUP BY 1""",
    "eval_schedule": """WITH q AS (SELECT query_type, review_status, strftime(created_at, '%Y-%m-%d') AS day FROM questions WHERE query_type IS NOT NULL AND review_status IS NOT NULL AND created_at IS NOT NULL), x AS (SELECT * FROM (SELECT DISTINCT query_type FROM q), (SELECT DISTINCT review_status FROM q), (SELECT DISTINCT day FROM q)),
 c AS (SELECT query_type, review_status, day, count(*) AS n FROM q GROUP BY 1, 2, 3) SELECT query_type, review_status, day, coalesce(n, 0) AS n FROM x LEFT JOIN c USING (query_type, review_status, day) WHERE coalesce(n, 0) <> 1""",
    "evidence_context": r"WITH w AS (SELECT excerpt_id, trim(regexp_replace(concat_ws(' ', ancestor_context, source_text), '\s+', ' ', 'g'), ' ') AS t FROM gold120_source_excerpts) SELECT DISTINCT excerpt_id, length(t) AS n_chars, md5(t) AS context_md5 FROM w",
    "evidence_locators": f"""WITH {_WANT}, pl AS (SELECT DISTINCT unit_id, concat_ws('|', document_number, article_number, coalesce(clause_number, '')) AS place FROM gold120_source_excerpts WHERE unit_id <> '' AND document_number <> '' AND article_number <> ''), u AS (SELECT place, count(DISTINCT unit_id) AS n, min(unit_id) AS unit FROM pl GROUP BY 1)
 SELECT DISTINCT query_id, place, CASE WHEN n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN unit END AS unit_id FROM want JOIN pl ON g = pl.unit_id JOIN u USING (place)""",
    "text_resolved_numbers": rf"""WITH c AS (SELECT number, count(*) AS n_citing FROM (SELECT document_number, unnest(list_distinct(regexp_extract_all(text, '{NUMBER}'))) AS number FROM documents WHERE text IS NOT NULL) WHERE document_number IS NULL OR number <> document_number GROUP BY 1), h AS (SELECT document_number AS number, count(*) AS k, min(doc_id) AS doc FROM documents WHERE document_number <> '' GROUP BY 1)
 SELECT number, n_citing, CASE WHEN k IS NULL THEN 'MISSING' WHEN k = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN k = 1 THEN doc END AS doc_id FROM c LEFT JOIN h USING (number)""",
    "temporal_relative_ranges": "WITH d AS (SELECT * FROM " + _DAY + " WHERE day IS NOT NULL), x AS ("
    + " UNION ALL ".join(
        [f"SELECT day, '{k}' AS phrase, day + {n} AS a, day + {n} AS b FROM d" for k, n in RELATIVE_DAYS]
        + [f"SELECT day, '{k}', CAST(date_trunc('week', day) AS DATE) + {7 * n}, CAST(date_trunc('week', day) AS DATE) + {7 * n + 6} FROM d" for k, n in RELATIVE_WEEKS]
        + [f"SELECT day, '{k}', CAST(date_trunc('month', day) + INTERVAL ({n}) MONTH AS DATE), CAST(date_trunc('month', day) + INTERVAL ({n + 1}) MONTH AS DATE) - 1 FROM d" for k, n in RELATIVE_MONTHS]
        + [f"SELECT day, '{k}', CAST(date_trunc('year', day) + INTERVAL ({n}) YEAR AS DATE), CAST(date_trunc('year', day) + INTERVAL ({n + 1}) YEAR AS DATE) - 1 FROM d" for k, n in RELATIVE_YEARS]
    )
    + ") SELECT strftime(day, '%Y-%m-%d') AS day, phrase, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date FROM x",
}
