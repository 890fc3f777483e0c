"""Ranking, evidence and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions.dates import DATE_SQL, parse_date
from quern.operators import evidence
from quern.operators import retrieval as r
from quern.operators.intervals import usable_intervals
from quern.plans.problems import SQL as PROBLEM_SQL
from quern.plans.problems import p7_found
from quern.sources.tables import table

WEIGHTS = {"bm25": 1.0, "terms": 0.5, "titles": 0.25}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "text").distinct().withColumnRenamed("item_id", "query_id")


def rank_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each evaluation item by BM25."""
    return r.bm25(_docs(spark, d), _items(spark, d), 10)


def _overlap(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k documents that hold the greatest share of an item's folded terms."""
    docs = _docs(spark, d).where("text IS NOT NULL").select("doc_id", t.terms(F.col("text")).alias("w"))
    return r.overlap(docs, _items(spark, d).select("query_id", t.terms(F.col("text")).alias("terms")), k)


def rank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each item by shared terms."""
    return _overlap(spark, d, 10)


def rank_dense(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth vector, exact."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return r.dense(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over texts, shared terms of texts, BM25 over titles: the thirty best of each."""
    items = _items(spark, d)
    titles = table(spark, d, "documents", "doc_id", "title").withColumnRenamed("title", "text")
    found = {"bm25": r.bm25(_docs(spark, d), items, 30), "terms": _overlap(spark, d, 30), "titles": r.bm25(titles, items, 30)}
    out = None
    for name, one in found.items():
        rows = one.select("query_id", F.lit(name).alias("channel"), F.col("doc_id").alias("id"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def rank_fused(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of texts and titles and shared terms fused by weighted reciprocal ranks."""
    return r.fuse(_channels(spark, d), WEIGHTS).where("rank <= 10").select("query_id", F.col("id").alias("doc_id"), "score", "best_rank", "rank")


def rank_blended(spark: SparkSession, d: str) -> DataFrame:
    """BM25 results ordered anew with a bonus for documents that carry a number."""
    found = r.bm25(_docs(spark, d), _items(spark, d), 20)
    bonus = table(spark, d, "documents", "doc_id", "document_number").select("doc_id", F.col("document_number").isNotNull().cast("int").alias("official"))
    both = found.join(bonus, "doc_id")
    return r.linear_rerank(both, "query_id", "score", [("official", 0.2)], 0.75, "doc_id").where("new_rank <= 10").select("query_id", "doc_id", "blend", "new_rank")


def rank_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For the place of each excerpt (number, article, clause) the five newest excerpts there, an empty clause left out."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "document_number", "article_number", "clause_number", "recorded_at").distinct()
    index = g.select(F.col("excerpt_id").alias("id"), F.col("document_number").alias("number"), F.col("article_number").alias("article"), F.col("clause_number").alias("clause"), "recorded_at")
    asked = index.select(F.col("id").alias("query_id"), "number", "article", F.nullif("clause", F.lit("")).alias("clause"))
    return r.look_up(asked, index, ["number", "article", "clause"], ["recorded_at"], 5).select("query_id", F.col("id").alias("excerpt_id"), "rank", "level")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "source_text", "valid_from", "valid_to").distinct()
    return usable_intervals(g, "valid_from", "valid_to")


def evidence_deduped(spark: SparkSession, d: str) -> DataFrame:
    """One excerpt per unit and start of validity, then one per unit and equal text."""
    g = _versions(spark, d).withColumn("same", F.md5(F.coalesce(F.lower(F.regexp_replace("source_text", r"\s+", " ")), F.lit("")))).select("excerpt_id", "unit_id", "__start", "same")
    return evidence.dedupe(g, ["unit_id", "__start"], ["unit_id", "same"], ["excerpt_id"]).select("excerpt_id", "unit_id")


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions", "query_id", "gold_unit_ids").distinct()
    return q.select("query_id", F.explode(F.array_distinct("gold_unit_ids")).alias("group"))


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Units that a question requires, and those of them that the excerpts know."""
    known = table(spark, d, "gold120_source_excerpts", "unit_id").distinct()
    wanted = _wanted(spark, d)
    return evidence.coverage(wanted, wanted.join(known, F.col("group") == F.col("unit_id"), "left_semi"))


def _gold_ranking(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Units with a version known at the question's date, newest excerpt first, and the units required."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("excerpt_id")))
    found = p7_found(spark, d).withColumn("rank", rank).select("query_id", F.col("unit_id").alias("id"), "rank")
    return found, _wanted(spark, d).withColumnRenamed("group", "id")


def eval_ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG at 5 of the units known in time, per question."""
    found, wanted = _gold_ranking(spark, d)
    return r.ir_metrics(found, wanted, 5)


def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    """Macro averages of the metrics over questions, by kind of question."""
    q = table(spark, d, "questions", "query_id", "query_type").distinct()
    m = eval_ir_metrics(spark, d).join(q, "query_id")
    return m.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


def eval_same_first(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and shared terms compared: how many items each finds the same best document for."""
    a = rank_bm25(spark, d).where("rank = 1").select("query_id", F.col("doc_id").alias("a"))
    b = rank_overlap(spark, d).where("rank = 1").select("query_id", F.col("doc_id").alias("b"))
    return a.join(b, "query_id", "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))


def eval_latency(spark: SparkSession, d: str) -> DataFrame:
    """Least, greatest, mean, median and 95 % nearest-rank value of events by type."""
    e = table(spark, d, "events", "event_type", "value").where("value IS NOT NULL")
    plain = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    return plain.join(r.nearest_rank(e, "event_type", "value", {"median": 0.5, "p95": 0.95}), "event_type")


def eval_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of clicks less that of views of each user that has both: wins, ties, losses."""
    e = table(spark, d, "events", "user_id", "event_type", "value").where("event_type IN ('click', 'view') AND value IS NOT NULL")
    means = e.groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    delta = F.round(F.col("a") - F.col("b"), 9)
    return means.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 6).alias("mean_delta"), F.count_if(delta > 1e-9).alias("wins"), F.count_if(F.abs(delta) <= 1e-9).alias("ties"), F.count_if(delta < -1e-9).alias("losses"))


def eval_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price with the 95 % interval of 2,000 Poisson resamples."""
    return r.bootstrap(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 2000, 42)


def eval_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of each brand and size, chosen by hash."""
    return evidence.stratified(table(spark, d, "part", "p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], "p_partkey", 2).select("p_brand", "p_size", "p_partkey", "pick")


def eval_review_status(spark: SparkSession, d: str) -> DataFrame:
    """Questions by kind and review status, with those that could serve as gold: dated, with units, approved."""
    q = table(spark, d, "questions", "query_id", "query_type", "review_status", "query_date", "gold_unit_ids").distinct()
    usable = parse_date(F.col("query_date")).isNotNull() & (F.coalesce(F.size("gold_unit_ids"), F.lit(0)) > 0) & (F.col("review_status") == "APPROVED")
    return q.groupBy("query_type", "review_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("n_usable"))


def eval_context_size(spark: SparkSession, d: str) -> DataFrame:
    """Units, characters and estimated tokens of the context that each question's units make."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "source_text").where("source_text IS NOT NULL")
    longest = g.groupBy("unit_id").agg(F.max(F.length("source_text")).alias("n"))
    m = _wanted(spark, d).join(longest, F.col("group") == F.col("unit_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").cast("long").alias("n_chars"))
    return m.withColumn("n_tokens", F.ceil(F.col("n_chars") / 4).cast("long"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith(("rank_", "evidence_", "eval_"))}

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_T = r"list_distinct(list_filter(regexp_extract_all(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\s+', ' ', 'g')), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2))"


def _bm25_sql(p: str, column: str) -> str:
    """Common table expressions of BM25 over a column of documents, their names with a prefix; the ranking is ``<p>bm``."""
    return f"""{p}q AS (SELECT item_id AS query_id, unnest(list_distinct({_W})) AS term FROM (SELECT DISTINCT item_id, text FROM eval_items)),
 {p}tok AS (SELECT doc_id, {_W} AS w FROM (SELECT doc_id, {column} AS text FROM documents) WHERE text IS NOT NULL), {p}st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {p}tok),
 {p}post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM {p}tok) WHERE term IN (SELECT term FROM {p}q) GROUP BY 1, 2, 3),
 {p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY 1),
 {p}sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM {p}post JOIN {p}df USING (term) JOIN {p}q USING (term), {p}st GROUP BY 1, 2),
 {p}bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}sc)"""


_BM25, _TITLES = _bm25_sql("", "text"), _bm25_sql("t_", "title")
_OV = f"""oq AS (SELECT query_id, len(l) AS n, unnest(l) AS term FROM (SELECT item_id AS query_id, {_T} AS l FROM (SELECT DISTINCT item_id, text FROM eval_items))),
 od AS (SELECT DISTINCT doc_id, unnest({_T}) AS term FROM documents WHERE text IS NOT NULL),
 os AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM od JOIN oq USING (term) GROUP BY 1, 2),
 ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM os)"""
_LOOK = """g AS (SELECT DISTINCT excerpt_id, document_number AS n, article_number AS a, clause_number AS c, recorded_at FROM gold120_source_excerpts),
 m3 AS (SELECT q.excerpt_id AS query_id, g.excerpt_id, g.recorded_at, 3 AS level FROM g q JOIN g USING (n, a, c) WHERE n <> '' AND a <> '' AND c <> ''),
 m2 AS (SELECT q.excerpt_id AS query_id, g.excerpt_id, g.recorded_at, 2 AS level FROM g q JOIN g USING (n, a) WHERE n <> '' AND a <> '' AND q.excerpt_id NOT IN (SELECT query_id FROM m3)),
 m1 AS (SELECT q.excerpt_id AS query_id, g.excerpt_id, g.recorded_at, 1 AS level FROM g q JOIN g USING (n) WHERE n <> '' AND q.excerpt_id NOT IN (SELECT query_id FROM m3 UNION SELECT query_id FROM m2)),
 look AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recorded_at DESC NULLS LAST, excerpt_id DESC) AS rank FROM (SELECT * FROM m3 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m1)) WHERE rank <= 5)"""
_WANT = "want AS (SELECT DISTINCT query_id, unnest(gold_unit_ids) AS id FROM (SELECT DISTINCT query_id, gold_unit_ids FROM questions))"
_IR = f"""p7 AS ({PROBLEM_SQL['p7_found']}), {_WANT}, tot AS (SELECT query_id, count(*) AS n FROM want GROUP BY 1),
 hit AS (SELECT query_id, count(*) AS h, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT query_id, unit_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY excerpt_id DESC) AS rank FROM p7 QUALIFY rank <= 5) JOIN want USING (query_id, id) GROUP BY 1),
 ir AS (SELECT query_id, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(h / 5, 0), 6) AS precision, round(coalesce(1 / f, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, CAST(least(n, 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM tot LEFT JOIN hit USING (query_id))"""

SQL = {
    "rank_bm25": f"WITH {_BM25} SELECT * FROM bm WHERE rank <= 10",
    "rank_overlap": f"WITH {_OV} SELECT * FROM ov WHERE rank <= 10",
    "rank_dense": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 10",
    "rank_fused": f"""WITH {_BM25}, {_OV}, {_TITLES}, f AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM (SELECT query_id, doc_id, rank, 1.0::DOUBLE AS w FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank, 0.5::DOUBLE FROM ov WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank, 0.25::DOUBLE FROM t_bm WHERE rank <= 30) GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM f) SELECT * FROM k WHERE rank <= 10""",
    "rank_blended": f"""WITH {_BM25}, b AS (SELECT query_id, doc_id, round(0.75::DOUBLE * score / max(score) OVER (PARTITION BY query_id) + 0.2::DOUBLE * CAST(document_number IS NOT NULL AS INT), 6) AS blend FROM bm JOIN documents USING (doc_id) WHERE rank <= 20),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, doc_id) AS new_rank FROM b) SELECT * FROM k WHERE new_rank <= 10""",
    "rank_exact_lookup": f"WITH {_LOOK} SELECT query_id, excerpt_id, rank, level FROM look",
    "evidence_deduped": f"""WITH v AS (SELECT DISTINCT excerpt_id, unit_id, md5(coalesce(lower(regexp_replace(source_text, '\\s+', ' ', 'g')), '')) AS same, a FROM (SELECT excerpt_id, unit_id, source_text, {DATE_SQL.format(c="valid_from")} AS a, CASE WHEN valid_to IS NULL OR trim(valid_to) = '' THEN DATE '9999-12-31' ELSE {DATE_SQL.format(c="valid_to")} END AS b FROM gold120_source_excerpts) WHERE a IS NOT NULL AND b > a),
 one AS (SELECT unit_id, a, min(excerpt_id) AS excerpt_id, arg_min(same, excerpt_id) AS same FROM v GROUP BY 1, 2) SELECT min(excerpt_id) AS excerpt_id, unit_id FROM one GROUP BY unit_id, same""",
    "evidence_coverage": f"WITH {_WANT}, k AS (SELECT DISTINCT unit_id FROM gold120_source_excerpts) SELECT query_id, count(*) AS n_groups, count(unit_id) AS n_found, round(count(unit_id) / count(*), 6) AS share, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE unit_id IS NULL), '') AS missing FROM want LEFT JOIN k ON id = unit_id GROUP BY 1",
    "eval_ir_metrics": f"WITH {_IR} SELECT * FROM ir",
    "eval_macro": f"WITH {_IR} SELECT query_type, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM ir JOIN (SELECT DISTINCT query_id, query_type FROM questions) USING (query_id) GROUP BY 1",
    "eval_same_first": f"WITH {_BM25}, {_OV} SELECT count(*) AS n, count(*) FILTER (WHERE a.doc_id = b.doc_id) AS n_same FROM (SELECT * FROM bm WHERE rank = 1) a FULL JOIN (SELECT * FROM ov WHERE rank = 1) b ON a.query_id = b.query_id",
    "eval_latency": "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "eval_paired_delta": "SELECT count(*) AS n, round(avg(x), 6) AS mean_delta, count(*) FILTER (WHERE x > 1e-9) AS wins, count(*) FILTER (WHERE abs(x) <= 1e-9) AS ties, count(*) FILTER (WHERE x < -1e-9) AS losses FROM (SELECT round(avg(value) FILTER (WHERE event_type = 'click') - avg(value) FILTER (WHERE event_type = 'view'), 9) AS x FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id) WHERE x IS NOT NULL",
    "eval_stratified": "SELECT p_brand, p_size, p_partkey, pick FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS pick FROM part) WHERE pick <= 2",
    "eval_review_status": f"SELECT query_type, review_status, count(*) AS n, count(*) FILTER (WHERE {DATE_SQL.format(c='query_date')} IS NOT NULL AND len(gold_unit_ids) > 0 AND review_status = 'APPROVED') AS n_usable FROM (SELECT DISTINCT query_id, query_type, review_status, query_date, gold_unit_ids FROM questions) GROUP BY 1, 2",
    "eval_context_size": f"WITH {_WANT}, l AS (SELECT unit_id, max(length(source_text)) AS n FROM gold120_source_excerpts WHERE source_text IS NOT NULL GROUP BY 1) SELECT query_id, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_chars, CAST(ceil(sum(n) / 4) AS BIGINT) AS n_tokens FROM want JOIN l ON id = unit_id GROUP BY 1",
}
