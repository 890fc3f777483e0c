"""Audits: versions, conflicts, provenance, citations, labels and reasons of misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions.dates import DATE_SQL, parse_date
from quern.operators import selection as s
from quern.operators.asof import as_known
from quern.operators.intervals import OPEN, closed_versions, conflicts, day_number, usable_intervals
from quern.operators.references import micros
from quern.plans.problems import _USABLE_SQL, p7_found
from quern.plans.problems import SQL as PROBLEM_SQL
from quern.plans.selection import _WANT, _channels_of_age, _wanted
from quern.plans.retrieval import _BM25, _OV, _TITLES, _channels
from quern.sources.tables import table

_DAY = lambda c: F.when(F.col(c) == OPEN, "").otherwise(F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd"))


def temporal_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each unit in order, each closed where the next begins."""
    g = usable_intervals(table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "valid_from", "valid_to"), "valid_from", "valid_to")
    v = closed_versions(g.select("unit_id", "__start", "__end", F.col("excerpt_id").alias("version")), "unit_id")
    return v.select("unit_id", _DAY("__start").alias("start_date"), _DAY("__end").alias("end_date"), F.col("version").alias("excerpt_id"))


def temporal_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of time in which a unit has several different texts at once."""
    g = usable_intervals(table(spark, d, "gold120_source_excerpts", "unit_id", "source_text", "valid_from", "valid_to"), "valid_from", "valid_to")
    same = F.md5(F.trim(F.regexp_replace("source_text", r"\s+", " ")))
    c = conflicts(g.select("unit_id", same.alias("value"), "__start", "__end"), "unit_id", "value")
    return c.select("unit_id", _DAY("__start").alias("start_date"), _DAY("__end").alias("end_date"), F.col("n").cast("long").alias("n_texts"))


def evidence_citations(spark: SparkSession, d: str) -> DataFrame:
    """Articles of numbered documents that questions cite, and the units there: RESOLVED (one), AMBIGUOUS or MISSING.

    A place is looked up once, however many questions cite it.
    """
    q = table(spark, d, "questions", "query_id", "question").where("question IS NOT NULL").distinct()
    cited = q.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(CITED), F.lit(0)))).alias("c"))
    cited = cited.select("query_id", F.regexp_extract("c", CITED, 1).alias("article"), F.regexp_extract("c", CITED, 2).alias("number")).distinct()
    units = table(spark, d, "gold120_source_excerpts", "unit_id", "document_number", "article_number").where("unit_id <> '' AND document_number <> ''")
    held = units.groupBy(F.col("document_number").alias("number"), F.col("article_number").alias("article")).agg(F.countDistinct("unit_id").alias("n"), F.min("unit_id").alias("unit"))
    per_place = cited.groupBy("article", "number").agg(F.count(F.lit(1)).alias("n_questions")).join(held, ["article", "number"], "left")
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return per_place.select("article", "number", "n_questions", status.alias("status"), F.when(F.col("n") == 1, F.col("unit")).alias("unit_id"))


def gate_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Contents by whether the stored hashes are those of the text: text hash equal, and raw hash there."""
    c = table(spark, d, "content", "id", "text", "text_sha256", "raw_sha256")
    equal = F.when(F.col("text").isNull() | F.col("text_sha256").isNull(), "UNKNOWN").when(F.sha2("text", 256) == F.lower("text_sha256"), "EQUAL").otherwise("CHANGED")
    rows = c.select("id", equal.alias("text_hash"), F.when(F.col("raw_sha256").rlike("^[0-9a-fA-F]{64}$"), "PRESENT").otherwise("MISSING").alias("raw_hash")).distinct()
    return rows.groupBy("text_hash", "raw_hash").agg(F.count(F.lit(1)).alias("n"))


def gate_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts by what their origin lacks: address, number, article, validity, time of record; and units without a provision."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "source_url", "document_number", "article_number", "valid_from", "recorded_at").distinct()
    known = table(spark, d, "provisions", "provision_id").distinct()
    both = g.join(known, F.col("unit_id") == F.col("provision_id"), "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lacks = F.array_join(F.array_compact(F.array(
        F.when(blank("source_url"), "URL"), F.when(blank("document_number"), "NUMBER"), F.when(blank("article_number"), "ARTICLE"), F.when(parse_date(F.col("valid_from")).isNull(), "START"),
        F.when(F.col("recorded_at").isNull(), "RECORDED"), F.when(F.col("provision_id").isNull(), "UNIT"),
    )), "+")
    return both.groupBy(F.when(lacks == "", "NONE").otherwise(lacks).alias("lacks")).agg(F.count(F.lit(1)).alias("n_excerpts"))


def eval_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Units found in time against required ones, by kind of question: true, false and missed, precision and recall over all."""
    q = table(spark, d, "questions", "query_id", "query_type").distinct()
    found = p7_found(spark, d).select("query_id", F.col("unit_id").alias("id"), F.lit(1).alias("f")).distinct()
    both = _wanted(spark, d).select("query_id", F.col("group").alias("id"), F.lit(1).alias("w")).join(found, ["query_id", "id"], "full").join(q, "query_id")
    per = both.groupBy("query_type").agg(F.count_if(F.col("w").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return per.select("query_type", "tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def eval_pool_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall of the union of two rankings at pools of one, two and five."""
    channels, wanted = _channels_of_age(spark, d)
    out = None
    for k in POOLS:
        one = s.union_recall(channels, wanted, k, 1.0).agg(F.lit(k).alias("pool"), F.count(F.lit(1)).alias("n_questions"), F.round(F.avg("recall"), 6).alias("recall"), F.count_if("passed").alias("n_complete"))
        out = one if out is None else out.unionByName(one)
    return out


def eval_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Why a dated question has or lacks each of its units: FOUND, KNOWN_LATER, NOT_VALID then, or NO_EXCERPT at all."""
    asked = (
        table(spark, d, "questions", "query_id", "query_date", "gold_unit_ids").withColumn("day", day_number(parse_date(F.col("query_date")))).where("day IS NOT NULL AND query_id IS NOT NULL")
        .select("query_id", "day", F.explode("gold_unit_ids").alias("unit_id")).where("unit_id <> ''").distinct()
    )
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "valid_from", "valid_to", "recorded_at")
    versions = usable_intervals(g, "valid_from", "valid_to").select(F.col("unit_id").alias("entity"), F.col("excerpt_id").alias("version"), F.col("__start").alias("start"), F.col("__end").alias("end"), F.coalesce(micros(F.col("recorded_at")), F.lit(0)).alias("known"))
    # valid at all: the same join, as if everything had been known from the start
    valid = as_known(asked.select(F.col("unit_id").alias("entity"), F.col("query_id").alias("event"), "day"), versions.withColumn("known_day", F.col("start")))
    valid = valid.select(F.col("event").alias("query_id"), F.col("entity").alias("unit_id"), F.lit(1).alias("valid")).distinct()
    found = p7_found(spark, d).select("query_id", "unit_id", F.lit(1).alias("found")).distinct()
    there = g.select("unit_id", F.lit(1).alias("there")).distinct()
    all_of = asked.select("query_id", "unit_id").distinct().join(found, ["query_id", "unit_id"], "left").join(valid, ["query_id", "unit_id"], "left").join(there, "unit_id", "left")
    why = F.when(F.col("found") == 1, "FOUND").when(F.col("valid") == 1, "KNOWN_LATER").when(F.col("there") == 1, "NOT_VALID").otherwise("NO_EXCERPT")
    return all_of.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_questions"))


def rank_components(spark: SparkSession, d: str) -> DataFrame:
    """Every document that a channel ranks among an item's thirty best, with its best score in each channel."""
    c = _channels(spark, d)
    return c.groupBy("query_id", F.col("id").alias("doc_id")).agg(*[F.max(F.when(F.col("channel") == k, F.col("score"))).alias(k) for k in ("bm25", "terms", "titles")], F.countDistinct("channel").alias("n_channels"))


def text_unique_questions(spark: SparkSession, d: str) -> DataFrame:
    """Different questions by their folded text: a stable id, the first query and how many there are."""
    q = table(spark, d, "questions", "query_id", "question").where("trim(question) <> '' AND query_id IS NOT NULL").distinct()
    return q.groupBy(t.stable_id(t.collapse_spaces(F.lower("question")), prefix="q_").alias("question_key")).agg(F.min("query_id").alias("first_query"), F.count(F.lit(1)).alias("n"))


def text_spans(spark: SparkSession, d: str) -> DataFrame:
    """Provisions cut at semicolons and line ends into at most 24 spans of neighbouring parts: number, longest, hash."""
    p = table(spark, d, "provisions", "provision_id", "text").where("provision_id IS NOT NULL AND trim(text) <> ''")
    spans = t.spans(F.col("text"), MOST_SPANS)
    return p.select("provision_id", F.size(spans).cast("long").alias("n_spans"), F.array_max(F.transform(spans, lambda x: F.length(x))).cast("long").alias("longest"), F.md5(F.array_join(spans, "|")).alias("spans_md5")).distinct()


# Most spans of a text.
MOST_SPANS = 24
CITED = r"Điều (\d+)[^.;?\n]{0,20}?(\d+/\d{4}/[A-ZĐ]+-[A-ZĐ]+)"
POOLS = (1, 2, 5)

QUERIES = {
    f.__name__: f
    for f in (
        temporal_versions, temporal_conflicts, evidence_citations, gate_integrity, gate_provenance, eval_label_sets, eval_pool_sweep, eval_diagnosis, rank_components, text_unique_questions, text_spans,
    )
}

_D = lambda c: f"CASE WHEN {c} = DATE '9999-12-31' THEN '' ELSE strftime({c}, '%Y-%m-%d') END"
_Q = f"asked AS (SELECT DISTINCT query_id, q, unit_id FROM (SELECT query_id, {DATE_SQL.format(c='query_date')} AS q, unnest(gold_unit_ids) AS unit_id FROM questions WHERE query_id IS NOT NULL) WHERE q IS NOT NULL AND unit_id <> '')"
_BLANK = lambda c: f"trim(coalesce({c}, ''), ' ') = ''"
SQL = {
    "temporal_versions": f"""WITH {_USABLE_SQL}, o AS (SELECT unit_id, a, max(b) AS b, arg_max(excerpt_id, struct_pack(b := b, e := excerpt_id)) AS excerpt_id FROM usable GROUP BY 1, 2), n AS (SELECT *, lead(a) OVER (PARTITION BY unit_id ORDER BY a) AS c FROM o)
 SELECT unit_id, {_D('a')} AS start_date, {_D('least(b, coalesce(c, b))')} AS end_date, excerpt_id FROM n""",
    "temporal_conflicts": rf"""WITH u AS (SELECT unit_id, v, a, b FROM (SELECT unit_id, md5(trim(regexp_replace(source_text, '\s+', ' ', 'g'), ' ')) AS v, {DATE_SQL.format(c="valid_from")} AS a, CASE WHEN valid_to IS NULL OR trim(valid_to) = '' THEN DATE '9999-12-31' ELSE {DATE_SQL.format(c="valid_to")} END AS b FROM gold120_source_excerpts WHERE unit_id IS NOT NULL AND source_text IS NOT NULL) WHERE a IS NOT NULL AND b > a),
 days AS (SELECT unit_id, a AS day FROM u UNION SELECT unit_id, b FROM u), cut AS (SELECT unit_id, day, lead(day) OVER (PARTITION BY unit_id ORDER BY day) AS until FROM days),
 n AS (SELECT c.unit_id, day, until, count(DISTINCT v) AS n FROM cut c JOIN u ON c.unit_id = u.unit_id AND u.a <= day AND until <= u.b GROUP BY 1, 2, 3) SELECT unit_id, day, until, n FROM (SELECT unit_id, min(day) AS day, max(until) AS until, n FROM (SELECT *, sum(new) OVER (PARTITION BY unit_id ORDER BY day) AS g FROM (SELECT *, CASE WHEN n = lag(n) OVER w AND day = lag(until) OVER w THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY unit_id ORDER BY day))) GROUP BY unit_id, g, n) m WHERE n > 1""",
    "evidence_citations": rf"""WITH q AS (SELECT DISTINCT query_id, regexp_extract(c, '{CITED}', 1) AS article, regexp_extract(c, '{CITED}', 2) AS number FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(question, '{CITED}'))) AS c FROM (SELECT DISTINCT query_id, question FROM questions WHERE question IS NOT NULL))),
 h AS (SELECT document_number AS number, article_number AS article, count(DISTINCT unit_id) AS n, min(unit_id) AS unit FROM gold120_source_excerpts WHERE unit_id <> '' AND document_number <> '' GROUP BY 1, 2), c AS (SELECT article, number, count(*) AS n_questions FROM q GROUP BY 1, 2)
 SELECT article, number, n_questions, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN unit END AS unit_id FROM c LEFT JOIN h USING (article, number)""",
    "gate_integrity": "SELECT text_hash, raw_hash, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN text IS NULL OR text_sha256 IS NULL THEN 'UNKNOWN' WHEN sha256(text) = lower(text_sha256) THEN 'EQUAL' ELSE 'CHANGED' END AS text_hash, CASE WHEN regexp_matches(raw_sha256, '^[0-9a-fA-F]{64}$') THEN 'PRESENT' ELSE 'MISSING' END AS raw_hash FROM content) GROUP BY 1, 2",
    "gate_provenance": f"""WITH g AS (SELECT DISTINCT excerpt_id, unit_id, source_url, document_number, article_number, valid_from, recorded_at FROM gold120_source_excerpts), l AS (SELECT concat_ws('+', CASE WHEN {_BLANK('source_url')} THEN 'URL' END, CASE WHEN {_BLANK('document_number')} THEN 'NUMBER' END, CASE WHEN {_BLANK('article_number')} THEN 'ARTICLE' END,
 CASE WHEN {DATE_SQL.format(c='valid_from')} IS NULL THEN 'START' END, CASE WHEN recorded_at IS NULL THEN 'RECORDED' END, CASE WHEN unit_id IS NULL OR unit_id NOT IN (SELECT provision_id FROM provisions WHERE provision_id IS NOT NULL) THEN 'UNIT' END) AS l FROM g) SELECT CASE WHEN l = '' THEN 'NONE' ELSE l END AS lacks, count(*) AS n_excerpts FROM l GROUP BY 1""",
    "eval_label_sets": f"""WITH {_WANT}, p7 AS ({PROBLEM_SQL['p7_found']}), f AS (SELECT DISTINCT query_id, unit_id FROM p7), b AS (SELECT coalesce(w.query_id, f.query_id) AS query_id, w.g, f.unit_id FROM want w FULL JOIN f ON w.query_id = f.query_id AND w.g = f.unit_id),
 c AS (SELECT query_type, count(*) FILTER (WHERE g IS NOT NULL AND unit_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE unit_id IS NULL) AS fn FROM b JOIN (SELECT DISTINCT query_id, query_type FROM questions) USING (query_id) GROUP BY 1)
 SELECT query_type, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""",
    "eval_pool_sweep": f"WITH {_WANT}, p7 AS ({PROBLEM_SQL['p7_found']}), r AS (SELECT query_id, unit_id, least(row_number() OVER (PARTITION BY query_id ORDER BY excerpt_id, unit_id), row_number() OVER (PARTITION BY query_id ORDER BY excerpt_id DESC, unit_id)) AS k FROM p7), b AS (SELECT query_id, unit_id, min(k) AS k FROM r GROUP BY 1, 2), j AS (SELECT w.query_id, b.k FROM want w LEFT JOIN b ON w.query_id = b.query_id AND w.g = b.unit_id) "
    + " UNION ALL ".join(f"SELECT {k} AS pool, count(*) AS n_questions, round(avg(r), 6) AS recall, count(*) FILTER (WHERE r >= 1) AS n_complete FROM (SELECT round(count(*) FILTER (WHERE k <= {k}) / count(*), 6) AS r FROM j GROUP BY query_id)" for k in POOLS),
    "eval_diagnosis": f"""WITH {_USABLE_SQL}, {_Q}, p7 AS ({PROBLEM_SQL['p7_found']}), j AS (SELECT DISTINCT query_id, unit_id FROM asked),
 v AS (SELECT DISTINCT a.query_id, a.unit_id FROM asked a JOIN usable u ON a.unit_id = u.unit_id AND u.a <= a.q AND (a.q < u.b OR u.b = DATE '9999-12-31')),
 w AS (SELECT j.query_id, CASE WHEN (j.query_id, j.unit_id) IN (SELECT (query_id, unit_id) FROM p7) THEN 'FOUND' WHEN (j.query_id, j.unit_id) IN (SELECT (query_id, unit_id) FROM v) THEN 'KNOWN_LATER' WHEN j.unit_id IN (SELECT unit_id FROM gold120_source_excerpts WHERE unit_id IS NOT NULL) THEN 'NOT_VALID' ELSE 'NO_EXCERPT' END AS outcome FROM j)
 SELECT outcome, count(*) AS n, count(DISTINCT query_id) AS n_questions FROM w GROUP BY 1""",
    "rank_components": f"""WITH {_BM25}, {_OV}, {_TITLES}, c AS (SELECT query_id, doc_id, 'bm25' AS ch, score FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 'terms', score FROM ov WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 'titles', score FROM t_bm WHERE rank <= 30)
 SELECT query_id, doc_id, max(score) FILTER (WHERE ch = 'bm25') AS bm25, max(score) FILTER (WHERE ch = 'terms') AS terms, max(score) FILTER (WHERE ch = 'titles') AS titles, count(DISTINCT ch) AS n_channels FROM c GROUP BY 1, 2""",
    "text_unique_questions": r"""WITH q AS (SELECT DISTINCT query_id, lower(question) AS x FROM questions WHERE trim(question, ' ') <> '' AND query_id IS NOT NULL), k AS (SELECT query_id, 'q_' || substr(sha1(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[\t \x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')), 1, 16) AS question_key FROM q)
 SELECT question_key, min(query_id) AS first_query, count(*) AS n FROM k GROUP BY 1""",
    "text_spans": rf"""WITH p AS (SELECT DISTINCT provision_id, list_filter(list_transform(regexp_split_to_array(text, '[;\n]'), lambda s: trim(s, ' ')), lambda s: s <> '') AS x FROM provisions WHERE provision_id IS NOT NULL AND trim(text, ' ') <> ''), g AS (SELECT *, CAST(greatest(ceil(len(x) / {MOST_SPANS}), 1) AS BIGINT) AS size FROM p),
 m AS (SELECT provision_id, list_transform(range(0, len(x), size), lambda i: array_to_string(x[i + 1:i + size], '; ')) AS y FROM g) SELECT DISTINCT provision_id, len(y) AS n_spans, list_max(list_transform(y, lambda s: length(s))) AS longest, md5(array_to_string(y, '|')) AS spans_md5 FROM m""",
}
SQL["temporal_conflicts"] = SQL["temporal_conflicts"].replace("SELECT unit_id, day, until, n FROM (", f"SELECT unit_id, {_D('day')} AS start_date, {_D('until')} AS end_date, n AS n_texts FROM (")
