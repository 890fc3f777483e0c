"""Structure of documents and places of phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import parsing as p
from quern.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def parse_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every document by kind: how many, lines and characters."""
    return p.segments(_docs(spark, d), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"), F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars"))


def parse_structure(spark: SparkSession, d: str) -> DataFrame:
    """Articles, clauses and points of every document with the article and clause they lie in."""
    return p.structure(_docs(spark, d), "doc_id", "text")


def parse_located(spark: SparkSession, d: str) -> DataFrame:
    """Whether the title of a document occurs in its text: once, more often, or not."""
    x = table(spark, d, "documents", "doc_id", "text", "title")
    return p.located(x, "text", "title").select("doc_id", "status", "start")


def parse_headings(spark: SparkSession, d: str) -> DataFrame:
    """Parts, chapters, sections and articles of every content text with what they lie in and their title."""
    c = table(spark, d, "content", "id", "text")
    return p.headings(c, "id", "text").distinct()


QUERIES = {f.__name__: f for f in (parse_segments, parse_structure, parse_located, parse_headings)}

_LINES = r"""l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS x FROM documents WHERE text IS NOT NULL)))"""
SQL = {
    "parse_segments": f"""WITH {_LINES}, o AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(line, '{r}') THEN '{k}'" for k, r in p.SEGMENTS)} END AS o FROM l),
 k AS (SELECT *, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'PREAMBLE') AS kind FROM o),
 n AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM k)
 SELECT kind, CAST(sum(new) AS BIGINT) AS n, count(DISTINCT doc_id) AS n_documents, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM n GROUP BY 1""",
    "parse_structure": rf"""WITH {_LINES}, m AS (SELECT doc_id, i, nullif(regexp_extract(line, '{p.ARTICLE}', 1), '') AS a, nullif(regexp_extract(line, '{p.CLAUSE}', 1), '') AS c, nullif(regexp_extract(line, '{p.POINT}', 1), '') AS p FROM l),
 w AS (SELECT *, max(CASE WHEN a IS NOT NULL THEN i END) OVER w AS aa, last_value(a IGNORE NULLS) OVER w AS article, max(CASE WHEN c IS NOT NULL THEN i END) OVER w AS ca, last_value(c IGNORE NULLS) OVER w AS lc FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT *, CASE WHEN a IS NOT NULL THEN 'ARTICLE' WHEN c IS NOT NULL THEN 'CLAUSE' WHEN p IS NOT NULL THEN 'POINT' END AS level FROM w)
 SELECT doc_id, i, level, article, CASE WHEN level <> 'ARTICLE' AND ca > aa THEN lc END AS clause, CASE WHEN level = 'POINT' THEN p END AS point FROM v WHERE level IS NOT NULL AND article IS NOT NULL""",
    "parse_located": r"""WITH x AS (SELECT doc_id, coalesce(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '') AS t, coalesce(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '') AS p FROM (SELECT DISTINCT doc_id, text, title FROM documents)),
 n AS (SELECT *, CASE WHEN p = '' THEN 0 ELSE (length(t) - length(replace(t, p, ''))) / length(p) END AS n FROM x)
 SELECT doc_id, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN n = 1 THEN instr(t, p) END AS start FROM n""",
    "parse_headings": f"""WITH {_LINES.replace('doc_id', 'key').replace('SELECT key, list_filter', 'SELECT id AS key, list_filter').replace('FROM documents', 'FROM (SELECT DISTINCT id, text FROM content WHERE id IS NOT NULL)').replace('list_filter(', 'md5(text) AS h, list_filter(').replace('SELECT key, i, line FROM', 'SELECT key, h, i, line FROM').replace('SELECT key, unnest(range', 'SELECT key, h, unnest(range')},
 m AS (SELECT *, """
    + ", ".join(f"nullif(regexp_extract(line, '{r}', 1), '') AS {k.lower()}" for k, r in p.HEADINGS)
    + ", lead(line) OVER w AS next, length(regexp_replace(line, '[^“«]', '', 'g')) - length(regexp_replace(line, '[^”»]', '', 'g')) AS q FROM l WINDOW w AS (PARTITION BY key, h ORDER BY i)),"
    " o AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY key, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM m),"
    " v AS (SELECT *, CASE "
    + " ".join(f"WHEN {k.lower()} IS NOT NULL THEN '{k}'" for k, _ in p.HEADINGS)
    + " END AS level FROM o WHERE depth <= 0),"
    " w AS (SELECT * , "
    + ", ".join(f"max(CASE WHEN {k.lower()} IS NOT NULL THEN i END) OVER w AS at_{k.lower()}, last_value({k.lower()} IGNORE NULLS) OVER w AS in_{k.lower()}" for k, _ in p.HEADINGS)
    + " FROM v WINDOW w AS (PARTITION BY key, h ORDER BY i ROWS UNBOUNDED PRECEDING)) SELECT DISTINCT key AS id, i, level, "
    + ", ".join(f"CASE WHEN {' AND '.join(['true', *(f'(at_{b.lower()} IS NULL OR at_{b.lower()} <= at_{k.lower()})' for b, _ in p.HEADINGS[:n])])} AND at_{k.lower()} <= i THEN in_{k.lower()} END AS {k.lower()}" for n, (k, _) in enumerate(p.HEADINGS))
    + rf", CASE WHEN level = 'ARTICLE' THEN trim(regexp_replace(line, '{p.HEADINGS[-1][1]}', ''), ' ') WHEN next IS NULL OR regexp_matches(next, '{p.ANY_HEADING}') THEN '' ELSE next END AS title FROM w WHERE level IS NOT NULL",
}
