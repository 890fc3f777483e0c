"""The numbered llm problems as queries over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.forms import plain_values
from quern.llm.leaks import leaked_items
from quern.llm.residue import THRESHOLD, residue_scores, validation
from quern.llm.scans import repaired_texts, repairs
from quern.llm.spam import spam, spam_scores
from quern.llm.tokens import encoded
from quern.sources.tables import table


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """Texts of content and payloads of evidence, each row once."""
    c = table(spark, d, "content", "id", "text").select(F.lit("content").alias("kind"), F.col("id").alias("row_key"), F.col("text").alias("body"))
    e = table(spark, d, "evidence", "evidence_id", "payload_json").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("row_key"), F.col("payload_json").alias("body"))
    return c.unionByName(e)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of content and evidence with template residue, filler, error or script notices."""
    found = residue_scores(_fetched(spark, d)).where(F.col("probability") >= THRESHOLD)
    return found.select(F.col("kind").alias("table_name"), "row_key").distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Rows of content and evidence without any residue."""
    scored = residue_scores(_fetched(spark, d)).groupBy("kind", "row_key").agg(F.max("probability").alias("probability"))
    return scored.where(F.col("probability") < THRESHOLD).select(F.col("kind").alias("table_name"), "row_key")


def p1_validation(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by weak label and host, and how many the model flags; one host was held out."""
    return validation(_fetched(spark, d))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    q = plain_values(table(spark, d, "questions", "query_id", "question"), "query_id", ["question"])
    g = plain_values(table(spark, d, "gold120_source_excerpts", "excerpt_id", "source_text", "document_number"), "excerpt_id", ["source_text", "document_number"])
    return q.unionByName(g)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ from their plain form."""
    return _plain(spark, d).where("value <> plain").select("field", "row_key").distinct()


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """The plain form of every value."""
    return _plain(spark, d).select("field", "row_key", "plain").distinct()


def p3_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Document numbers in plain form: rows, and different spellings that became equal."""
    plain = _plain(spark, d).where("field = 'document_number' AND plain IS NOT NULL")
    return plain.groupBy(F.trim("plain").alias("document_number")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("value").alias("n_spellings"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "source_text").select(F.lit("gold120_source_excerpts").alias("kind"), F.col("excerpt_id").cast("string").alias("row_key"), F.col("source_text").alias("text"))
    c = table(spark, d, "content", "id", "text").select(F.lit("content").alias("kind"), F.col("id").alias("row_key"), "text")
    return g.unionByName(c)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with broken words, misread characters, running headers or page numbers."""
    return repairs(_scanned(spark, d)).select(F.col("kind").alias("table_name"), "row_key").distinct()


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text as continuous readable paragraphs."""
    return repaired_texts(_scanned(spark, d)).select(F.col("kind").alias("table_name"), "row_key", "text", "n_repairs")


def p4_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What was repaired how often: noise by kind, and misread words with their repair."""
    noise = repairs(_scanned(spark, d))
    word = F.col("what") == "word"
    return noise.groupBy("what", F.when(word, F.col("token")).alias("seen"), "meant").agg(F.count(F.lit(1)).alias("n"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by the 50k byte-level vocabulary."""
    import public_tokenizers

    return encoded(table(spark, d, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain at least twelve consecutive words of an evaluation item."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item the documents it leaked to and the longest leaked run of words."""
    items = table(spark, d, "eval_items", "item_id", "task").distinct()
    leaked = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("longest"))
    return items.join(leaked, "item_id", "left").select("item_id", "task", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest_run"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-stuffed, link-list and tag pages."""
    return spam(table(spark, d, "documents", "doc_id", "text", "lang"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Language, words, robust distance and direction of every document."""
    s = spam_scores(table(spark, d, "documents", "doc_id", "text", "lang"))
    return s.select("doc_id", "language", "n_words", F.round("distance2", 2).alias("distance2"), F.round("toward", 3).alias("toward"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_validation, p3_found, p3_plain, p3_numbers, p4_found, p4_text, p4_repairs, p8_ids, p9_found, p9_items, p10_found, p10_scores)}

def _grams_sql(table_name: str, key: str) -> str:
    """Runs of twelve normalised words of a table's texts with their places."""
    invisible = "[\\x{FE00}-\\x{FE0F}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{AD}]+"
    words = f"regexp_extract_all(replace(lower(regexp_replace(regexp_replace(strip_accents(text), '{invisible}', '', 'g'), '\\p{{Mn}}+', '', 'g')), 'đ', 'd'), '[\\p{{L}}\\p{{N}}]+')"
    return f"""SELECT {key}, i, array_to_string(w[i + 1:i + 12], ' ') AS gram FROM (SELECT {key}, w, unnest(range(len(w) - 11)) AS i FROM (SELECT DISTINCT {key}, {words} AS w FROM {table_name} WHERE {key} IS NOT NULL AND text IS NOT NULL))"""


_SHARED = f"""d AS ({_grams_sql('documents', 'doc_id')}), m AS ({_grams_sql('eval_items', 'item_id')}), hit AS (SELECT DISTINCT doc_id, item_id, d.i AS i, m.i AS j FROM d JOIN m USING (gram))"""
SQL = {
    "p9_found": f"WITH {_SHARED} SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_items": f"""WITH {_SHARED}, isle AS (SELECT doc_id, item_id, i - j AS shift, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM hit), run AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM isle GROUP BY doc_id, item_id, shift, g)
 SELECT item_id, task, coalesce(n, 0) AS n_documents, coalesce(longest, 0) AS longest_run FROM (SELECT DISTINCT item_id, task FROM eval_items) LEFT JOIN (SELECT item_id, count(DISTINCT doc_id) AS n, max(n) AS longest FROM run GROUP BY 1) USING (item_id)""",
}
