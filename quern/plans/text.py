"""Text functions, quality metrics and extraction over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.sources.tables import table

# Keyword sets of subject areas, and trigger words of checklist sentences in order of precedence.
TOPICS = {
    "wages": ("tiền lương", "phụ cấp", "tiền thưởng", "tạm ứng"),
    "hours": ("làm thêm giờ", "thời giờ", "ca đêm", "nghỉ hằng năm"),
    "dismissal": ("chấm dứt", "kỷ luật", "thôi việc", "bồi thường"),
    "safety": ("an toàn", "vệ sinh", "bảo hộ", "tai nạn"),
}
TRIGGERS = (("PROHIBITION", "không được"), ("DUTY", "phải"), ("DUTY", "có nghĩa vụ"), ("RIGHT", "có quyền"), ("RIGHT", "được"), ("OPTION", "có thể"))


def text_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable id of every excerpt from its number and place."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "document_number", "article_number", "clause_number", "point_number").distinct()
    return g.select("excerpt_id", t.stable_id(F.col("document_number"), F.col("article_number"), F.col("clause_number"), F.col("point_number"), prefix="x_").alias("stable_id"))


def text_clean(spark: SparkSession, d: str) -> DataFrame:
    """Content without page-number lines and with collapsed spaces: length and hash."""
    c = table(spark, d, "content", "id", "text").withColumn("clean", t.clean_lines(F.col("text")))
    # repeated rows are told by a hash, no text is shuffled
    told = c.select("id", F.sha2("text", 256).alias("text"), F.length("clean").cast("long").alias("n_clean"), F.md5("clean").alias("clean_md5"))
    return told.distinct().drop("text")


def text_folded_terms(spark: SparkSession, d: str) -> DataFrame:
    """Folded terms of titles and the documents they are in."""
    g = table(spark, d, "documents", "doc_id", "title").distinct()
    return g.select("doc_id", F.explode(t.terms(F.col("title"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_documents"))


def text_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Normalised document numbers and the rows and spellings behind each."""
    n = table(spark, d, "documents", "document_number").where("document_number IS NOT NULL")
    return n.groupBy(t.identifier(F.col("document_number")).alias("identifier")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("document_number").alias("n_spellings"))


def text_layer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts and fractions of each text layer, and its hash."""
    c = table(spark, d, "content", "id", "text").where("text IS NOT NULL")
    x = F.col("text")
    n = F.length(x)
    letters = F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    share = lambda v: F.round(v / F.greatest(n, F.lit(1)), 4)
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return c.select(
        "id", n.cast("long").alias("n_chars"), F.size(t.words(x)).cast("long").alias("n_words"), F.size(lines).cast("long").alias("n_lines"), share(letters).alias("alnum_share"),
        share(F.length(F.regexp_replace(x, "[^0-9]", ""))).alias("digit_share"),
        F.round(1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)), 4).alias("duplicate_line_share"), F.sha2(x, 256).alias("sha256"),
    ).distinct()


def text_quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Texts per combination of quality reasons; PASS where there is none."""
    m = text_layer_metrics(spark, d)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_chars") < 40, F.lit("SHORT")), F.when(F.col("alnum_share") < 0.5, F.lit("FEW_LETTERS")),
            F.when(F.col("duplicate_line_share") > 0.3, F.lit("REPEATED_LINES")), F.when(F.col("digit_share") > 0.2, F.lit("DIGITS")),
        )
    )
    joined = F.array_join(reasons, "+")
    return m.groupBy(F.when(joined == "", "PASS").otherwise(joined).alias("reasons")).agg(F.count(F.lit(1)).alias("n_texts"))


def text_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Short lines on at least two and 55 % of a document's excerpts (three or more), by document."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "document_number", "source_text").where("source_text IS NOT NULL AND document_number IS NOT NULL").distinct()
    pages = g.groupBy("document_number").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 3")
    lines = g.select("excerpt_id", "document_number", F.explode(F.array_distinct(F.transform(F.split("source_text", "\n"), lambda s: F.trim(s)))).alias("line")).where("line <> '' AND length(line) <= 120")
    counted = lines.groupBy("document_number", "line").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(pages, "document_number").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(0.55 * F.col("n_pages")))).select("document_number", "line", "n", "n_pages")


def text_multiset_dice(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each excerpt's text to its ancestors' as multisets of words: 2 sum min / sum of both."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "source_text", "ancestor_context").where("source_text IS NOT NULL AND ancestor_context IS NOT NULL").distinct()
    side = lambda c, k: g.select("excerpt_id", F.explode(t.words(F.col(c))).alias("w"), F.lit(k).alias("side"))
    both = side("source_text", 0).unionByName(side("ancestor_context", 1))
    tf = both.groupBy("excerpt_id", "w").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return tf.groupBy("excerpt_id").agg(F.round(2 * F.sum(F.least("a", "b")) / F.sum(F.col("a") + F.col("b")), 6).alias("dice"))


def text_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur under several documents: hash, number and first of them."""
    c = table(spark, d, "documents", "doc_id", "text").where("trim(text) <> ''").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return c.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_ids"), F.min("doc_id").alias("first_id")).where("n_ids > 1")


def text_numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The first document number in each document's text, beside the declared one."""
    x = table(spark, d, "documents", "doc_id", "text", "document_number").where("text IS NOT NULL")
    found = F.nullif(F.regexp_extract("text", r"(\d{1,4}/\d{4}/[A-ZĐ]{2,6}-[A-ZĐ]{2,6})", 1), F.lit(""))
    return x.select("doc_id", found.alias("found"), F.coalesce(found == F.col("document_number"), F.lit(False)).alias("same"))


def text_citations(spark: SparkSession, d: str) -> DataFrame:
    """Articles cited in questions, with the number of questions."""
    q = table(spark, d, "questions", "query_id", "question").distinct()
    cited = F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(r"Điều (\d+)"), F.lit(1))))
    return q.select("query_id", cited.alias("article")).groupBy("article").agg(F.count(F.lit(1)).alias("n_questions"))


def text_money_percent(spark: SparkSession, d: str) -> DataFrame:
    """Sums of money and percentages of each excerpt, the first ten of each."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "source_text").where("source_text IS NOT NULL").distinct()
    money = F.slice(F.regexp_extract_all("source_text", F.lit(r"(\d{1,3}(?:\.\d{3})+) đồng"), F.lit(1)), 1, 10)
    percent = F.slice(F.regexp_extract_all("source_text", F.lit(r"(\d+) (?:phần trăm|per cent)"), F.lit(1)), 1, 10)
    rows = g.select("excerpt_id", F.array_join(money, ";").alias("money"), F.array_join(percent, ";").alias("percent"))
    return rows.where("money <> '' OR percent <> ''")


def text_topic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keywords of each topic in each question, where there is one."""
    q = table(spark, d, "questions", "query_id", "question").where("question IS NOT NULL").distinct()
    low = F.lower("question")
    scores = F.array(*[F.struct(F.lit(k).alias("topic"), sum((F.when(low.contains(w), 1).otherwise(0) for w in ws), F.lit(0)).cast("long").alias("score")) for k, ws in TOPICS.items()])
    return q.select("query_id", F.explode(scores).alias("s")).select("query_id", "s.topic", "s.score").where("score > 0")


def text_checklist(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of 18 to 700 characters of each provision with their first trigger class, at most 20 each."""
    p = table(spark, d, "provisions", "provision_id", "text").where("text IS NOT NULL")
    kind = lambda x: F.coalesce(*[F.when(F.lower(x).contains(w), F.lit(k)) for k, w in TRIGGERS])
    told = F.filter(F.transform(F.filter(t.sentences(F.col("text")), lambda x: F.length(x).between(18, 700)), kind), lambda k: k.isNotNull())
    # sentences are chosen within the row; only their kinds leave it
    rows = p.select("provision_id", F.sha2("text", 256).alias("sha"), F.slice(told, 1, 20).alias("kinds")).distinct()
    return rows.select("provision_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_sentences"), F.countDistinct("provision_id").alias("n_provisions"))


def text_sections(spark: SparkSession, d: str) -> DataFrame:
    """Length of the part of judgments before, and from, their findings."""
    x = table(spark, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'judgment' AND text IS NOT NULL")
    at = F.instr("text", "NHẬN ĐỊNH")
    return x.select("doc_id", F.when(at > 0, at - 1).otherwise(F.length("text")).cast("long").alias("n_facts"), F.when(at > 0, F.length("text") - at + 1).otherwise(0).cast("long").alias("n_findings"))


def text_urls(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per host, secure or not, and redirected ones."""
    c = table(spark, d, "candidates", "candidate_id", "requested_url", "final_url").distinct()
    moved = t.host(F.col("requested_url")) != t.host(F.col("final_url"))
    return c.groupBy(t.host(F.col("final_url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_url").startswith("https://")).alias("n_secure"), F.count_if(moved).alias("n_moved"), F.countDistinct(t.normal_url(F.col("final_url"))).alias("n_urls"))


def text_excerpt_parts(spark: SparkSession, d: str) -> DataFrame:
    """Contents cut into parts of at most 400 characters that give the text again."""
    c = table(spark, d, "content", "id", "text").where("text <> ''")
    parts = c.select("id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int"))).alias("part"))
    return parts.select("id", "part", F.md5(F.substr("text", F.col("part") * 400 + 1, F.lit(400))).alias("part_md5")).distinct()


def text_payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fetches by status and media type, read from the payload."""
    e = table(spark, d, "evidence", "evidence_id", "payload_json").where("payload_json IS NOT NULL").distinct()
    status = F.regexp_extract("payload_json", r'"http_status": (\d+)', 1)
    mime = F.regexp_extract("payload_json", r'"mime_type": "([^";]*)', 1)
    return e.groupBy(status.alias("http_status"), mime.alias("mime_type")).agg(F.count(F.lit(1)).alias("n"))


def text_number_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the kind and issuer in their number, and by year."""
    x = table(spark, d, "documents", "document_number").where("document_number IS NOT NULL")
    part = lambda i: F.regexp_extract("document_number", r"^\d+/(\d{4})/([^-]+)-(.+)$", i)
    return x.groupBy(part(2).alias("kind"), part(3).alias("issuer")).agg(F.count(F.lit(1)).alias("n"), F.min(part(1)).alias("first_year"), F.max(part(1)).alias("last_year"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith("text_")}

_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_FOLD = "trim(regexp_replace(replace(strip_accents(lower({c})), 'đ', 'd'), '\\s+', ' ', 'g'))"
_LINES = "list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[\t \x{{a0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"
_METRICS = f"""SELECT id, length(text) AS n_chars, len({_WORDS.format(c="text")}) AS n_words, len({_LINES.format(c="text")}) AS n_lines,
 round(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(text), 1), 4) AS alnum_share,
 round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 4) AS digit_share,
 round(1 - len(list_distinct({_LINES.format(c="text")})) / greatest(len({_LINES.format(c="text")}), 1), 4) AS duplicate_line_share, sha256(text) AS sha256
 FROM (SELECT DISTINCT id, text FROM content WHERE text IS NOT NULL)"""

SQL = {
    "text_stable_ids": "SELECT excerpt_id, 'x_' || substr(sha1(coalesce(document_number,'') || '|' || coalesce(article_number,'') || '|' || coalesce(clause_number,'') || '|' || coalesce(point_number,'')), 1, 16) AS stable_id FROM (SELECT DISTINCT excerpt_id, document_number, article_number, clause_number, point_number FROM gold120_source_excerpts)",
    "text_clean": f"""SELECT id, CAST(length(clean) AS BIGINT) AS n_clean, md5(clean) AS clean_md5 FROM (SELECT id, array_to_string(list_filter(string_split({_CLEAN.format(c="text")}, chr(10)),
 lambda x: NOT regexp_matches(x, '^\\s*(?:[-–—~·]\\s*\\d{{1,4}}\\s*[-–—~·]|\\d{{1,4}}|(?i:trang|page)\\s+\\d{{1,4}}(?:\\s*(?:/|of)\\s*\\d{{1,4}})?)\\s*$')), chr(10)) AS clean FROM (SELECT DISTINCT id, text FROM content))""",
    "text_folded_terms": f"SELECT term, count(*) AS n_documents FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all({_FOLD.format(c='title')}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 2))) AS term FROM (SELECT DISTINCT doc_id, title FROM documents)) GROUP BY term",
    "text_identifiers": "SELECT regexp_replace(upper(replace(replace(document_number, 'Đ', 'D'), 'đ', 'd')), '[^0-9A-Z]', '', 'g') AS identifier, count(*) AS n_rows, count(DISTINCT document_number) AS n_spellings FROM documents WHERE document_number IS NOT NULL GROUP BY 1",
    "text_layer_metrics": _METRICS,
    "text_quality_reasons": f"""SELECT CASE WHEN r = '' THEN 'PASS' ELSE r END AS reasons, count(*) AS n_texts FROM (SELECT array_to_string(list_filter([
 CASE WHEN n_chars < 40 THEN 'SHORT' END, CASE WHEN alnum_share < 0.5 THEN 'FEW_LETTERS' END, CASE WHEN duplicate_line_share > 0.3 THEN 'REPEATED_LINES' END, CASE WHEN digit_share > 0.2 THEN 'DIGITS' END], lambda x: x IS NOT NULL), '+') AS r FROM ({_METRICS})) GROUP BY 1""",
    "text_repeated_lines": """WITH g AS (SELECT DISTINCT excerpt_id, document_number, source_text FROM gold120_source_excerpts WHERE source_text IS NOT NULL AND document_number IS NOT NULL),
 pages AS (SELECT document_number, count(*) n_pages FROM g GROUP BY 1 HAVING count(*) >= 3),
 lines AS (SELECT excerpt_id, document_number, unnest(list_distinct(list_transform(string_split(source_text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM g)
 SELECT document_number, line, count(*) AS n, any_value(n_pages) AS n_pages FROM lines JOIN pages USING (document_number) WHERE line <> '' AND length(line) <= 120 GROUP BY 1, 2 HAVING count(*) >= greatest(2, ceil(0.55 * any_value(n_pages)))""",
    "text_multiset_dice": f"""WITH g AS (SELECT DISTINCT excerpt_id, source_text, ancestor_context FROM gold120_source_excerpts WHERE source_text IS NOT NULL AND ancestor_context IS NOT NULL),
 w AS (SELECT excerpt_id, unnest({_WORDS.format(c="source_text")}) w, 1 a, 0 b FROM g UNION ALL SELECT excerpt_id, unnest({_WORDS.format(c="ancestor_context")}), 0, 1 FROM g),
 tf AS (SELECT excerpt_id, w, sum(a) a, sum(b) b FROM w GROUP BY 1, 2) SELECT excerpt_id, round(2 * sum(least(a, b)) / sum(a + b), 6) AS dice FROM tf GROUP BY 1""",
    "text_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n_ids, min(doc_id) AS first_id FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1",
    "text_numbers_in_text": r"SELECT doc_id, nullif(regexp_extract(text, '(\d{1,4}/\d{4}/[A-ZĐ]{2,6}-[A-ZĐ]{2,6})', 1), '') AS found, coalesce(nullif(regexp_extract(text, '(\d{1,4}/\d{4}/[A-ZĐ]{2,6}-[A-ZĐ]{2,6})', 1), '') = document_number, false) AS same FROM (SELECT DISTINCT doc_id, text, document_number FROM documents WHERE text IS NOT NULL)",
    "text_citations": r"SELECT article, count(*) AS n_questions FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(question, 'Điều (\d+)', 1))) AS article FROM (SELECT DISTINCT query_id, question FROM questions)) GROUP BY 1",
    "text_money_percent": r"SELECT * FROM (SELECT excerpt_id, array_to_string(list_slice(regexp_extract_all(source_text, '(\d{1,3}(?:\.\d{3})+) đồng', 1), 1, 10), ';') AS money, array_to_string(list_slice(regexp_extract_all(source_text, '(\d+) (?:phần trăm|per cent)', 1), 1, 10), ';') AS percent FROM (SELECT DISTINCT excerpt_id, source_text FROM gold120_source_excerpts WHERE source_text IS NOT NULL)) WHERE money <> '' OR percent <> ''",
    "text_topic_scores": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT query_id, '{k}' AS topic, {' + '.join(f'''CAST(contains(lower(question), '{w}') AS BIGINT)''' for w in ws)} AS score FROM (SELECT DISTINCT query_id, question FROM questions WHERE question IS NOT NULL)" for k, ws in TOPICS.items()) + ") WHERE score > 0",
    "text_checklist": r"""WITH s AS (SELECT provision_id, text, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT provision_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM (SELECT DISTINCT provision_id, text FROM provisions WHERE text IS NOT NULL))),
 k AS (SELECT *, CASE """ + " ".join(f"WHEN contains(lower(s), '{w}') THEN '{k}'" for k, w in TRIGGERS) + """ END AS kind FROM s WHERE length(s) BETWEEN 18 AND 700),
 r AS (SELECT *, row_number() OVER (PARTITION BY provision_id, text ORDER BY i) AS rn FROM k WHERE kind IS NOT NULL) SELECT kind, count(*) AS n_sentences, count(DISTINCT provision_id) AS n_provisions FROM r WHERE rn <= 20 GROUP BY 1""",
    "text_sections": "SELECT doc_id, CASE WHEN p > 0 THEN p - 1 ELSE length(text) END AS n_facts, CASE WHEN p > 0 THEN length(text) - p + 1 ELSE 0 END AS n_findings FROM (SELECT DISTINCT doc_id, text, instr(text, 'NHẬN ĐỊNH') AS p FROM documents WHERE doc_kind = 'judgment' AND text IS NOT NULL)",
    "text_urls": r"""WITH c AS (SELECT *, nullif(lower(regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host, nullif(lower(regexp_extract(requested_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS asked,
 regexp_replace(regexp_replace(final_url, '#.*$', ''), '/+$', '') AS bare FROM (SELECT DISTINCT candidate_id, requested_url, final_url FROM candidates)),
 h AS (SELECT *, regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1) AS head FROM c)
 SELECT host, count(*) AS n, count(*) FILTER (WHERE starts_with(final_url, 'https://')) AS n_secure, count(*) FILTER (WHERE host <> asked) AS n_moved, count(DISTINCT CASE WHEN head <> '' AND NOT contains(head, '@') THEN lower(head) || substr(bare, length(head) + 1) END) AS n_urls FROM h GROUP BY 1""",
    "text_excerpt_parts": "SELECT DISTINCT id, part, md5(substr(text, part * 400 + 1, 400)) AS part_md5 FROM (SELECT id, text, unnest(range(0, CAST(floor((length(text) - 1) / 400) AS BIGINT) + 1)) AS part FROM (SELECT DISTINCT id, text FROM content WHERE text <> ''))",
    "text_payload_fields": r"""SELECT regexp_extract(payload_json, '"http_status": (\d+)', 1) AS http_status, regexp_extract(payload_json, '"mime_type": "([^";]*)', 1) AS mime_type, count(*) AS n FROM (SELECT DISTINCT evidence_id, payload_json FROM evidence WHERE payload_json IS NOT NULL) GROUP BY 1, 2""",
    "text_number_kinds": r"SELECT regexp_extract(document_number, '^\d+/(\d{4})/([^-]+)-(.+)$', 2) AS kind, regexp_extract(document_number, '^\d+/(\d{4})/([^-]+)-(.+)$', 3) AS issuer, count(*) AS n, min(regexp_extract(document_number, '^\d+/(\d{4})/([^-]+)-(.+)$', 1)) AS first_year, max(regexp_extract(document_number, '^\d+/(\d{4})/([^-]+)-(.+)$', 1)) AS last_year FROM documents WHERE document_number IS NOT NULL GROUP BY 1, 2",
}
