"""Integrity gates, coverage reports and state over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dates import DATE_SQL, is_blank, parse_date
from quern.operators import gates as g
from quern.operators import stateful as s
from quern.sources.tables import table


def gate_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of provisions that break a rule, by rule and level."""
    p = table(spark, d, "provisions", "provision_id", "level", "text", "heading", "char_start", "char_end", "line_start", "line_end", "valid_from", "valid_to").distinct()
    start, end = parse_date(F.col("valid_from")), parse_date(F.col("valid_to"))
    rules = {
        "NO_TEXT": is_blank(F.col("text")) & is_blank(F.col("heading")),
        "NO_SPAN": F.col("char_start").isNull() | F.col("char_end").isNull(),
        "SPAN_BACKWARD": F.col("char_end") < F.col("char_start"),
        "SPAN_LENGTH": (F.col("char_end") - F.col("char_start")) != F.length("text"),
        "LINES_BACKWARD": F.col("line_end") < F.col("line_start"),
        "BAD_START": ~is_blank(F.col("valid_from")) & start.isNull(),
        "BAD_END": ~is_blank(F.col("valid_to")) & end.isNull(),
        "END_BEFORE_START": end <= start,
    }
    level = F.concat_ws("\t", F.coalesce("level", F.lit("")), F.lit(""))
    broken = g.rule_rows(p.withColumn("level", level), "level", rules)
    return broken.groupBy("rule", F.regexp_replace("key", "\t", "").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def gate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Ids delivered more than once, by table: keys, rows, and keys whose rows differ."""
    out = None
    for name, key, columns in (
        ("provisions", "provision_id", ("provision_id", "parent_id", "ingested_at")), ("content", "id", ("id", "text_sha256", "ingested_at", "deleted_at")),
        ("records", "record_id", ("record_id", "state", "ingested_at", "deleted_at")), ("questions", "query_id", ("query_id", "question", "query_date")),
    ):
        k = g.duplicate_keys(table(spark, d, name, *columns), key).agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n_distinct") > 1).alias("n_changed"))
        k = k.withColumn("table_name", F.lit(name))
        out = k if out is None else out.unionByName(k)
    return out


def gate_structure(spark: SparkSession, d: str) -> DataFrame:
    """Provisions of each document by level, one column each."""
    p = table(spark, d, "provisions", "provision_id", "document_id", "level").where("document_id IS NOT NULL").distinct()
    levels = ["PART", "CHAPTER", "SECTION", "ARTICLE", "CLAUSE", "POINT", "SUBPOINT"]
    return p.groupBy("document_id").agg(*[F.count_if(F.col("level") == v).alias(v.lower()) for v in levels])


def gate_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-free fingerprint of each staging table's keys and content."""
    out = None
    for name, columns in _PRINT:
        f = g.fingerprint(table(spark, d, name, *columns), list(columns)).withColumn("table_name", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


def gate_reload(spark: SparkSession, d: str) -> DataFrame:
    """Rows of relationships that redelivery added, as a multiset difference with the distinct rows."""
    r = table(spark, d, "relationships", "id", "doc_id", "other_doc_id", "relation")
    return g.multiset_difference(r, r.distinct()).groupBy("surplus").agg(F.count(F.lit(1)).alias("n_rows"))


def gate_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Candidates against the record catalog, by status and missing fields."""
    catalog = table(spark, d, "records", "record_id", "corpus_sha256", "canonical_identifier", "ingested_at").groupBy("record_id").agg(*[F.max_by(c, F.struct("ingested_at", c)).alias(c) for c in ("corpus_sha256", "canonical_identifier")])
    m = g.resolved(table(spark, d, "candidates", "candidate_id", "record_id").distinct(), catalog, "record_id", ["corpus_sha256", "canonical_identifier"])
    return m.groupBy("status", "missing").agg(F.count(F.lit(1)).alias("n"))


def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per reason code."""
    c = table(spark, d, "candidates", "candidate_id", "state", "reason_codes_json").distinct()
    codes = F.explode(F.regexp_extract_all("reason_codes_json", F.lit('"([A-Z_]+)"'), F.lit(1)))
    return c.select("candidate_id", "state", codes.alias("reason")).groupBy("reason", "state").agg(F.countDistinct("candidate_id").alias("n"))


def gate_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each record and role: official first, then the shortest provider, its name, address and id."""
    c = table(spark, d, "candidates", "candidate_id", "record_id", "role", "source_class", "provider_id", "final_url").where("record_id <> ''").distinct()
    rank = F.when(F.col("source_class") == "OFFICIAL", 0).otherwise(1)
    order = F.struct(rank, F.length("provider_id"), "provider_id", "final_url", "candidate_id")
    return c.groupBy("record_id", "role").agg(F.min_by("candidate_id", order).alias("candidate_id"), F.count(F.lit(1)).alias("n_candidates"))


def gate_gold(spark: SparkSession, d: str) -> DataFrame:
    """Questions that break a rule for gold records, by rule."""
    q = table(spark, d, "questions", "query_id", "question", "query_date", "gold_unit_ids", "review_status").distinct()
    n = F.coalesce(F.size("gold_unit_ids"), F.lit(0))
    rules = {
        "NO_QUESTION": is_blank(F.col("question")), "NO_DATE": is_blank(F.col("query_date")), "BAD_DATE": ~is_blank(F.col("query_date")) & parse_date(F.col("query_date")).isNull(),
        "NO_UNITS": n == 0, "REPEATED_UNITS": (n > 0) & (F.size(F.array_distinct("gold_unit_ids")) < n), "NOT_REVIEWED": F.coalesce(F.col("review_status"), F.lit("")) == "DRAFT",
    }
    return g.rule_rows(q, "query_id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def state_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user and second, and of the hour that ends with it."""
    return s.rolling_counts(table(spark, d, "events", "user_id", "ts"), "user_id", "ts", 3600)


def state_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Requests by user and type as one key: new, repeated with the same content, conflicting."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    return s.idempotent(e, ["user_id", "event_type"], "props", ["ts", "event_id"])


def state_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Order lines that still fit a budget of 200 pieces of their part, in order of shipping, by part."""
    rows = s.budgets(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 200.0)
    return rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("allowed").alias("n_allowed"))


def state_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, six hours apart: sessions, events and the longest session."""
    w = s.sessions(table(spark, d, "events", "user_id", "ts"), "user_id", "ts", 21600)
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("most_events"))


def state_last_seen(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    return s.last_seen(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_id", "event_type")


def state_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a conversation: type of the last run, its length, changes before."""
    return s.conversation(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


def state_changes(spark: SparkSession, d: str) -> DataFrame:
    """How the type of a user's events went: kinds, first and last."""
    return s.changes(table(spark, d, "events", "user_id", "ts", "event_type"), "user_id", "ts", "event_type")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith(("gate_", "state_"))}

_B = "({c} IS NULL OR trim({c}) = '')"
_VF, _VT = DATE_SQL.format(c="valid_from"), DATE_SQL.format(c="valid_to")
_RULES = {
    "NO_TEXT": f"{_B.format(c='text')} AND {_B.format(c='heading')}", "NO_SPAN": "char_start IS NULL OR char_end IS NULL", "SPAN_BACKWARD": "char_end < char_start", "SPAN_LENGTH": "char_end - char_start <> length(text)",
    "LINES_BACKWARD": "line_end < line_start", "BAD_START": f"NOT {_B.format(c='valid_from')} AND {_VF} IS NULL", "BAD_END": f"NOT {_B.format(c='valid_to')} AND {_VT} IS NULL", "END_BEFORE_START": f"{_VT} <= {_VF}",
}
_GOLD = {
    "NO_QUESTION": _B.format(c="question"), "NO_DATE": _B.format(c="query_date"), "BAD_DATE": f"NOT {_B.format(c='query_date')} AND {DATE_SQL.format(c='query_date')} IS NULL", "NO_UNITS": "coalesce(len(gold_unit_ids), 0) = 0",
    "REPEATED_UNITS": "len(gold_unit_ids) > 0 AND len(list_distinct(gold_unit_ids)) < len(gold_unit_ids)", "NOT_REVIEWED": "coalesce(review_status, '') = 'DRAFT'",
}
_KEYS = (("provisions", "provision_id", "provision_id, parent_id, ingested_at"), ("content", "id", "id, text_sha256, ingested_at, deleted_at"), ("records", "record_id", "record_id, state, ingested_at, deleted_at"), ("questions", "query_id", "query_id, question, query_date"))
_PRINT = (
    ("records", ("record_id", "state", "canonical_identifier", "metadata_json")), ("candidates", ("candidate_id", "record_id", "state", "final_url", "metadata_json")),
    ("evidence", ("evidence_id", "candidate_id", "payload_json")), ("relationships", ("id", "doc_id", "other_doc_id", "relation", "payload_json")), ("content", ("id", "text", "payload_json")),
)

SQL = {
    "gate_validation": "WITH p AS (SELECT DISTINCT provision_id, level, text, heading, char_start, char_end, line_start, line_end, valid_from, valid_to FROM provisions) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, coalesce(level, '') AS level, count(*) AS n FROM p WHERE {v} GROUP BY 2" for k, v in _RULES.items()),
    "gate_duplicates": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) FILTER (WHERE m > 1) AS n_changed FROM (SELECT sum(c) AS n, count(*) AS m FROM (SELECT {c}, count(*) AS c FROM {n} GROUP BY ALL) GROUP BY {k} HAVING sum(c) > 1)" for n, k, c in _KEYS),
    "gate_structure": "SELECT document_id, " + ", ".join(f"count(*) FILTER (WHERE level = '{v}') AS {v.lower()}" for v in ("PART", "CHAPTER", "SECTION", "ARTICLE", "CLAUSE", "POINT", "SUBPOINT")) + " FROM (SELECT DISTINCT provision_id, document_id, level FROM provisions WHERE document_id IS NOT NULL) GROUP BY 1",
    "gate_fingerprints": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5({' || chr(31) || '.join(f'coalesce({c}, chr(0))' for c in cs)}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM {n}" for n, cs in _PRINT),
    "gate_reload": "SELECT surplus, count(*) AS n_rows FROM (SELECT count(*) - 1 AS surplus FROM relationships GROUP BY id, doc_id, other_doc_id, relation HAVING count(*) > 1) GROUP BY 1",
    "gate_catalog": """WITH k AS (SELECT record_id, arg_max(corpus_sha256, (ingested_at, corpus_sha256)) AS a, arg_max(canonical_identifier, (ingested_at, canonical_identifier)) AS b FROM records GROUP BY 1),
 m AS (SELECT array_to_string(list_filter([CASE WHEN trim(coalesce(a, '')) = '' THEN 'corpus_sha256' END, CASE WHEN trim(coalesce(b, '')) = '' THEN 'canonical_identifier' END], lambda x: x IS NOT NULL), ',') AS missing FROM (SELECT DISTINCT candidate_id, record_id FROM candidates) c LEFT JOIN k ON c.record_id = k.record_id)
 SELECT CASE WHEN missing = '' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, missing, count(*) AS n FROM m GROUP BY 1, 2""",
    "gate_reasons": "SELECT reason, state, count(DISTINCT candidate_id) AS n FROM (SELECT candidate_id, state, unnest(regexp_extract_all(reason_codes_json, '\"([A-Z_]+)\"', 1)) AS reason FROM candidates) GROUP BY 1, 2",
    "gate_best_candidate": "WITH c AS (SELECT DISTINCT candidate_id, record_id, role, source_class, provider_id, final_url FROM candidates WHERE record_id <> '') SELECT record_id, role, candidate_id, n_candidates FROM (SELECT *, count(*) OVER (PARTITION BY record_id, role) AS n_candidates, row_number() OVER (PARTITION BY record_id, role ORDER BY CASE WHEN source_class = 'OFFICIAL' THEN 0 ELSE 1 END, length(provider_id) NULLS FIRST, provider_id NULLS FIRST, final_url NULLS FIRST, candidate_id NULLS FIRST) AS rn FROM c) WHERE rn = 1",
    "gate_gold": "WITH q AS (SELECT DISTINCT query_id, question, query_date, gold_unit_ids, review_status FROM questions) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS rule, count(*) AS n FROM q WHERE {v}) WHERE n > 0" for k, v in _GOLD.items()),
    "state_rolling": "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) SELECT user_id, second, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_window FROM e",
    "state_idempotent": "WITH f AS (SELECT user_id, event_type, arg_min(props, (ts, event_id)) AS p FROM events GROUP BY 1, 2) SELECT e.user_id, e.event_type, 1 AS n_new, count(*) FILTER (WHERE props IS NOT DISTINCT FROM p) - 1 AS n_repeated, count(*) FILTER (WHERE props IS DISTINCT FROM p) AS n_conflict FROM events e JOIN f ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.event_type IS NOT DISTINCT FROM f.event_type GROUP BY 1, 2",
    "state_budgets": "SELECT l_partkey, count(*) AS n_lines, count(*) FILTER (WHERE s <= 200) AS n_allowed FROM (SELECT l_partkey, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) GROUP BY 1",
    "state_sessions": "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), n AS (SELECT user_id, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e), c AS (SELECT user_id, s, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS most_events FROM c GROUP BY 1",
    "state_last_seen": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "state_conversation": "WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), m AS (SELECT user_id, max(run) AS run FROM r GROUP BY 1) SELECT user_id, any_value(event_type) AS topic, least(count(*), 20) AS n_turns, CAST(any_value(run) - 1 AS BIGINT) AS n_changes FROM r JOIN m USING (user_id, run) GROUP BY 1",
    "state_changes": "SELECT user_id, count(DISTINCT event_type) AS n_values, arg_min(event_type, (ts, event_type)) AS first_value, arg_max(event_type, (ts, event_type)) AS last_value FROM events WHERE user_id IS NOT NULL GROUP BY 1",
}
