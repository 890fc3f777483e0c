"""The numbered general problems as queries over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dates import DATE_SQL, parse_date
from quern.operators.asof import SHARD_ROWS, as_known
from quern.operators.hierarchy import descendants, hierarchy
from quern.operators.intervals import day_number, periods_and_gaps, usable_intervals
from quern.operators.references import compressed, live_rows, micros, orphans, reference_rows
from quern.sources.tables import table


def _nodes(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    rows = table(spark, d, "provisions", "provision_id", "parent_id", "order_index", "ingested_at")
    return hierarchy(rows, "provision_id", "parent_id", "ingested_at", "order_index", with_path)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every provision; CYCLE and -1 on or below a circle."""
    return hierarchy(table(spark, d, "provisions", "provision_id", "parent_id", "ingested_at"), "provision_id", "parent_id", "ingested_at", with_path=False).select(F.col("node").alias("provision_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Full path, nested-set range and number of descendants of every provision."""
    n = _nodes(spark, d, True)
    return n.select(
        F.col("node").alias("provision_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path", (F.col("root") == "CYCLE").alias("in_circle"),
        F.col("preorder").cast("long").alias("preorder"), (F.col("size") - 1).cast("long").alias("n_descendants"),
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair of provisions with the number of steps between."""
    return descendants(_nodes(spark, d, False)).select(F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references in the common form, and those without a live target."""
    targets = {"candidates": ("records", "record_id"), "evidence": ("candidates", "candidate_id"), "relationships": ("content", "id")}
    sources = {"candidates": ("candidate_id", "record_id", "ingested_at"), "evidence": ("evidence_id", "candidate_id", "fetched_at"), "relationships": ("id", "other_doc_id", "ingested_at")}
    refs = runs = None
    for name, (row_key, ref, at) in sources.items():
        target, key = targets[name]
        # keys of different targets are kept apart by the name of the referring table
        r = reference_rows(table(spark, d, name, *dict.fromkeys((row_key, ref, at))), name, row_key, ref, at).where("key <> ''").withColumn("key", F.concat_ws("\t", F.lit(name), "key"))
        t = live_rows(table(spark, d, target, key, "ingested_at", "deleted_at"), key, "ingested_at", "deleted_at").withColumn("key", F.concat_ws("\t", F.lit(name), "key"))
        refs = r if refs is None else refs.unionByName(r)
        runs = t if runs is None else runs.unionByName(t)
    return refs, orphans(refs, compressed(runs))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is missing, deleted or ingested later, by table and month."""
    return _orphans(spark, d)[1].select("table_name", "ref_month", "row_key").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans counted per table and month."""
    refs, lost = _orphans(spark, d)
    every = refs.where("at IS NOT NULL").groupBy("table_name", "ref_month").agg(F.count(F.lit(1)).alias("n_references"))
    gone = lost.groupBy("table_name", "ref_month").agg(F.count(F.lit(1)).alias("n"))
    return every.join(gone, ["table_name", "ref_month"], "left").select("table_name", "ref_month", "n_references", F.coalesce("n", F.lit(0)).alias("n_orphans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous validity periods of each unit and the gaps between them."""
    return periods_and_gaps(table(spark, d, "gold120_source_excerpts", "unit_id", "valid_from", "valid_to"), "unit_id", "valid_from", "valid_to")


def _known(spark: SparkSession, d: str, shard_rows: int) -> DataFrame:
    asked = (
        table(spark, d, "questions", "query_id", "query_date", "gold_unit_ids")
        .withColumn("day", day_number(parse_date(F.col("query_date"))))
        .where("day IS NOT NULL")
        .select(F.explode("gold_unit_ids").alias("entity"), F.col("query_id").alias("event"), "day")
    )
    known = usable_intervals(table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "valid_from", "valid_to", "recorded_at"), "valid_from", "valid_to").select(
        F.col("unit_id").alias("entity"), F.col("excerpt_id").alias("version"), F.col("__start").alias("start"), F.col("__end").alias("end"),
        day_number(F.col("recorded_at").cast("date")).alias("known_day"), micros(F.col("recorded_at")).alias("known"),
    )
    found = as_known(asked, known, shard_rows)
    return found.select(F.col("event").alias("query_id"), F.col("entity").alias("unit_id"), F.col("version").alias("excerpt_id")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """For each dated question and unit the excerpt valid and known at the question's date."""
    return _known(spark, d, SHARD_ROWS)


def p7_shards(spark: SparkSession, d: str) -> DataFrame:
    """The same with units cut into time shards of six rows, so that most are cut on these tables."""
    return _known(spark, d, 6)


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_descendants, p5_found, p5_report, p6_found, p7_found, p7_shards)}

_TREE_SQL = """WITH RECURSIVE latest AS (
 SELECT provision_id, nullif(parent_id, '') parent_id, order_index FROM (
  SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY ingested_at DESC NULLS LAST, parent_id DESC NULLS LAST, order_index DESC NULLS LAST) rn
  FROM provisions WHERE provision_id IS NOT NULL) WHERE rn = 1),
edges AS (SELECT l.provision_id, k.provision_id AS parent_id FROM latest l LEFT JOIN latest k ON l.parent_id = k.provision_id),
tree AS (
 SELECT provision_id, provision_id AS root_id, 0 AS depth, provision_id AS path FROM edges WHERE parent_id IS NULL
 UNION ALL
 SELECT e.provision_id, t.root_id, t.depth + 1, t.path || '/' || e.provision_id FROM edges e JOIN tree t ON e.parent_id = t.provision_id)"""

_ORPHAN_SQL = """WITH refs AS (
 SELECT DISTINCT 'candidates' table_name, strftime(ingested_at, '%Y-%m') ref_month, candidate_id row_key, record_id k, ingested_at t FROM candidates
 UNION ALL SELECT DISTINCT 'evidence', strftime(fetched_at, '%Y-%m'), evidence_id, candidate_id, fetched_at FROM evidence
 UNION ALL SELECT DISTINCT 'relationships', strftime(ingested_at, '%Y-%m'), id, other_doc_id, ingested_at FROM relationships),
targets AS (
 SELECT 'candidates' n, record_id k, ingested_at a, deleted_at b FROM records
 UNION ALL SELECT 'evidence', candidate_id, ingested_at, deleted_at FROM candidates
 UNION ALL SELECT 'relationships', id, ingested_at, deleted_at FROM content),
judged AS (
 SELECT r.*, EXISTS (SELECT 1 FROM targets x WHERE x.n = r.table_name AND x.k = r.k AND x.a <= r.t AND (x.b IS NULL OR r.t < x.b)) AS live
 FROM refs r WHERE r.k <> '' AND r.t IS NOT NULL)"""

_USABLE_SQL = f"""usable AS (
 SELECT * FROM (SELECT unit_id, excerpt_id, recorded_at, {DATE_SQL.format(c="valid_from")} AS a,
  CASE WHEN valid_to IS NULL OR trim(valid_to) = '' THEN DATE '9999-12-31' ELSE {DATE_SQL.format(c="valid_to")} END AS b
  FROM gold120_source_excerpts WHERE unit_id IS NOT NULL) WHERE a IS NOT NULL AND b > a)"""

SQL = {
    "p2_found": _TREE_SQL + " SELECT provision_id, root_id, depth FROM tree UNION ALL SELECT provision_id, 'CYCLE', -1 FROM latest WHERE provision_id NOT IN (SELECT provision_id FROM tree)",
    "p2_nodes": _TREE_SQL
    + """, sorted AS (
 SELECT provision_id, provision_id AS root_id, [struct_pack(p := -2147483648, i := provision_id)] AS s FROM edges WHERE parent_id IS NULL
 UNION ALL SELECT e.provision_id, t.root_id, list_append(t.s, struct_pack(p := coalesce(l.order_index, -2147483648), i := e.provision_id)) FROM edges e JOIN latest l ON l.provision_id = e.provision_id JOIN sorted t ON e.parent_id = t.provision_id),
up AS (SELECT provision_id, parent_id AS ancestor_id FROM edges WHERE parent_id IS NOT NULL AND provision_id IN (SELECT provision_id FROM tree)
 UNION ALL SELECT u.provision_id, e.parent_id FROM up u JOIN edges e ON u.ancestor_id = e.provision_id WHERE e.parent_id IS NOT NULL),
below AS (SELECT ancestor_id, count(*) AS n FROM up GROUP BY 1)
 SELECT t.provision_id, t.root_id, t.depth, t.path, false AS in_circle, row_number() OVER (PARTITION BY t.root_id ORDER BY s.s) - 1 AS preorder, coalesce(b.n, 0) AS n_descendants
 FROM tree t JOIN sorted s USING (provision_id) LEFT JOIN below b ON b.ancestor_id = t.provision_id
 UNION ALL SELECT provision_id, 'CYCLE', -1, NULL, true, NULL, NULL FROM latest WHERE provision_id NOT IN (SELECT provision_id FROM tree)""",
    "p2_descendants": _TREE_SQL
    + """, up AS (SELECT provision_id AS descendant_id, parent_id AS ancestor_id, 1 AS distance FROM edges WHERE parent_id IS NOT NULL AND provision_id IN (SELECT provision_id FROM tree)
 UNION ALL SELECT u.descendant_id, e.parent_id, u.distance + 1 FROM up u JOIN edges e ON u.ancestor_id = e.provision_id WHERE e.parent_id IS NOT NULL)
 SELECT ancestor_id, descendant_id, distance FROM up""",
    "p5_found": _ORPHAN_SQL + " SELECT DISTINCT table_name, ref_month, row_key FROM judged WHERE NOT live",
    "p5_report": _ORPHAN_SQL
    + """ SELECT table_name, ref_month, count(*) AS n_references, count(*) FILTER (WHERE NOT live) AS n_orphans FROM judged GROUP BY 1, 2""",
    "p6_found": "WITH "
    + _USABLE_SQL
    + """, marked AS (SELECT *, max(b) OVER (PARTITION BY unit_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM usable),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT unit_id, island, min(a) AS a, max(b) AS b FROM islands GROUP BY 1, 2),
nexts AS (SELECT *, lead(a) OVER (PARTITION BY unit_id ORDER BY island) AS c FROM periods)
SELECT unit_id, 'PERIOD' AS kind, strftime(a, '%Y-%m-%d') AS start_date, CASE WHEN b = DATE '9999-12-31' THEN '' ELSE strftime(b, '%Y-%m-%d') END AS end_date FROM periods
UNION ALL SELECT unit_id, 'GAP', strftime(b, '%Y-%m-%d'), strftime(c, '%Y-%m-%d') FROM nexts WHERE c IS NOT NULL""",
    "p7_found": "WITH "
    + _USABLE_SQL
    + f""", asked AS (SELECT DISTINCT query_id, unnest(gold_unit_ids) AS unit_id, {DATE_SQL.format(c="query_date")} AS q FROM questions),
ranked AS (SELECT query_id, a.unit_id, excerpt_id, row_number() OVER (PARTITION BY query_id, a.unit_id, q ORDER BY u.a DESC, recorded_at DESC, excerpt_id DESC) AS rn
 FROM asked a JOIN usable u ON a.unit_id = u.unit_id AND u.a <= a.q AND (a.q < u.b OR u.b = DATE '9999-12-31') AND CAST(recorded_at AS DATE) <= a.q)
SELECT DISTINCT query_id, unit_id, excerpt_id FROM ranked WHERE rn = 1""",
}
SQL["p7_shards"] = SQL["p7_found"]
