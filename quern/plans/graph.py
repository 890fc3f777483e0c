"""Property graph queries over provisions, content relations and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.graph import best_first, blocked, communities, components, dangling, degrees, expand, next_edges
from quern.operators.hierarchy import descendants, hierarchy, latest_parents
from quern.operators.retrieval import dense
from quern.session import checkpointed
from quern.sources.tables import table

#: What a step along a relation is worth.
RELATION_WEIGHTS = {"Văn bản bị thay thế": 1.0, "Văn bản sửa đổi": 0.9, "Văn bản được hướng dẫn": 0.7, "Văn bản căn cứ": 0.6, "Văn bản liên quan": 0.3, "CITES_CANDIDATE": 0.2}


def _relations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships", "id", "doc_id", "other_doc_id", "relation").distinct()
    return r.where("doc_id <> '' AND other_doc_id <> ''").select(F.col("doc_id").alias("source"), F.col("other_doc_id").alias("target"), F.col("relation").alias("type"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provisions", "provision_id", "parent_id", "order_index", "ingested_at")
    return latest_parents(p, "provision_id", "parent_id", "ingested_at", "order_index")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the corpus graph by label."""
    parts = [("PROVISION", "provisions", "provision_id"), ("DOCUMENT", "provisions", "document_id"), ("CONTENT", "content", "id"), ("RECORD", "records", "record_id"), ("CANDIDATE", "candidates", "candidate_id")]
    ids = None
    for label, name, key in parts:
        one = table(spark, d, name, key).where(f"{key} <> ''").select(F.lit(label).alias("label"), F.col(key).alias("id")).distinct()
        ids = one if ids is None else ids.unionByName(one)
    return ids.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("id").alias("first_id"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the corpus graph by type: hierarchy, origin and relations."""
    p = _parents(spark, d).where("parent IS NOT NULL").select(F.lit("PART_OF").alias("type"), F.col("node").alias("source"), F.col("parent").alias("target"))
    c = table(spark, d, "candidates", "candidate_id", "record_id").where("record_id <> ''").select(F.lit("CANDIDATE_OF").alias("type"), F.col("candidate_id").alias("source"), F.col("record_id").alias("target")).distinct()
    e = table(spark, d, "evidence", "evidence_id", "candidate_id").where("candidate_id <> ''").select(F.lit("EVIDENCE_OF").alias("type"), F.col("evidence_id").alias("source"), F.col("candidate_id").alias("target")).distinct()
    r = _relations(spark, d).select("type", "source", "target").distinct()
    return p.unionByName(c).unionByName(e).unionByName(r).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


def graph_next(spark: SparkSession, d: str) -> DataFrame:
    """Each provision and the sibling behind it."""
    return next_edges(_parents(spark, d), "node", "parent", ["position"])


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """In, out and total degree of every text that relations touch."""
    return degrees(_relations(spark, d))


def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose target never was a content row, by type."""
    nodes = table(spark, d, "content", "id")
    return dangling(_relations(spark, d), nodes, "target").groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the relations between texts."""
    return components(_relations(spark, d))


def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of at least three texts by label propagation over their relations until it is stable."""
    return communities(_relations(spark, d))


def graph_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """Texts within two relation steps of a repealing one, with the least number of steps."""
    r = _relations(spark, d)
    return expand(r.where("type = 'Văn bản bị thay thế'").select(F.col("source").alias("id")), r, 2)


def graph_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Provisions left after those without a text and heading, and all below them, are taken out; circles too."""
    rows = table(spark, d, "provisions", "provision_id", "parent_id", "order_index", "ingested_at")
    nodes = hierarchy(rows, "provision_id", "parent_id", "ingested_at", "order_index", with_path=False)
    told = table(spark, d, "provisions", "provision_id", "text", "heading").where("trim(coalesce(text, '')) <> '' OR trim(coalesce(heading, '')) <> ''").select("provision_id").distinct()
    nodes = checkpointed(nodes)
    empty = nodes.select("node").join(told, F.col("node") == F.col("provision_id"), "left_anti")
    gone = empty.unionByName(descendants(nodes, empty).select(F.col("descendant").alias("node"))).distinct()
    return nodes.where("depth >= 0").join(gone, "node", "left_anti").groupBy("depth").agg(F.count(F.lit(1)).alias("n_provisions"))


def graph_issues(spark: SparkSession, d: str) -> DataFrame:
    """Why a provision cannot be used, each reason once: CIRCLE, ORPHAN, SHORT, AMBIGUOUS place, or BELOW a short or ambiguous one.

    SHORT: no point, and less than ten characters of text and heading; AMBIGUOUS: a
    sibling has the same level and number. The row ingested last counts.
    """
    fields = ["parent_id", "document_id", "order_index", "level", "number", "text", "heading"]
    last = table(spark, d, "provisions", "provision_id", "ingested_at", *fields).where("provision_id IS NOT NULL")
    newest = F.max(F.struct("ingested_at", "parent_id", "order_index", "document_id", "level", "number", (F.length(F.trim(F.coalesce("text", F.lit("")))) + F.length(F.trim(F.coalesce("heading", F.lit(""))))).alias("n")))
    last = checkpointed(last.groupBy(F.col("provision_id").alias("node")).agg(newest.alias("r")).select("node", "r.*"))
    nodes = checkpointed(hierarchy(last, "node", "parent_id", "ingested_at", "order_index", with_path=False))
    # siblings of one level and number are counted by an aggregate, so a hot parent is reduced before the shuffle
    told = nodes.where("depth >= 0").select("node", "parent").join(last.select("node", "document_id", "level", "number", "n", "parent_id"), "node")
    twice = told.where("parent IS NOT NULL AND number <> ''").groupBy("parent", "level", "number").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    ambiguous = told.join(twice, ["parent", "level", "number"], "left_semi").select("node")
    short = told.where("n < 10 AND level <> 'POINT' AND level <> 'SUBPOINT'").select("node")
    orphan = told.where("parent IS NULL AND parent_id <> '' AND parent_id <> document_id").select("node")
    below = descendants(nodes, ambiguous.unionByName(short)).select(F.col("descendant").alias("node")).distinct()
    out = nodes.where("depth < 0").select("node", F.lit("CIRCLE").alias("issue"))
    for issue, rows in (("ORPHAN", orphan), ("SHORT", short), ("AMBIGUOUS", ambiguous), ("BELOW", below)):
        out = out.unionByName(rows.select("node", F.lit(issue).alias("issue")))
    return out.withColumnRenamed("node", "provision_id")


def graph_best_first(spark: SparkSession, d: str) -> DataFrame:
    """From every replaced text the five best texts of each of two steps, by kind of relation and degree."""
    r = _relations(spark, d)
    return best_first(r.where("type = 'Văn bản bị thay thế'").select(F.col("source").alias("id")), r, RELATION_WEIGHTS, 2, 5)


def graph_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by whether those they come from are all there: READY, BLOCKED or CYCLE."""
    rows = table(spark, d, "candidates", "candidate_id", "parent_candidate_id", "ingested_at")
    last = checkpointed(rows.where("candidate_id IS NOT NULL").groupBy(F.col("candidate_id").alias("id")).agg(F.max(F.struct("ingested_at", "parent_candidate_id")).alias("r")).select("id", "r.ingested_at", F.col("r.parent_candidate_id").alias("needs")))
    nodes = hierarchy(last, "id", "needs", "ingested_at", with_path=False)
    return blocked(last, nodes).withColumnRenamed("id", "candidate_id")


def graph_units(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval units: every provision under the headings above it, joined by `` > ``, with its own text."""
    rows = table(spark, d, "provisions", "provision_id", "parent_id", "order_index", "ingested_at", "heading", "text").where("provision_id IS NOT NULL")
    last = checkpointed(rows.groupBy(F.col("provision_id").alias("node")).agg(F.max(F.struct("ingested_at", "parent_id", "order_index", "heading", "text")).alias("r")).select("node", "r.*"))
    nodes = hierarchy(last, "node", "parent_id", "ingested_at", "order_index").where("depth >= 0").select(F.col("node").alias("unit"), F.posexplode(F.split("path", "/")).alias("at", "node"))
    above = nodes.join(last.select("node", "heading"), "node").where("heading <> ''").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("at", "heading"))).alias("h"))
    crumbs = above.select("unit", F.array_join(F.col("h.heading"), " > ").alias("breadcrumb"))
    kept = nodes.groupBy("unit").agg(F.max("at").alias("depth"))
    told = kept.join(last.select(F.col("node").alias("unit"), "text"), "unit").join(crumbs, "unit", "left").select("unit", "depth", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), F.coalesce("text", F.lit("")).alias("text"))
    return told.select(F.col("unit").alias("provision_id"), "breadcrumb", F.md5(F.concat_ws("\n", "breadcrumb", "text")).alias("unit_md5"), F.length(F.concat_ws("\n", "breadcrumb", "text")).cast("long").alias("n_chars"))


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-neighbour edges from every vector to its five nearest, kept where the lower id chose."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    found = dense(e, e.withColumnRenamed("vec_id", "query_id"), 5)
    return found.where("query_id < vec_id").select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), "score")


def graph_star_levels(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation, customer and order as one hierarchy: children per level and root."""
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cn = c.join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
    oc = o.join(cn, F.col("o_custkey") == F.col("c_custkey"))
    level = lambda df, k: df.groupBy(F.col("r_name").alias("root")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(k))
    return level(nr, 1).unionByName(level(cn, 2)).unionByName(level(oc, 3)).select("root", "level", "n")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith("graph_")}

_LATEST = """latest AS (SELECT provision_id, nullif(parent_id, '') AS parent_id, order_index FROM (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY ingested_at DESC NULLS LAST, parent_id DESC NULLS LAST, order_index DESC NULLS LAST) rn FROM provisions WHERE provision_id IS NOT NULL) WHERE rn = 1),
 edges AS (SELECT l.provision_id AS node, k.provision_id AS parent, l.order_index AS position FROM latest l LEFT JOIN latest k ON l.parent_id = k.provision_id)"""
_REL = "r AS (SELECT DISTINCT id, doc_id AS source, other_doc_id AS target, relation AS type FROM relationships WHERE doc_id <> '' AND other_doc_id <> '')"

SQL = {
    "graph_nodes": "SELECT label, count(*) AS n_nodes, min(id) AS first_id FROM (SELECT 'PROVISION' AS label, provision_id AS id FROM provisions UNION SELECT 'DOCUMENT', document_id FROM provisions UNION SELECT 'CONTENT', id FROM content UNION SELECT 'RECORD', record_id FROM records UNION SELECT 'CANDIDATE', candidate_id FROM candidates) WHERE id <> '' GROUP BY 1",
    "graph_edges": f"WITH {_LATEST}, {_REL}, a AS (SELECT 'PART_OF' AS type, node AS source, parent AS target FROM edges WHERE parent IS NOT NULL UNION SELECT 'CANDIDATE_OF', candidate_id, record_id FROM candidates WHERE record_id <> '' UNION SELECT 'EVIDENCE_OF', evidence_id, candidate_id FROM evidence WHERE candidate_id <> '' UNION SELECT type, source, target FROM r) SELECT type, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM a GROUP BY 1",
    "graph_next": f"WITH {_LATEST} SELECT * FROM (SELECT lag(node) OVER (PARTITION BY parent ORDER BY position NULLS FIRST, node) AS source, node AS target FROM edges WHERE parent IS NOT NULL) WHERE source IS NOT NULL",
    "graph_degrees": f"WITH {_REL} SELECT id, sum(o) AS n_out, sum(i) AS n_in, sum(o + i) AS degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM r UNION ALL SELECT target, 0, 1 FROM r) GROUP BY 1",
    "graph_dangling": f"WITH {_REL} SELECT type, count(*) AS n_edges FROM r WHERE target NOT IN (SELECT id FROM content WHERE id IS NOT NULL) GROUP BY 1",
    "graph_components": f"WITH RECURSIVE {_REL}, u AS (SELECT source AS x, target AS y FROM r UNION SELECT target, source FROM r), reach AS (SELECT x, x AS y FROM u UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x) SELECT x AS id, min(y) AS component FROM reach GROUP BY 1",
    "graph_two_hops": f"WITH RECURSIVE {_REL}, u AS (SELECT source AS x, target AS y FROM r UNION SELECT target, source FROM r), walk AS (SELECT DISTINCT source AS id, 0 AS hop FROM r WHERE type = 'Văn bản bị thay thế' UNION SELECT u.y, hop + 1 FROM walk JOIN u ON walk.id = u.x WHERE hop < 2) SELECT id, min(hop) AS hop FROM walk GROUP BY 1",
    "graph_quarantine": f"""WITH RECURSIVE {_LATEST}, told AS (SELECT DISTINCT provision_id FROM provisions WHERE trim(coalesce(text, '')) <> '' OR trim(coalesce(heading, '')) <> ''),
 tree AS (SELECT node, 0 AS depth, node IN (SELECT provision_id FROM told) AS ok FROM edges WHERE parent IS NULL UNION ALL SELECT e.node, t.depth + 1, t.ok AND e.node IN (SELECT provision_id FROM told) FROM edges e JOIN tree t ON e.parent = t.node)
 SELECT depth, count(*) AS n_provisions FROM tree WHERE ok GROUP BY 1""",
    "graph_neighbours": """WITH s AS (SELECT q.vec_id AS source, e.vec_id AS target, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id)
 SELECT source, target, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rn FROM s) WHERE rn <= 5 AND source < target""",
    "graph_star_levels": "WITH nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), cn AS (SELECT * FROM customer JOIN nr ON c_nationkey = n_nationkey), oc AS (SELECT r_name FROM orders JOIN cn ON o_custkey = c_custkey) SELECT r_name AS root, 1 AS level, count(*) AS n FROM nr GROUP BY 1 UNION ALL SELECT r_name, 2, count(*) FROM cn GROUP BY 1 UNION ALL SELECT r_name, 3, count(*) FROM oc GROUP BY 1",
    "graph_issues": f"""WITH RECURSIVE r AS (SELECT provision_id AS node, parent_id, document_id, level, number, length(trim(coalesce(text, ''), ' ')) + length(trim(coalesce(heading, ''), ' ')) AS n FROM (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY ingested_at DESC NULLS LAST, parent_id DESC NULLS LAST, order_index DESC NULLS LAST, document_id DESC NULLS LAST, level DESC NULLS LAST, number DESC NULLS LAST) rn FROM provisions WHERE provision_id IS NOT NULL) WHERE rn = 1),
 e AS (SELECT a.*, b.node AS parent FROM r a LEFT JOIN r b ON nullif(a.parent_id, '') = b.node), tree AS (SELECT node FROM e WHERE parent IS NULL UNION ALL SELECT e.node FROM e JOIN tree t ON e.parent = t.node), t AS (SELECT * FROM e WHERE node IN (SELECT node FROM tree)),
 am AS (SELECT node FROM (SELECT node, count(*) OVER (PARTITION BY parent, level, number) AS k FROM t WHERE parent IS NOT NULL AND number <> '') WHERE k > 1), sh AS (SELECT node FROM t WHERE n < 10 AND level <> 'POINT' AND level <> 'SUBPOINT'),
 bl AS (SELECT t.node FROM t JOIN (SELECT node FROM am UNION SELECT node FROM sh) x ON t.parent = x.node UNION SELECT t.node FROM t JOIN bl ON t.parent = bl.node)
 SELECT node AS provision_id, 'CIRCLE' AS issue FROM e WHERE node NOT IN (SELECT node FROM tree) UNION ALL SELECT node, 'ORPHAN' FROM t WHERE parent IS NULL AND parent_id <> '' AND parent_id <> document_id
 UNION ALL SELECT node, 'SHORT' FROM sh UNION ALL SELECT node, 'AMBIGUOUS' FROM am UNION ALL SELECT node, 'BELOW' FROM bl""",
    "graph_best_first": f"WITH {_REL}, b AS (SELECT source, target, max(coalesce(w, 0)) AS gain FROM (SELECT source, target, type FROM r UNION ALL SELECT target, source, type FROM r) LEFT JOIN (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in RELATION_WEIGHTS.items())}) x(type, w) USING (type) WHERE source <> target GROUP BY 1, 2),"
    " dg AS (SELECT source AS target, count(*) AS degree FROM b GROUP BY 1), st AS (SELECT source, target, gain - 0.1 * ln(degree) AS gain FROM b JOIN dg USING (target)),"
    " s0 AS (SELECT DISTINCT source AS seed, source AS id, 0 AS hop, 0.0::DOUBLE AS score FROM r WHERE type = 'Văn bản bị thay thế')"
    + "".join(f", k{i} AS (SELECT seed, id, {i} AS hop, score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS p FROM (SELECT seed, target AS id, round(max(0.8 * score + gain), 6) AS score FROM s{i - 1} JOIN st ON id = source WHERE hop = {i - 1} GROUP BY 1, 2) n WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} o WHERE o.seed = n.seed AND o.id = n.id)) WHERE p <= 5), s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM k{i})" for i in (1, 2))
    + " SELECT seed, id, hop, score FROM s2",
    "graph_tasks": """WITH RECURSIVE l AS (SELECT candidate_id AS id, parent_candidate_id AS needs FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at DESC NULLS LAST, parent_candidate_id DESC NULLS LAST) rn FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn = 1),
 e AS (SELECT a.id, a.needs, b.id AS up FROM l a LEFT JOIN l b ON nullif(a.needs, '') = b.id), t AS (SELECT id, needs <> '' AS lacks FROM e WHERE up IS NULL UNION ALL SELECT e.id, t.lacks FROM e JOIN t ON e.up = t.id)
 SELECT id AS candidate_id, CASE WHEN lacks THEN 'BLOCKED' ELSE 'READY' END AS status FROM t UNION ALL SELECT id, 'CYCLE' FROM e WHERE id NOT IN (SELECT id FROM t)""",
    "graph_units": """WITH RECURSIVE l AS (SELECT provision_id AS node, nullif(parent_id, '') AS parent_id, heading, text FROM (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY ingested_at DESC NULLS LAST, parent_id DESC NULLS LAST, order_index DESC NULLS LAST, heading DESC NULLS LAST, text DESC NULLS LAST) rn FROM provisions WHERE provision_id IS NOT NULL) WHERE rn = 1),
 e AS (SELECT a.*, b.node AS up FROM l a LEFT JOIN l b ON a.parent_id = b.node), t AS (SELECT node, coalesce(heading, '') AS crumb, text FROM e WHERE up IS NULL UNION ALL SELECT e.node, CASE WHEN coalesce(e.heading, '') = '' THEN t.crumb WHEN t.crumb = '' THEN e.heading ELSE t.crumb || ' > ' || e.heading END, e.text FROM e JOIN t ON e.up = t.node)
 SELECT node AS provision_id, crumb AS breadcrumb, md5(crumb || chr(10) || coalesce(text, '')) AS unit_md5, length(crumb || chr(10) || coalesce(text, '')) AS n_chars FROM t""",
}
