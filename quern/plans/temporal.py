"""Valid-time filters, version checks and period splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dates import DATE_SQL, is_blank, parse_date
from quern.operators.asof import as_known
from quern.operators.intervals import OPEN, usable_intervals
from quern.sources.tables import table

#: Day of the point-in-time queries, and the window of the range query.
AS_OF, WINDOW = "2020-01-01", ("2019-01-01", "2020-12-31")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "unit_id", "valid_from", "valid_to").distinct()
    return usable_intervals(g, "valid_from", "valid_to").select("excerpt_id", "unit_id", "__start", "__end")


def temporal_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Provisions valid on a day, by level; an unusable interval is never valid."""
    p = table(spark, d, "provisions", "provision_id", "level", "valid_from", "valid_to").distinct()
    day = F.unix_date(F.lit(AS_OF).cast("date"))
    valid = usable_intervals(p, "valid_from", "valid_to").where((F.col("__start") <= day) & (day < F.col("__end")))
    return valid.groupBy("level").agg(F.countDistinct("provision_id").alias("n_provisions"))


def temporal_range_filter(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts kept for a closed range of days, with a warning where they hold for a part of it only."""
    a, b = (F.unix_date(F.lit(x).cast("date")) for x in WINDOW)
    rows = _intervals(spark, d).where((F.col("__start") <= b) & (F.col("__end") > a))
    return rows.select("excerpt_id", ((F.col("__start") > a) | (F.col("__end") <= b)).alias("part_only"))


def temporal_date_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Question dates by notation and by whether they are a calendar date."""
    q = table(spark, d, "questions", "query_id", "query_date").distinct()
    x = F.col("query_date")
    kind = F.when(is_blank(x), "BLANK").when(x.rlike(r"^\d{4}-"), "YEAR_FIRST").when(x.rlike(r"^\d{1,2}/"), "DAY_FIRST").otherwise("OTHER")
    return q.groupBy(kind.alias("notation"), parse_date(x).isNotNull().alias("is_date")).agg(F.count(F.lit(1)).alias("n"))


def temporal_date_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Full dates and years that questions mention, with precision; impossible dates are left out."""
    q = table(spark, d, "questions", "query_id", "question").where("question IS NOT NULL").distinct()
    full = q.select("query_id", F.explode(F.regexp_extract_all("question", F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))).alias("quote")).select("query_id", F.lit("DAY").alias("precision"), parse_date(F.col("quote")).alias("start"))
    rest = F.regexp_replace("question", r"\d{1,2}/\d{1,2}/\d{4}", " ")
    year = q.select("query_id", F.explode(F.regexp_extract_all(rest, F.lit(r"năm ((?:19|20)\d{2})"), F.lit(1))).alias("y")).select("query_id", F.lit("YEAR").alias("precision"), F.concat("y", F.lit("-01-01")).try_cast("date").alias("start"))
    found = full.unionByName(year).where("start IS NOT NULL").distinct()
    return found.select("query_id", "precision", F.date_format("start", "yyyy-MM-dd").alias("start_date"))


def temporal_period_split(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's time cut at every boundary of its versions, with the number of versions valid in each slice.

    Boundaries are counted up and down per day before the window, so a unit brings
    at most one row per calendar day to it.
    """
    rows = _intervals(spark, d)
    steps = rows.select("unit_id", F.col("__start").alias("day"), F.lit(1).alias("step")).unionByName(rows.select("unit_id", F.col("__end").alias("day"), F.lit(-1).alias("step")))
    daily = steps.groupBy("unit_id", "day").agg(F.sum("step").alias("step"))
    w = Window.partitionBy("unit_id").orderBy("day")
    cut = daily.withColumn("n_valid", F.sum("step").over(w)).withColumn("until", F.lead("day").over(w)).where("until IS NOT NULL")
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return cut.select("unit_id", text("day").alias("start_date"), F.when(F.col("until") == OPEN, "").otherwise(text("until")).alias("end_date"), "n_valid")


def temporal_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Units with versions that overlap, and on how many days more than one is valid."""
    rows = temporal_period_split(spark, d).where("n_valid > 1 AND end_date <> ''")
    return rows.groupBy("unit_id").agg(F.sum(F.datediff(F.col("end_date").cast("date"), F.col("start_date").cast("date"))).cast("long").alias("n_days"), F.max("n_valid").alias("most_valid"))


def temporal_wrong_versions(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of question: gold units, and those without any version valid at the question's date."""
    q = table(spark, d, "questions", "query_id", "query_type", "query_date", "gold_unit_ids").distinct()
    asked = q.withColumn("day", F.unix_date(parse_date(F.col("query_date")))).where("day IS NOT NULL").select("query_id", "query_type", "day", F.explode(F.array_distinct("gold_unit_ids")).alias("unit_id"))
    # the as-of join looks at each day of a unit once, so a unit that many ask about never meets all its versions
    versions = _intervals(spark, d).select(F.col("unit_id").alias("entity"), F.col("excerpt_id").alias("version"), F.col("__start").alias("start"), F.col("__end").alias("end"), F.col("__start").alias("known_day"), F.lit(0).alias("known"))
    found = as_known(asked.select(F.col("unit_id").alias("entity"), F.col("query_id").alias("event"), "day"), versions)
    valid = found.select(F.col("event").alias("query_id"), F.col("entity").alias("unit_id"), F.lit(1).alias("ok")).distinct()
    return asked.join(valid, ["query_id", "unit_id"], "left").groupBy("query_type").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("ok").isNull()).alias("n_without"))


def temporal_late_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions by the years between the day they took effect and the day they became known."""
    g = table(spark, d, "gold120_source_excerpts", "excerpt_id", "valid_from", "recorded_at").distinct()
    lag = F.datediff(F.col("recorded_at").cast("date"), parse_date(F.col("valid_from")))
    rows = g.withColumn("lag", lag).where("lag IS NOT NULL")
    years = F.when(F.col("lag") <= 0, -1).otherwise(F.floor(F.col("lag") / 365)).cast("int")
    return rows.groupBy(years.alias("years_late")).agg(F.count(F.lit(1)).alias("n"))


def temporal_order_versions(spark: SparkSession, d: str) -> DataFrame:
    """Validity of each customer's orders as versions: from the order to the next one of the day after or later."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    daily = o.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("price"))
    rows = daily.withColumn("until", F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day")))
    return rows.select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("start_date"), F.coalesce(F.date_format("until", "yyyy-MM-dd"), F.lit("")).alias("end_date"), "price")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith("temporal_")}

_D = DATE_SQL.format
_BLANK = "({c} IS NULL OR trim({c}) = '')"


def _usable(source: str, columns: str) -> str:
    return f"""(SELECT * FROM (SELECT DISTINCT {columns}, {_D(c="valid_from")} AS a, CASE WHEN {_BLANK.format(c="valid_to")} THEN DATE '9999-12-31' ELSE {_D(c="valid_to")} END AS b, {_BLANK.format(c="valid_to")} AS o FROM {source}) WHERE a IS NOT NULL AND b > a)"""


_SPLIT = f"""WITH i AS {_usable("gold120_source_excerpts", "excerpt_id, unit_id")},
 s AS (SELECT unit_id, a AS day, 1 AS step FROM i UNION ALL SELECT unit_id, b, -1 FROM i), d AS (SELECT unit_id, day, sum(step) AS step FROM s GROUP BY 1, 2),
 c AS (SELECT unit_id, day, sum(step) OVER w AS n_valid, lead(day) OVER w AS until FROM d WINDOW w AS (PARTITION BY unit_id ORDER BY day)),
 p AS (SELECT unit_id, strftime(day, '%Y-%m-%d') AS start_date, CASE WHEN until = DATE '9999-12-31' THEN '' ELSE strftime(until, '%Y-%m-%d') END AS end_date, n_valid FROM c WHERE until IS NOT NULL)"""

SQL = {
    "temporal_point_in_time": f"SELECT level, count(DISTINCT provision_id) AS n_provisions FROM {_usable('provisions', 'provision_id, level')} WHERE a <= DATE '{AS_OF}' AND (o OR DATE '{AS_OF}' < b) GROUP BY 1",
    "temporal_range_filter": f"SELECT excerpt_id, (a > DATE '{WINDOW[0]}' OR (NOT o AND b <= DATE '{WINDOW[1]}')) AS part_only FROM {_usable('gold120_source_excerpts', 'excerpt_id, unit_id')} WHERE a <= DATE '{WINDOW[1]}' AND b > DATE '{WINDOW[0]}'",
    "temporal_date_kinds": f"SELECT CASE WHEN {_BLANK.format(c='query_date')} THEN 'BLANK' WHEN regexp_matches(query_date, '^\\d{{4}}-') THEN 'YEAR_FIRST' WHEN regexp_matches(query_date, '^\\d{{1,2}}/') THEN 'DAY_FIRST' ELSE 'OTHER' END AS notation, {_D(c='query_date')} IS NOT NULL AS is_date, count(*) AS n FROM (SELECT DISTINCT query_id, query_date FROM questions) GROUP BY 1, 2",
    "temporal_date_mentions": f"""WITH q AS (SELECT DISTINCT query_id, question FROM questions WHERE question IS NOT NULL),
 f AS (SELECT query_id, 'DAY' AS precision, {_D(c="x")} AS start FROM (SELECT query_id, unnest(regexp_extract_all(question, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1)) AS x FROM q)),
 y AS (SELECT query_id, 'YEAR', CAST(x || '-01-01' AS DATE) FROM (SELECT query_id, unnest(regexp_extract_all(regexp_replace(question, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}', ' ', 'g'), 'năm ((?:19|20)\\d{{2}})', 1)) AS x FROM q))
 SELECT DISTINCT query_id, precision, strftime(start, '%Y-%m-%d') AS start_date FROM (SELECT * FROM f UNION ALL SELECT * FROM y) WHERE start IS NOT NULL""",
    "temporal_period_split": _SPLIT + " SELECT * FROM p",
    "temporal_overlaps": _SPLIT + " SELECT unit_id, CAST(sum(CAST(end_date AS DATE) - CAST(start_date AS DATE)) AS BIGINT) AS n_days, max(n_valid) AS most_valid FROM p WHERE n_valid > 1 AND end_date <> '' GROUP BY 1",
    "temporal_wrong_versions": f"""WITH i AS {_usable("gold120_source_excerpts", "unit_id")}, q AS (SELECT DISTINCT query_id, query_type, {_D(c="query_date")} AS day, unnest(list_distinct(gold_unit_ids)) AS unit_id FROM questions)
 SELECT query_type, count(*) AS n_units, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.unit_id = q.unit_id AND a <= day AND (o OR day < b))) AS n_without FROM q WHERE day IS NOT NULL GROUP BY 1""",
    "temporal_late_versions": f"SELECT CASE WHEN lag <= 0 THEN -1 ELSE CAST(floor(lag / 365) AS INT) END AS years_late, count(*) AS n FROM (SELECT DISTINCT excerpt_id, CAST(recorded_at AS DATE) - {_D(c='valid_from')} AS lag, recorded_at, valid_from FROM gold120_source_excerpts) WHERE lag IS NOT NULL GROUP BY 1",
    "temporal_order_versions": "SELECT o_custkey, strftime(day, '%Y-%m-%d') AS start_date, coalesce(strftime(lead(day) OVER (PARTITION BY o_custkey ORDER BY day), '%Y-%m-%d'), '') AS end_date, price FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)",
}
