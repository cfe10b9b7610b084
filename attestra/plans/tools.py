"""The tools of the catalog over a release made of the driver tables, each with its SQL: what the queries beside them do not cover.

company, filing and disclosure are as in proxies. Facts: a company-year's orders, as first reported and, a year later, without those that were pending. Auditors and
key audit matters: order priorities. Sections and notes: documents, dealt to companies and years by their number, known if they have labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import catalog
from attestra.plans import proxies as px
from attestra.plans.proxies import read
from attestra.plans.queries import query
from attestra.release import Release

#: Companies that documents are dealt to, and years from 1995 on.
FILERS, YEARS = 50, 5


def release(spark: SparkSession, sf_dir: str) -> Release:
    text = lambda c: F.col(c).cast("string")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), text("o_custkey").alias("corp"), F.year("o_orderdate").alias("fy"), "o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), px.money("o_totalprice").cast("decimal(38,2)").alias("value"))
    sums = orders.groupBy("corp", "fy").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("status") != "P", F.col("value"))).alias("again"), F.max("key").cast("string").alias("receipt"))
    fact = lambda year, account, value: sums.select("corp", "fy", (F.col("fy") + year).alias("reported_in"), F.lit(account).alias("account"), F.col(value).cast("decimal(38,2)").alias("value"), F.concat("receipt", F.lit("b" * year)).alias("receipt"))
    known = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    docs = read(spark, sf_dir, "documents").join(known, "doc_id", "left").withColumn("state", F.when(F.col("known"), "available").otherwise("unverified"))
    dealt = [(F.col("doc_id") % FILERS).cast("string").alias("corp"), (F.floor(F.col("doc_id") / FILERS) % YEARS + 1995).cast("int").alias("fy")]
    fee = lambda test: F.sum(F.when(test, F.col("value")).otherwise(0)).cast("decimal(38,2)")
    return Release(
        spark,
        {
            "company": px.companies(spark, sf_dir).select(text("corp").alias("corp"), "name", "code"),
            "filing": orders.select(text("key").alias("receipt"), "corp", "fy", F.col("priority").alias("report_type"), F.col("o_orderdate").alias("filed_at")),
            "fact": fact(0, "value", "value").unionByName(fact(1, "value", "again")).unionByName(fact(0, "settled", "again")).where("value IS NOT NULL"),
            "section": docs.select(F.concat(F.lit("d"), "doc_id").alias("receipt"), *dealt, F.when(F.col("doc_id") % 3 == 0, "procedure").otherwise("audit").alias("kind"), F.col("lang").alias("topic"), "text", F.lit(0).alias("start"), F.length("text").alias("end"), "state"),
            "note": docs.select(F.concat(F.lit("n"), "doc_id").alias("receipt"), *dealt, F.col("source").alias("topic"), F.substring("text", 1, 80).alias("excerpt"), F.struct(F.col("lang").alias("section"), F.lit(0).alias("start"), F.least(F.length("text"), F.lit(80)).alias("end")).alias("locator"), F.create_map(F.lit("lang"), F.col("lang")).alias("format"), "state"),
            "engagement": orders.groupBy("corp", "fy", F.col("priority").alias("auditor")).agg(fee(F.col("status") == "F").alias("audit_fee"), fee(F.col("status") != "F").alias("non_audit_fee"), F.when(F.count_if(F.col("status") == "P") > 0, "qualified").otherwise("unqualified").alias("opinion")),
            "kam": orders.groupBy("corp", "fy", F.col("priority").alias("topic")).agg(F.min("key").cast("string").alias("receipt")).select("corp", "fy", "topic", "receipt"),
            "disclosure": read(spark, sf_dir, "events").select(text("event_id").alias("event_id"), text("user_id").alias("corp"), "ts", F.col("event_type").alias("type"), F.col("props").alias("attrs")),
        },
    )


def everyone(r: Release) -> DataFrame:
    """The cohort of all companies, with company 0 as the target."""
    return r["company"].where("corp <> '0'").select(F.lit("0").alias("target"), F.col("corp").alias("peer"), F.lit("all").alias("rule"))


SQL = {
    "company": "company AS (SELECT CAST(c_custkey AS VARCHAR) AS corp, c_name AS name, CAST(n_regionkey AS VARCHAR) || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "fact": "fact AS (SELECT CAST(o_custkey AS VARCHAR) AS corp, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (WHERE o_orderstatus <> 'P') AS DOUBLE) AS settled FROM orders GROUP BY ALL)",
    "known": "known AS (SELECT d.*, CAST(d.doc_id % 50 AS VARCHAR) AS corp, CAST(d.doc_id // 50 % 5 + 1995 AS INTEGER) AS fy, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'available' ELSE 'unverified' END AS state FROM documents d)",
    "note": "note AS (SELECT corp, fy, source AS topic, 'n' || doc_id AS receipt, left(text, 80) AS excerpt, state, least(length(text), 80) AS last FROM known QUALIFY row_number() OVER (PARTITION BY corp, fy, source ORDER BY state, 'n' || doc_id) = 1)",
    "engagement": "engagement AS (SELECT CAST(o_custkey AS VARCHAR) AS corp, CAST(year(o_orderdate) AS INTEGER) AS fy, o_orderpriority AS auditor, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) ELSE 0 END) AS audit_fee, sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) ELSE 0 END) AS non_audit_fee FROM orders GROUP BY ALL)",
    "matter": "matter AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS corp, CAST(year(o_orderdate) AS INTEGER) AS fy, o_orderpriority AS topic FROM orders)",
    "topics": "topics AS (SELECT corp, fy, list_sort(list(DISTINCT lang)) AS topics FROM known GROUP BY corp, fy)",
    "context": """context AS (
  SELECT corp, fy, topics, n_notes, matters, n_events, n_accounts, CASE WHEN topics IS NOT NULL AND n_notes IS NOT NULL AND matters IS NOT NULL AND n_events IS NOT NULL AND n_accounts IS NOT NULL THEN 'available' ELSE 'summary_only' END AS state
  FROM topics FULL JOIN (SELECT corp, fy, count(*) AS n_notes FROM known GROUP BY corp, fy) USING (corp, fy)
    FULL JOIN (SELECT corp, fy, list_sort(list(topic)) AS matters FROM matter GROUP BY corp, fy) USING (corp, fy)
    FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS corp, CAST(year(ts) AS INTEGER) AS fy, count(*) AS n_events FROM events GROUP BY ALL) USING (corp, fy)
    FULL JOIN (SELECT corp, fy, 1 + count(settled) AS n_accounts FROM fact GROUP BY corp, fy) USING (corp, fy))""",
}


def sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join(SQL[p] for p in parts)} {body}"


@query(sql("SELECT c.corp, CAST(1996 AS INTEGER) AS fy, t.topic, n.receipt, CASE WHEN n.state = 'available' THEN n.excerpt END AS excerpt, n.last AS span_end, coalesce(n.state, 'unavailable') AS state, f.value, f.settled, 'all' AS rule FROM company c CROSS JOIN (SELECT unnest(['src0', 'src1']) AS topic) t LEFT JOIN note n ON n.corp = c.corp AND n.fy = 1996 AND n.topic = t.topic LEFT JOIN fact f ON f.corp = c.corp AND f.fy = 1996", "company", "fact", "known", "note"))
def tool_peer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_peer_accounting_notes of all companies."""
    r = release(spark, sf_dir)
    found = catalog.compare_peer_accounting_notes(r, everyone(r), 1996, ["src0", "src1"], ["value", "settled"])
    return found.select("corp", "fy", "topic", "receipt", "excerpt", F.col("locator.end").cast("long").alias("span_end"), "state", "value", "settled", "rule")


@query(
    sql(
        """SELECT '0' AS target, c.corp AS peer, CAST(1995 AS INTEGER) AS fy, 'src0' AS topic, n.receipt, shown.excerpt, mine.excerpt AS target_excerpt,
CASE WHEN shown.excerpt IS NOT NULL AND mine.excerpt IS NOT NULL THEN len(list_intersect(list_distinct(string_split_regex(lower(shown.excerpt), '\\s+')), list_distinct(string_split_regex(lower(mine.excerpt), '\\s+')))) / len(list_distinct(list_concat(string_split_regex(lower(shown.excerpt), '\\s+'), string_split_regex(lower(mine.excerpt), '\\s+')))) END AS similarity,
CASE WHEN n.state IS NULL OR mine.state IS NULL THEN 'unavailable' WHEN n.state = 'unverified' OR mine.state = 'unverified' THEN 'unverified' ELSE 'available' END AS state
FROM company c LEFT JOIN note n ON n.corp = c.corp AND n.fy = 1995 AND n.topic = 'src0'
LEFT JOIN (SELECT corp, excerpt FROM note WHERE fy = 1995 AND topic = 'src0' AND state = 'available') shown ON shown.corp = c.corp
LEFT JOIN (SELECT state, CASE WHEN state = 'available' THEN excerpt END AS excerpt FROM note WHERE corp = '0' AND fy = 1995 AND topic = 'src0') mine ON true WHERE c.corp <> '0'""",
        "company",
        "known",
        "note",
    )
)
def tool_peer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_peer_accounting_policies of all companies with company 0."""
    r = release(spark, sf_dir)
    return catalog.compare_peer_accounting_policies(r, everyone(r), 1995, "src0").select("target", "peer", "fy", "topic", "receipt", "excerpt", "target_excerpt", "similarity", "state")


@query(sql("SELECT corp, fy, audit_fee, non_audit_fee, non_audit_fee / nullif(audit_fee, 0) AS ratio, percent_rank() OVER (ORDER BY audit_fee) AS pct, 'available' AS state FROM (SELECT corp, CAST(fy AS INTEGER) AS fy, CAST(sum(audit_fee) AS DOUBLE) AS audit_fee, CAST(sum(non_audit_fee) AS DOUBLE) AS non_audit_fee FROM engagement WHERE fy = 1997 GROUP BY corp, fy) UNION ALL SELECT corp, CAST(1997 AS INTEGER), NULL, NULL, NULL, NULL, 'unavailable' FROM company WHERE corp NOT IN (SELECT corp FROM engagement WHERE fy = 1997)", "company", "engagement"))
def tool_peer_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_peer_audit_fees of all companies; one without an engagement is a row, too."""
    r = release(spark, sf_dir)
    return catalog.compare_peer_audit_fees(r, everyone(r), 1997).select("corp", "fy", "audit_fee", "non_audit_fee", "ratio", "pct", "state")


@query(sql("SELECT corp, fy, array_to_string(topics, ',') AS topics, n_notes, array_to_string(matters, ',') AS matters, n_events, n_accounts, state FROM context", "known", "fact", "matter", "topics", "context"))
def tool_company_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get_semantic_company_context of all companies."""
    found = catalog.get_semantic_company_context(release(spark, sf_dir))
    return found.select("corp", "fy", F.array_join("section_topics", ",").alias("topics"), "n_notes", F.array_join("matters", ",").alias("matters"), "n_events", "n_accounts", "state")


@query(sql("SELECT '0' AS target, c.corp AS peer, CAST(1995 AS INTEGER) AS fy, array_to_string(list_sort(list_intersect(x.topics, m.topics)), ',') AS shared, CASE WHEN x.topics IS NOT NULL THEN array_to_string(list_sort(list_filter(m.topics, lambda t: NOT list_contains(x.topics, t))), ',') END AS missing, x.n_notes, x.n_events, 'all' AS rule, coalesce(x.state, 'unavailable') AS state FROM company c LEFT JOIN context x ON x.corp = c.corp AND x.fy = 1995 LEFT JOIN (SELECT topics FROM context WHERE corp = '0' AND fy = 1995) m ON true WHERE c.corp <> '0'", "company", "known", "fact", "matter", "topics", "context"))
def tool_context_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """semantic_peer_context_review of all companies with company 0, by topics."""
    r = release(spark, sf_dir)
    told = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return catalog.semantic_peer_context_review(r, everyone(r), 1995).select("target", "peer", "fy", told("shared"), told("missing"), "n_notes", "n_events", "rule", "state")


FOUND = "SELECT corp, fy, 'd' || doc_id AS receipt, lang AS topic, CAST((length(text) - length(replace(lower(text), '{0}', ''))) / {1} AS BIGINT) AS score, state FROM known WHERE state = 'available' AND {2} AND contains(lower(text), '{0}') ORDER BY score DESC, receipt LIMIT {3}"


@query(sql(FOUND.format("ation", 5, "doc_id % 3 <> 0", 100), "known"))
def tool_search_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_audit_report_matters(release(spark, sf_dir), "ation", limit=100).drop("text", "start")


@query(sql(FOUND.format("er th", 5, "doc_id % 3 = 0", 100), "known"))
def tool_search_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_audit_procedures: sections of that kind only."""
    return catalog.search_audit_procedures(release(spark, sf_dir), "er th", limit=100).drop("text", "start")


@query(
    sql(
        """SELECT left(code, 2) AS industry, auditor, CAST(fee AS DOUBLE) AS fee, CASE WHEN level = 0 THEN CAST(fee AS DOUBLE) / CAST(sum(CASE WHEN level = 1 THEN fee END) OVER (PARTITION BY code) AS DOUBLE) END AS share,
CASE WHEN level = 0 THEN dense_rank() OVER (PARTITION BY code, level ORDER BY fee DESC) END AS rank, level, CAST(1998 AS INTEGER) AS fy, 'prefix:1' AS rule, 'summary_only' AS state
FROM (SELECT left(code, 2) AS code, auditor, sum(audit_fee + non_audit_fee) AS fee, CAST(grouping_id(left(code, 2), auditor) AS BIGINT) AS level FROM engagement JOIN company USING (corp) WHERE fy = 1998 AND code LIKE '1%' GROUP BY ROLLUP (left(code, 2), auditor))""",
        "company",
        "engagement",
    )
)
def tool_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get_industry_audit_landscape of the industries of one region."""
    return catalog.get_industry_audit_landscape(release(spark, sf_dir), "1", 1998)


@query(
    sql(
        """SELECT kind, id, label, CAST((length(text) - length(replace(lower(text), 'tion', ''))) / 4 AS BIGINT) AS score FROM (
SELECT 'company' AS kind, corp AS id, name AS label, name AS text FROM company
UNION ALL SELECT 'section', 'd' || doc_id, lang, text FROM known WHERE state = 'available'
UNION ALL SELECT 'note', 'n' || doc_id, source, left(text, 80) FROM known WHERE state = 'available'
UNION ALL SELECT 'disclosure', CAST(event_id AS VARCHAR), event_type, concat_ws(' ', event_type, props) FROM events)
WHERE contains(lower(text), 'tion') ORDER BY score DESC, kind, id, label LIMIT 500""",
        "company",
        "known",
    )
)
def tool_search_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_dataset(release(spark, sf_dir), "tion", 500)


@query(
    sql(
        """SELECT "table", fy, (SELECT count(*) FROM company) AS n_companies, n_sourced, n_sourced / (SELECT count(*) FROM company) AS ratio FROM (
SELECT 'filing' AS "table", CAST(year(o_orderdate) AS INTEGER) AS fy, count(DISTINCT o_custkey) AS n_sourced FROM orders GROUP BY ALL
UNION ALL SELECT 'fact', fy, count(DISTINCT corp) FROM fact GROUP BY fy
UNION ALL SELECT 'section', fy, count(DISTINCT corp) FROM known GROUP BY fy
UNION ALL SELECT 'note', fy, count(DISTINCT corp) FROM known GROUP BY fy
UNION ALL SELECT 'engagement', fy, count(DISTINCT corp) FROM engagement GROUP BY fy
UNION ALL SELECT 'kam', fy, count(DISTINCT corp) FROM matter GROUP BY fy)""",
        "company",
        "fact",
        "known",
        "engagement",
        "matter",
    )
)
def release_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a release can answer, table by table and year by year."""
    return release(spark, sf_dir).features().withColumn("n_companies", F.col("n_companies").cast("long"))
