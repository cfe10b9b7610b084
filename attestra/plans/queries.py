"""Queries of the operators over the driver tables, each with its SQL for DuckDB.

Money is summed as decimals and returned as doubles, so that both engines agree bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.evidence import best, grid
from attestra.operators import alignment, asof, audit, disclosure, financial, fuzzy, nearest, notes, peers, perimeter, search, semantic, similar
from attestra.operators.text_index import TextIndex
from attestra.plans import proxies as px
from attestra.plans.proxies import double, read
from attestra.streaming.events import windowed
from attestra.tables import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common parts of the SQL below.
CTE = {
    "company": "company AS (SELECT c_custkey AS corp, c_name AS name, c_mktsegment AS industry, CAST(n_regionkey AS VARCHAR) || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code, c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "filing": "filing AS (SELECT o_orderkey AS receipt, o_custkey AS corp, CAST(year(o_orderdate) AS BIGINT) AS fy, o_orderdate AS filed_at, CAST(o_totalprice AS DECIMAL(15,2)) AS value, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'P' THEN 'summary_only' WHEN 'O' THEN 'unverified' ELSE 'unavailable' END AS state FROM orders)",
    "span": "span AS (SELECT min(fy) AS first_year, max(fy) AS last_year, (SELECT CAST(year(max(o_orderdate) + INTERVAL 1 MONTH) - 1 AS BIGINT) FROM orders) AS whole_year FROM filing)",
    "yearly": "yearly AS (SELECT corp, fy, count(*) AS n_filings, sum(value) AS value FROM filing GROUP BY corp, fy)",
    "line": "line AS (SELECT receipt, corp, fy, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag, gross, gross * (1 - discount) AS net, gross * (1 - discount) * CAST(l_tax AS DECIMAL(5,2)) AS tax, discount FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(15,2)) AS gross, CAST(l_discount AS DECIMAL(5,2)) AS discount FROM lineitem) JOIN filing ON l_orderkey = receipt)",
    "cell": "cell AS (SELECT corp, industry, balance, nation, fy FROM company, (SELECT unnest(range(first_year, last_year + 1)) AS fy FROM span))",
    "engagement": "engagement AS (SELECT corp, fy, CAST(n_regionkey AS BIGINT) AS auditor, sum(CASE WHEN flag = 'N' THEN net ELSE 0 END) AS audit_fee, sum(CASE WHEN flag = 'N' THEN 0 ELSE net END) AS non_audit_fee FROM line JOIN supplier ON supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY corp, fy, n_regionkey)",
    "lead_auditor": "lead_auditor AS (SELECT corp, fy, auditor FROM engagement QUALIFY row_number() OVER (PARTITION BY corp, fy ORDER BY audit_fee + non_audit_fee DESC, auditor) = 1)",
    "history": "history AS (SELECT corp, fy, auditor, prior, CASE WHEN prior IS NULL THEN 'first' WHEN prior = auditor THEN 'retained' ELSE 'changed' END AS status FROM (SELECT *, lag(auditor) OVER (PARTITION BY corp ORDER BY fy) AS prior FROM lead_auditor))",
    "quality": "quality AS (SELECT corp, fy, n_filings, conversion, CASE WHEN fy <= (SELECT whole_year FROM span) THEN net / CASE WHEN prior_fy = fy - 1 THEN prior END - 1 END AS yoy, avg(conversion) OVER (PARTITION BY corp ORDER BY fy ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg3 FROM (SELECT *, net / gross AS conversion, lag(net) OVER w AS prior, lag(fy) OVER w AS prior_fy FROM (SELECT corp, fy, n_filings, CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(net) AS DOUBLE) AS net FROM line JOIN yearly USING (corp, fy) GROUP BY corp, fy, n_filings) WINDOW w AS (PARTITION BY corp ORDER BY fy)))",
    "concern": """factor AS (
  SELECT cell.corp, cell.fy, balance < 0 AS negative_balance,
    CASE WHEN cell.fy <= (SELECT whole_year FROM span) AND value IS NOT NULL AND lag(value) OVER w IS NOT NULL THEN value < lag(value) OVER w END AS decline,
    CASE WHEN cell.fy > (SELECT first_year FROM span) THEN lag(value) OVER w IS NULL END AS gap,
    return_share > 0.5 AS high_returns, mean_discount > 0.06 AS high_discount,
    last_filed < make_date(cell.fy, 7, 1) AS no_recent_filing
  FROM cell LEFT JOIN (SELECT corp, fy, CAST(value AS DOUBLE) AS value FROM yearly) USING (corp, fy)
    LEFT JOIN (SELECT corp, fy, CAST(sum(CASE WHEN flag = 'R' THEN net ELSE 0 END) AS DOUBLE) / CAST(sum(net) AS DOUBLE) AS return_share, CAST(sum(discount) AS DOUBLE) / count(*) AS mean_discount FROM line GROUP BY corp, fy) USING (corp, fy)
    LEFT JOIN (SELECT corp, fy, max(filed_at) AS last_filed FROM filing GROUP BY corp, fy) USING (corp, fy)
  WINDOW w AS (PARTITION BY cell.corp ORDER BY cell.fy)),
counted AS (
  SELECT corp, fy, CAST(coalesce(negative_balance, false) AS BIGINT) + CAST(coalesce(decline, false) AS BIGINT) + CAST(coalesce(gap, false) AS BIGINT) + CAST(coalesce(high_returns, false) AS BIGINT) + CAST(coalesce(high_discount, false) AS BIGINT) + CAST(coalesce(no_recent_filing, false) AS BIGINT) AS points,
    CAST(negative_balance IS NULL AS BIGINT) + CAST(decline IS NULL AS BIGINT) + CAST(gap IS NULL AS BIGINT) + CAST(high_returns IS NULL AS BIGINT) + CAST(high_discount IS NULL AS BIGINT) + CAST(no_recent_filing IS NULL AS BIGINT) AS missing
  FROM factor),
concern AS (SELECT corp, fy, points, 6 - missing AS evaluated, missing, CASE missing WHEN 0 THEN 'summary_only' WHEN 6 THEN 'unavailable' ELSE 'unverified' END AS state FROM counted)""",
    "restated": """restated AS (
  SELECT key, original, re_reported, (re_reported - original) / nullif(abs(original), 0) AS gap, abs((re_reported - original) / nullif(abs(original), 0)) > 0.01 AS candidate, CASE WHEN re_reported IS NULL THEN 'unavailable' ELSE 'summary_only' END AS state
  FROM (SELECT receipt AS key, CAST(value AS DOUBLE) AS original FROM filing)
    LEFT JOIN (SELECT l_orderkey AS key, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS re_reported FROM lineitem GROUP BY l_orderkey) USING (key))""",
    "fees": "fees AS (SELECT corp, fy, industry, CAST(sum(audit_fee) AS DOUBLE) AS audit_fee, CAST(sum(non_audit_fee) AS DOUBLE) AS non_audit_fee FROM engagement JOIN company USING (corp) GROUP BY corp, fy, industry)",
    "sections": "sections AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS section, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)",
}
#: What a part needs before it.
NEEDS = {"yearly": ["filing"], "line": ["filing"], "span": ["filing"], "cell": ["company", "span"], "engagement": ["line"], "lead_auditor": ["engagement"], "history": ["lead_auditor"], "quality": ["yearly", "line", "span"], "concern": ["cell", "yearly", "line"], "restated": ["filing"], "fees": ["engagement", "company"]}


def sql(body: str, *parts: str) -> str:
    """body after the parts and all that they need."""
    order: list[str] = []

    def add(part: str) -> None:
        for x in NEEDS.get(part, []):
            add(x)
        if part not in order:
            order.append(part)

    for p in parts:
        add(p)
    return (f"WITH {', '.join(CTE[p] for p in order)} " if order else "") + body


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# evidence


@query(sql("SELECT corp, fy, CASE min(CASE state WHEN 'available' THEN 0 WHEN 'summary_only' THEN 1 WHEN 'unverified' THEN 2 ELSE 3 END) WHEN 0 THEN 'available' WHEN 1 THEN 'summary_only' WHEN 2 THEN 'unverified' ELSE 'unavailable' END AS state, count(receipt) AS n_sources FROM cell LEFT JOIN filing USING (corp, fy) GROUP BY corp, fy", "cell", "filing"))
def evidence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what is known of each company and year. Filings are aggregated before they meet the grid."""
    cells = grid(px.companies(spark, sf_dir).select("corp"), px.span(spark, sf_dir).years).withColumn("fy", F.col("fy").cast("long"))
    sources = px.filings(spark, sf_dir).groupBy("corp", "fy").agg(best(F.col("state")).alias("state"), F.count("*").alias("n_sources"))
    return cells.join(sources, ["corp", "fy"], "left").select("corp", "fy", F.coalesce("state", F.lit("unavailable")).alias("state"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


@query(sql("SELECT fy, count(*) AS n_cells, count(n_filings) AS n_sourced, count(n_filings) / count(*) AS ratio FROM cell LEFT JOIN yearly USING (corp, fy) GROUP BY fy", "cell", "yearly"))
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evidence_grid(spark, sf_dir).groupBy("fy").agg(F.count("*").alias("n_cells"), F.count(F.when(F.col("n_sources") > 0, 1)).alias("n_sourced"))
    return cells.withColumn("ratio", F.col("n_sourced") / F.col("n_cells"))


# search


#: The query set of searches: every row whose key is divisible by this, against all rows.
EACH = 100


@query(sql("SELECT corp, name, CAST(levenshtein(name, 'Customer#00000012') AS BIGINT) AS distance FROM company WHERE contains(lower(name), 'customer#00000012') ORDER BY distance, corp LIMIT 20", "company"))
def search_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_company(px.companies(spark, sf_dir), "Customer#00000012", 20)


@query("SELECT DISTINCT a.c_name AS name, b.c_name AS other, CAST(levenshtein(a.c_name, b.c_name) AS BIGINT) AS distance FROM customer a JOIN customer b ON a.c_custkey % 100 = 0 AND a.c_name <> b.c_name AND levenshtein(a.c_name, b.c_name) <= 2")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose name is within two edits of that of every hundredth one."""
    companies = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return fuzzy.near_names(companies, companies.where(F.col("c_custkey") % EACH == 0))


@query(
    """WITH hit AS (
SELECT 'company' AS kind, c_custkey AS id, c_name AS label, c_mktsegment AS text FROM customer
UNION ALL SELECT 'part', p_partkey, p_name, p_name FROM part
UNION ALL SELECT 'document', doc_id, source, text FROM documents)
SELECT kind, id, label, CAST((length(text) - length(replace(lower(text), 'ring', ''))) / 4 AS BIGINT) AS score FROM hit
WHERE contains(lower(text), 'ring') ORDER BY score DESC, kind, id LIMIT 100"""
)
def search_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [
        ("company", read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS label", "c_mktsegment AS text")),
        ("part", read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS label", "p_name AS text")),
        ("document", read(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source AS label", "text")),
    ]
    return search.search_dataset(kinds, "ring", 100)


@query("SELECT receipt, o_custkey AS corp, c_name AS name FROM (SELECT DISTINCT l_orderkey AS receipt FROM lineitem) JOIN orders ON receipt = o_orderkey JOIN customer ON o_custkey = c_custkey")
def resolve_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt")).distinct()
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("corp"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corp"), F.col("c_name").alias("name"))
    return receipts.join(orders, "receipt").join(names, "corp").select("receipt", "corp", "name")


# peers


@query(sql("SELECT t.corp AS target, c.corp AS peer, 'prefix:' || t.code AS rule FROM company t JOIN company c ON t.code = c.code AND t.corp <> c.corp WHERE t.corp % 100 = 0", "company"))
def peers_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = px.companies(spark, sf_dir).select("corp", "code")
    return peers.peers_by_code(companies, companies.where(F.col("corp") % EACH == 0), 3)


@query(sql("SELECT CAST(0 AS BIGINT) AS target, corp AS peer, 'explicit' AS rule FROM company WHERE corp IN (3, 5, 8, 13, 21, 34, 1000000007)", "company"))
def peers_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.peers_by_list(px.companies(spark, sf_dir), 0, [0, 3, 5, 8, 13, 21, 34, 1_000_000_007])


SIZED = "sized AS (SELECT corp, industry, coalesce(sum(value), 0) AS size FROM company LEFT JOIN yearly USING (corp) GROUP BY corp, industry)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = px.filings(spark, sf_dir).groupBy("corp").agg(F.sum("value").alias("size"))
    return px.companies(spark, sf_dir).join(values, "corp", "left").select("corp", "industry", F.coalesce("size", F.lit(0)).alias("size"))


NEAREST = "SELECT a.corp AS target, b.corp AS peer, row_number() OVER (PARTITION BY a.corp ORDER BY abs(a.size - b.size), b.corp) AS rank, CAST(abs(a.size - b.size) AS DOUBLE) AS distance, 'adaptive:industry,nearest 5' AS rule FROM sized a JOIN sized b ON a.industry = b.industry AND a.corp <> b.corp QUALIFY rank <= 5"


@query(sql(NEAREST, "company", "yearly").replace(" SELECT a.corp", f", {SIZED} SELECT a.corp"))
def peers_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.peers_by_size(sized(spark, sf_dir), 5)


BAND = "SELECT a.corp AS target, b.corp AS peer, 'adaptive:industry,size 0.8-1.25' AS rule FROM sized a JOIN sized b ON a.industry = b.industry AND a.corp % 100 = 0 AND b.corp <> a.corp AND CAST(b.size AS DOUBLE) BETWEEN CAST(a.size AS DOUBLE) * 0.8 AND CAST(a.size AS DOUBLE) * 1.25"


@query(sql(BAND, "company", "yearly").replace(" SELECT a.corp", f", {SIZED} SELECT a.corp"))
def peers_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = sized(spark, sf_dir)
    return peers.peers_by_band(companies, companies.where(F.col("corp") % EACH == 0))


@query(sql(BAND.replace("size 0.8-1.25' AS rule", "size 0.8-1.25+prefix:' || left(a.code, 1) AS rule") + " AND left(a.code, 1) = left(b.code, 1)", "company", "yearly").replace(" SELECT a.corp", f", {SIZED.replace('corp, industry,', 'corp, industry, code,').replace('GROUP BY corp, industry', 'GROUP BY corp, industry, code')} SELECT a.corp"))
def peers_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry, size and the code's first digit are keys of one join."""
    companies = sized(spark, sf_dir).join(px.companies(spark, sf_dir).select("corp", "code"), "corp")
    return peers.peers_by_band(companies, companies.where(F.col("corp") % EACH == 0), digits=1)


@query(sql("SELECT corp, code AS cohort, min(corp) OVER w AS first, count(*) OVER w - 1 AS n_peers, 'prefix:' || code AS rule FROM company WINDOW w AS (PARTITION BY code)", "company"))
def prefix_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's cohort by code: membership, and not the pairs."""
    return peers.cohorts_by_code(px.companies(spark, sf_dir).select("corp", "code"), 3)


MEASURES = {"size": 100_000.0, "n_filings": 4.0, "balance": 2_500.0}


@query(
    sql(
        """SELECT target, peer, rank, distance, 'adaptive:nearest 5 by size, n_filings, balance within industry' AS rule FROM (
SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, peer) AS rank FROM (
SELECT a.corp AS target, b.corp AS peer, (b.size - a.size) * (b.size - a.size) + (b.n - a.n) * (b.n - a.n) + (b.balance - a.balance) * (b.balance - a.balance) AS distance
FROM measured a JOIN measured b ON a.industry = b.industry AND a.corp <> b.corp AND a.corp % 100 = 0)) WHERE rank <= 5""",
        "company",
        "yearly",
    ).replace(" SELECT target", ", measured AS (SELECT corp, industry, CAST(coalesce(sum(value), 0) AS DOUBLE) / CAST(100000 AS DOUBLE) AS size, CAST(coalesce(sum(n_filings), 0) AS DOUBLE) / CAST(4 AS DOUBLE) AS n, balance / CAST(2500 AS DOUBLE) AS balance FROM company LEFT JOIN yearly USING (corp) GROUP BY corp, industry, balance) SELECT target", 1)
)
def peers_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five companies of its industry that are nearest to every hundredth one in size, filings and balance together."""
    sums = px.yearly(spark, sf_dir).groupBy("corp").agg(double(F.sum("value")).alias("size"), F.sum("n_filings").alias("n_filings"))
    companies = px.companies(spark, sf_dir).select("corp", "industry", "balance").join(sums, "corp", "left").fillna(0, ["size", "n_filings"])
    return nearest.nearest_peers(companies, companies.where(F.col("corp") % EACH == 0), MEASURES, 5, ["industry"])


# financial


@query(sql("SELECT corp, fy, CAST(n_filings AS DOUBLE) AS filings, CAST(value AS DOUBLE) AS value, CAST(net AS DOUBLE) AS net, CAST(tax AS DOUBLE) AS tax FROM yearly LEFT JOIN (SELECT corp, fy, sum(net) AS net, sum(tax) AS tax FROM line GROUP BY corp, fy) USING (corp, fy)", "yearly", "line"))
def financial_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_lines = px.lines(spark, sf_dir).groupBy("corp", "fy").agg(F.sum("net").alias("net_sales"), F.sum("tax").alias("taxes"))
    wide = px.yearly(spark, sf_dir).join(from_lines, ["corp", "fy"], "left").select("corp", "fy", *(double(F.col(c)).alias(c) for c in ("n_filings", "value", "net_sales", "taxes")))
    facts = financial.normalized_facts(wide, {"n_filings": "filings", "value": "value", "net_sales": "net", "taxes": "tax"})
    return financial.financial_snapshot(facts, ["filings", "value", "net", "tax"])


def by_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.yearly(spark, sf_dir).join(px.companies(spark, sf_dir).select("corp", "industry"), "corp").withColumn("value", double(F.col("value")))


@query(sql("SELECT corp, fy, v AS value, percent_rank() OVER (PARTITION BY industry, fy ORDER BY v) AS pct, median, v - median AS gap FROM (SELECT corp, fy, industry, CAST(value AS DOUBLE) AS v, quantile_cont(CAST(value AS DOUBLE), 0.5) OVER (PARTITION BY industry, fy) AS median FROM yearly JOIN company USING (corp))", "yearly", "company"))
def compare_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return financial.compare_to_industry(by_industry(spark, sf_dir))


@query(sql("SELECT corp, fy, metric, value, percent_rank() OVER (PARTITION BY industry, fy, metric ORDER BY value) AS pct FROM (SELECT corp, fy, industry, 'value' AS metric, CAST(value AS DOUBLE) AS value FROM yearly JOIN company USING (corp) UNION ALL SELECT corp, fy, industry, 'n_filings', CAST(n_filings AS DOUBLE) FROM yearly JOIN company USING (corp) UNION ALL SELECT corp, fy, industry, 'mean', CAST(value AS DOUBLE) / n_filings FROM yearly JOIN company USING (corp))", "yearly", "company"))
def compare_industry_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return financial.compare_to_industry_multi(by_industry(spark, sf_dir).withColumn("mean", F.col("value") / F.col("n_filings")), ["value", "n_filings", "mean"])


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = px.lines(spark, sf_dir).groupBy("corp", "fy").agg(double(F.sum("gross")).alias("gross"), double(F.sum("net")).alias("net"))
    return financial.quality_of_earnings(values, px.span(spark, sf_dir).whole)


@query(sql("SELECT corp, fy, conversion, yoy, avg3 FROM quality", "quality"))
def quality_of_earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir)


@query(
    sql(
        """SELECT corp, fy, debt, equity, debt / nullif(equity, 0) AS leverage, CASE WHEN debt IS NOT NULL AND equity IS NOT NULL THEN debt > 0 AND equity <= 0 OR coalesce(debt / nullif(equity, 0) > 2, false) END AS high,
CASE WHEN debt IS NOT NULL AND equity IS NOT NULL THEN 'summary_only' ELSE 'unavailable' END AS state
FROM (SELECT corp, fy, CAST(sum(value) FILTER (WHERE state = 'unverified') AS DOUBLE) AS debt, CAST(sum(value) FILTER (WHERE state = 'available') AS DOUBLE) AS equity FROM filing GROUP BY corp, fy)""",
        "filing",
    )
)
def leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders to fulfilled ones, as debt to equity."""
    of = lambda state: double(F.sum(F.when(F.col("state") == state, F.col("value"))))
    return financial.leverage(px.filings(spark, sf_dir).groupBy("corp", "fy").agg(of("unverified").alias("debt"), of("available").alias("equity")))


@query(
    sql(
        """SELECT corp, input, value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'summary_only' END AS state FROM (
SELECT corp, unnest(['mean_value', 'growth', 'tax_share']) AS input, unnest([
  CAST(sum(value) AS DOUBLE) / count(*),
  CAST(sum(value) FILTER (WHERE fy = whole_year) AS DOUBLE) / CAST(sum(value) FILTER (WHERE fy = whole_year - 2) AS DOUBLE) - 1,
  CAST(sum(tax) AS DOUBLE) / CAST(sum(net) AS DOUBLE)]) AS value
FROM yearly LEFT JOIN (SELECT corp, fy, sum(net) AS net, sum(tax) AS tax FROM line GROUP BY corp, fy) USING (corp, fy), span WHERE fy BETWEEN whole_year - 2 AND whole_year GROUP BY corp)""",
        "yearly",
        "line",
        "span",
    )
)
def dcf_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_lines = px.lines(spark, sf_dir).groupBy("corp", "fy").agg(F.sum("net").alias("net"), F.sum("tax").alias("tax"))
    return financial.dcf_inputs(px.yearly(spark, sf_dir).join(from_lines, ["corp", "fy"], "left"), px.span(spark, sf_dir).whole)


@query(
    sql(
        """SELECT corp, fy, signal, flag, CASE WHEN flag THEN CASE signal WHEN 'low_conversion' THEN 'read the revenue recognition note' WHEN 'declining' THEN 'compare with the industry' WHEN 'below_own_average' THEN 'look at the latest events' ELSE 'look for missing filings' END END AS next_check
FROM (SELECT corp, fy, unnest(['low_conversion', 'declining', 'below_own_average', 'single_filing']) AS signal, unnest([conversion < 0.94, yoy < 0, conversion < avg3, n_filings = 1]) AS flag FROM quality)""",
        "quality",
    )
)
def investor_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return financial.investor_signals(quality(spark, sf_dir).join(px.yearly(spark, sf_dir).select("corp", "fy", "n_filings"), ["corp", "fy"]))


# disclosures


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("corp"), "ts", F.col("event_type").alias("type"), "value", "props")


@query("SELECT event_id, user_id AS corp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('purchase', 'signup') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100")
def disclosure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = disclosure.search_disclosure_events(events(spark, sf_dir), ["purchase", "signup"], "2024-01-10", "2024-01-20", 100)
    return hits.select("event_id", "corp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(sql("SELECT r.receipt, corp, coalesce(state, 'unverified') AS state FROM (SELECT l_orderkey AS receipt FROM lineitem UNION SELECT unnest([-1, 1000000007])) r LEFT JOIN filing ON r.receipt = filing.receipt", "filing"))
def disclosure_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt")).distinct()
    unknown = spark.range(1).select(F.explode(F.array(F.lit(-1), F.lit(1_000_000_007)).cast("array<bigint>")).alias("receipt"))
    return disclosure.disclosure_lookup(requests.union(unknown), px.filings(spark, sf_dir))


@query("SELECT p.event_id, p.user_id AS corp, (SELECT max_by(v.event_id, v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS latest_event_id FROM events p WHERE p.event_type = 'purchase'")
def event_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest view of the same user."""
    e = events(spark, sf_dir)
    bought = e.where("type = 'purchase'").select("corp", "ts", F.col("event_id").alias("bought"))
    found = asof.as_of(bought, e.where("type = 'view'").select("corp", "ts", "event_id"), "corp", "ts", "ts", "event_id")
    return found.select(F.col("bought").alias("event_id"), "corp", "latest_event_id")


@query("SELECT event_type AS type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS value FROM events GROUP BY event_type, time_bucket(INTERVAL 6 HOUR, ts)")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of six hours: the batch form of streaming.events.windowed."""
    return windowed(events(spark, sf_dir), "6 hours").select("type", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", double(F.col("value")).alias("value"))


# audit


def concern(spark: SparkSession, sf_dir: str, active: DataFrame | None = None) -> DataFrame:
    span = px.span(spark, sf_dir)
    cells = grid(px.companies(spark, sf_dir).select("corp", "balance"), span.years).withColumn("fy", F.col("fy").cast("long"))
    filed = px.filings(spark, sf_dir).groupBy("corp", "fy").agg(double(F.sum("value")).alias("value"), F.max("filed_at").alias("last_filed"))
    lines = px.lines(spark, sf_dir).withColumn("n", F.lit(1)) if active is None else active
    line = lines.groupBy("corp", "fy").agg(
        (double(F.sum(F.when(F.col("flag") == "R", F.col("net")).otherwise(0))) / double(F.sum("net"))).alias("return_share"),
        (double(F.sum("discount")) / F.sum("n")).alias("mean_discount"),
    )
    rows = cells.join(filed, ["corp", "fy"], "left").join(line, ["corp", "fy"], "left").withColumn("prior", financial.before("value"))
    factors = rows.select(
        "corp",
        "fy",
        (F.col("balance") < 0).alias("negative_balance"),
        F.when(F.col("fy") <= span.whole, F.col("value") < F.col("prior")).alias("decline"),
        F.when(F.col("fy") > span.first, F.col("prior").isNull()).alias("gap"),
        (F.col("return_share") > 0.5).alias("high_returns"),
        (F.col("mean_discount") > 0.06).alias("high_discount"),
        (F.col("last_filed") < F.make_date(F.col("fy").cast("int"), F.lit(7), F.lit(1))).alias("no_recent_filing"),
    )
    return audit.score_going_concern(factors)


@query(sql("SELECT corp, fy, points, evaluated, missing, state FROM concern", "concern"))
def going_concern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concern(spark, sf_dir)


def restated(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    originals = px.filings(spark, sf_dir).select(F.col("receipt").alias("key"), double(F.col("value")).alias("value"), *keep)
    later = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(double(F.sum(px.money("l_extendedprice"))).alias("value"))
    return audit.detect_restatement(originals, later, keep=keep)


@query(sql("SELECT * FROM restated", "restated"))
def restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restated(spark, sf_dir)


@query(
    sql(
        """SELECT industry, n, slope, (sy - slope * sx) / n AS intercept FROM (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM (
SELECT industry, count(*) AS n, CAST(sum(n_filings) AS DOUBLE) AS sx, CAST(sum(n_filings * n_filings) AS DOUBLE) AS sxx, CAST(sum(value) AS DOUBLE) AS sy, CAST(sum(n_filings * value) AS DOUBLE) AS sxy FROM yearly JOIN company USING (corp) GROUP BY industry))""",
        "yearly",
        "company",
    )
)
def audit_hours_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = px.yearly(spark, sf_dir).join(px.companies(spark, sf_dir).select("corp", "industry"), "corp")
    return audit.audit_hours_proxy(values.select("industry", F.col("n_filings").alias("x"), F.col("value").alias("y")))


@query(
    sql(
        "SELECT corp, fy, auditor, prior, status, row_number() OVER (PARTITION BY corp, island ORDER BY fy) AS tenure FROM (SELECT *, sum(CASE status WHEN 'changed' THEN 1 ELSE 0 END) OVER (PARTITION BY corp ORDER BY fy ROWS UNBOUNDED PRECEDING) AS island FROM history)",
        "history",
    )
)
def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_history(audit.lead_auditors(engaged(spark, sf_dir)))


def engaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.engagements(px.activity(spark, sf_dir))


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = engaged(spark, sf_dir).groupBy("corp", "fy").agg(double(F.sum("audit_fee")).alias("audit_fee"), double(F.sum("non_audit_fee")).alias("non_audit_fee"))
    return sums.join(px.companies(spark, sf_dir).select("corp", "industry"), "corp")


@query(sql("SELECT corp, fy, audit_fee, non_audit_fee, non_audit_fee / nullif(audit_fee, 0) AS ratio, percent_rank() OVER (PARTITION BY industry, fy ORDER BY audit_fee) AS pct FROM fees", "fees"))
def peer_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.compare_peer_audit_fees(fees(spark, sf_dir))


@query(
    sql(
        """SELECT corp, fy, points, candidates, auditor, status, non_audit_fee / nullif(audit_fee, 0) AS ratio,
CASE WHEN candidates IS NULL OR auditor IS NULL THEN 'unavailable' ELSE state END AS state
FROM concern LEFT JOIN (SELECT corp, fy, count(*) FILTER (WHERE candidate) AS candidates FROM filing JOIN restated ON receipt = key GROUP BY corp, fy) USING (corp, fy)
LEFT JOIN history USING (corp, fy) LEFT JOIN fees USING (corp, fy)""",
        "concern",
        "restated",
        "history",
        "fees",
    )
)
def acceptance_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are read once for concern, history and fees, and once more, by receipt, for restatements."""
    active = materialize(px.activity(spark, sf_dir), "activity")
    engaged = px.engagements(active)
    candidates = restated(spark, sf_dir, "corp", "fy").groupBy("corp", "fy").agg(F.count(F.when(F.col("candidate"), 1)).alias("candidates"))
    ratios = engaged.groupBy("corp", "fy").agg(F.try_divide(double(F.sum("non_audit_fee")), double(F.sum("audit_fee"))).alias("ratio"))
    return audit.acceptance_pack(concern(spark, sf_dir, active), candidates, audit.audit_history(audit.lead_auditors(engaged)), ratios)


def subsidiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    perimeter = grid(px.companies(spark, sf_dir).select(F.col("nation").alias("parent"), "corp"), px.span(spark, sf_dir).years).withColumn("fy", F.col("fy").cast("long"))
    return audit.subsidiary_auditors(perimeter, audit.lead_auditors(engaged(spark, sf_dir)))


@query(sql("SELECT nation AS parent, corp, fy, auditor, CASE WHEN auditor IS NULL THEN 'unavailable' ELSE 'available' END AS state FROM cell LEFT JOIN lead_auditor USING (corp, fy)", "cell", "lead_auditor"))
def subsidiary_auditors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsidiaries(spark, sf_dir)


@query(sql("SELECT nation AS parent, corp, fy FROM cell WHERE NOT EXISTS (SELECT 1 FROM lead_auditor l WHERE l.corp = cell.corp AND l.fy = cell.fy)", "cell", "lead_auditor"))
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    perimeter = grid(px.companies(spark, sf_dir).select(F.col("nation").alias("parent"), "corp"), px.span(spark, sf_dir).years).withColumn("fy", F.col("fy").cast("long"))
    return audit.missing_evidence(perimeter, engaged(spark, sf_dir).select("corp", "fy"))


@query(sql("SELECT nation AS parent, fy, " + ", ".join(f"count(*) FILTER (WHERE auditor = {a}) AS auditor_{a}" for a in range(5)) + ", count(*) FILTER (WHERE auditor IS NULL) AS missing FROM cell LEFT JOIN lead_auditor USING (corp, fy) GROUP BY nation, fy", "cell", "lead_auditor"))
def auditor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.auditor_matrix(subsidiaries(spark, sf_dir), list(range(5)))


@query("SELECT CAST(r_regionkey AS BIGINT) AS parent, r_name AS name, count(DISTINCT n_nationkey) AS n_groups, count(c_custkey) AS n_subsidiaries FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_regionkey, r_name")
def group_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of edges: region, nation, customer. Subsidiaries are counted by nation before the join."""
    children = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    groups = read(spark, sf_dir, "nation").join(children, "n_nationkey", "left")
    edges = read(spark, sf_dir, "region").join(groups, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return edges.groupBy(F.col("r_regionkey").cast("long").alias("parent"), F.col("r_name").alias("name")).agg(F.countDistinct("n_nationkey").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_subsidiaries"))


@query(
    """WITH RECURSIVE edge AS (SELECT parent, child, max(share) AS share FROM (
  SELECT c_custkey // 8 AS parent, c_custkey AS child, (50 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 50) / CAST(100 AS DOUBLE) AS share FROM customer WHERE c_custkey > 0
  UNION ALL SELECT c_custkey, c_custkey // 8, CAST(0.125 AS DOUBLE) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey > 0
  UNION ALL SELECT c_custkey, c_custkey + 1, CAST(0.375 AS DOUBLE) FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 8 < 7 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)) WHERE parent <> child GROUP BY parent, child),
way AS (
  SELECT parent AS root, child AS corp, CAST(1 AS BIGINT) AS level, share, [parent, child] AS path FROM edge
  UNION ALL SELECT root, child, level + 1, way.share * edge.share, list_append(path, child) FROM way JOIN edge ON corp = parent WHERE NOT list_contains(path, child))
SELECT root, corp, min(level) AS level, max(share) AS share FROM way GROUP BY root, corp"""
)
def perimeter_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each company holds, however far down, in a tree of companies with holdings across and back (cycles)."""
    return perimeter.perimeter(px.holdings(spark, sf_dir))


@query(
    sql(
        """SELECT receipt, strftime("at", '%Y-%m-%d') AS "at", version, CAST(known AS DOUBLE) AS value, strftime(known_from, '%Y-%m-%d') AS known_from, source, CASE WHEN version IS NULL THEN 'unavailable' ELSE 'summary_only' END AS state
FROM (SELECT DISTINCT l_orderkey AS receipt, corp, fy, l_shipdate AS "at" FROM lineitem JOIN filing ON l_orderkey = filing.receipt) r
ASOF LEFT JOIN (
  SELECT corp, fy, known_from, known, source, row_number() OVER (PARTITION BY corp, fy ORDER BY known_from) AS version FROM (
    SELECT corp, fy, filed_at AS known_from, sum(sum(value)) OVER (PARTITION BY corp, fy ORDER BY filed_at) AS known, max(receipt) AS source FROM filing GROUP BY corp, fy, filed_at)) v
ON r.corp = v.corp AND r.fy = v.fy AND r."at" >= v.known_from""",
        "filing",
    )
)
def value_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detect_restatement, the other way round: what the filings of a year came to as they were known on the days that its lines were shipped."""
    filed = px.filings(spark, sf_dir).groupBy("corp", "fy", "filed_at").agg(F.sum("value").alias("value"), F.max("receipt").alias("receipt"))
    running = F.sum("value").over(Window.partitionBy("corp", "fy").orderBy("filed_at"))
    found = asof.versions(filed.withColumn("value", running), ["corp", "fy"], "value", "filed_at", "receipt")
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt"), F.col("l_shipdate").alias("at")).distinct()
    asked = line.join(px.filings(spark, sf_dir).select("receipt", "corp", "fy"), "receipt")
    known = asof.known_at(asked, found, ["corp", "fy"], "at")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return known.select("receipt", day("at"), "version", double(F.col("value")).alias("value"), day("known_from"), "source", F.when(F.col("version").isNull(), "unavailable").otherwise("summary_only").alias("state"))


@query(
    sql(
        """SELECT industry, auditor, CAST(fee AS DOUBLE) AS fee,
CASE WHEN level = 0 THEN CAST(fee AS DOUBLE) / CAST(sum(CASE WHEN level = 1 THEN fee END) OVER (PARTITION BY industry) AS DOUBLE) END AS share,
CASE WHEN level = 0 THEN dense_rank() OVER (PARTITION BY industry, level ORDER BY fee DESC) END AS rank, level
FROM (SELECT industry, auditor, sum(audit_fee + non_audit_fee) AS fee, CAST(grouping_id(industry, auditor) AS BIGINT) AS level FROM engagement JOIN company USING (corp) GROUP BY ROLLUP (industry, auditor))""",
        "engagement",
        "company",
    )
)
def audit_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = engaged(spark, sf_dir).join(px.companies(spark, sf_dir).select("corp", "industry"), "corp")
    return audit.industry_audit_landscape(joined.select("industry", "auditor", (F.col("audit_fee") + F.col("non_audit_fee")).alias("fee")))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("topic"))
    return px.lines(spark, sf_dir).select("corp", "fy", "part").join(part, "part").select("corp", "topic", "fy").distinct()


@query(
    sql(
        """SELECT corp, topic, fy, CASE WHEN prior IS NULL THEN 'new' WHEN prior = fy - 1 THEN 'continued' ELSE 'returned' END AS entry,
CASE WHEN fy = (SELECT last_year FROM span) THEN 'open' WHEN following = fy + 1 THEN 'kept' ELSE 'dropped' END AS exit
FROM (SELECT *, lag(fy) OVER w AS prior, lead(fy) OVER w AS following FROM (SELECT DISTINCT corp, p_type AS topic, fy FROM line JOIN part ON part = p_partkey) WINDOW w AS (PARTITION BY corp, topic ORDER BY fy))""",
        "line",
        "span",
    )
)
def kam_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.kam_lifecycle(topics(spark, sf_dir), px.span(spark, sf_dir).last)


@query(
    sql(
        """SELECT corp, fy, topic, prior, similarity, CASE WHEN prior IS NULL THEN 'new' WHEN prior = topic THEN 'continued' ELSE 'reworded' END AS entry,
CASE WHEN fy = (SELECT last_year FROM span) THEN 'open' WHEN goes_on THEN 'kept' ELSE 'dropped' END AS exit
FROM matter LEFT JOIN link USING (corp, fy, topic) LEFT JOIN (SELECT corp, fy - 1 AS fy, prior AS topic, true AS goes_on FROM link) USING (corp, fy, topic)""",
        "line",
        "span",
    ).replace(
        " SELECT corp, fy, topic, prior",
        r""", matter AS MATERIALIZED (SELECT DISTINCT corp, fy, p_name AS topic FROM line JOIN part ON part = p_partkey),
said AS MATERIALIZED (SELECT corp, fy, topic, list_distinct(regexp_extract_all(lower(topic), '[\p{L}\p{N}]+')) AS words FROM matter),
pair AS (SELECT a.corp, a.fy, a.topic, b.topic AS prior, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS similarity FROM said a JOIN said b ON a.corp = b.corp AND a.fy = b.fy + 1),
link AS MATERIALIZED (SELECT corp, fy, p.topic, p.prior, p.similarity FROM (
  SELECT corp, fy, unnest(list_reduce(list([{'prior': prior, 'topic': topic, 'similarity': similarity}] ORDER BY similarity DESC, topic <> prior, prior, topic), lambda taken, x: CASE WHEN len(list_filter(taken, lambda t: t.prior = x[1].prior OR t.topic = x[1].topic)) > 0 THEN taken ELSE list_concat(taken, x) END)) AS p
  FROM pair WHERE similarity >= 0.3 GROUP BY corp, fy)) SELECT corp, fy, topic, prior""",
        1,
    )
)
def kam_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get_kam_lifecycle for matters that are reworded: parts by name, of which half may change."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("topic"))
    named = px.lines(spark, sf_dir).select("corp", "fy", "part").join(part, "part").select("corp", "topic", "fy")
    return audit.kam_threads(named, px.span(spark, sf_dir).last, 0.3)


@query(
    sql(
        "SELECT fy, industry, auditor, CAST(grouping_id(fy, industry, auditor) AS BIGINT) AS level, CAST(sum(audit_fee + non_audit_fee) AS DOUBLE) AS fee, count(*) AS n, count(DISTINCT corp) >= 40 AS reported FROM engagement JOIN company USING (corp) GROUP BY CUBE (fy, industry, auditor)",
        "engagement",
        "company",
    )
)
def audit_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get_industry_audit_landscape for all sets of year, industry and auditor."""
    rows = engaged(spark, sf_dir).join(px.companies(spark, sf_dir).select("corp", "industry"), "corp")
    return audit.market_cube(materialize(rows.select("fy", "industry", "auditor", "corp", (F.col("audit_fee") + F.col("non_audit_fee")).alias("fee")), "market"), 40)


# reports and notes


@query(sql("SELECT doc_id, pos, CAST(coalesce(sum(length(section) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(section) AS length, CASE WHEN regexp_matches(section, 'Licen[sc]e') THEN 'license' WHEN regexp_matches(section, '[0-9]{3}') THEN 'figures' WHEN contains(section, '!!') THEN 'emphasis' END AS topic FROM sections", "sections"))
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = notes.topic_of(F.col("section"), {"license": "Licen[sc]e", "figures": "[0-9]{3}", "emphasis": "!!"})
    found = px.sections(spark, sf_dir).select("doc_id", "pos", F.length("section").cast("long").alias("length"), topic.alias("topic"))
    return px.starts(found).select("doc_id", "pos", "start", "length", "topic")


SCORED = "SELECT doc_id, pos, score FROM (SELECT doc_id, pos, CAST((length(section) - length(replace(lower(section), '{0}', ''))) / {1} AS BIGINT) AS score FROM sections) WHERE score > 0 ORDER BY score DESC, doc_id, pos LIMIT 50"


@query(sql(SCORED.format("tion", 4), "sections"))
def search_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.search_sections(px.sections(spark, sf_dir), "tion")


@query(sql(SCORED.format("the", 3), "sections"))
def search_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.search_sections(px.sections(spark, sf_dir), "the")


#: The section index in SQL: postings, document frequencies and lengths.
INDEXED = r"""words AS MATERIALIZED (SELECT doc_id, pos, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS at, len(t) AS length FROM (SELECT doc_id, pos, regexp_extract_all(lower(section), '[\p{L}\p{N}]+') AS t FROM sections)),
posting AS (SELECT doc_id, pos, length, term, count(*) AS tf FROM words GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
stats AS (SELECT count(DISTINCT (doc_id, pos)) AS units, count(*) AS total FROM words)"""


def indexed(body: str) -> str:
    return sql(body, "sections").replace(" " + body, f", {INDEXED} {body}")


def section_index(spark: SparkSession, sf_dir: str, query: str) -> TextIndex:
    """Built for one query: all sections are counted, and the postings are those of its terms."""
    return TextIndex.build(px.sections(spark, sf_dir), ["doc_id", "pos"], "section", only=query)


@query(
    indexed(
        """SELECT doc_id, pos, CAST(sum(CAST(ln(1 + (units - df + 0.5) / (df + 0.5)) * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * length / (total / units))) AS DECIMAL(18,9))) AS DOUBLE) AS score, count(*) AS n_terms
FROM posting JOIN frequency USING (term), stats WHERE term IN ('which', 'was', 'les', 'und', 'tion', 'la') GROUP BY doc_id, pos ORDER BY score DESC, doc_id, pos LIMIT 200"""
    )
)
def ranked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_audit_report_matters by rank: the 200 best sections for some words, by BM25, from the index."""
    query = "which was les und tion la"
    return section_index(spark, sf_dir, query).search(query, 200)


@query(
    indexed(
        """SELECT doc_id, pos, CAST(sum(CAST(ln(1 + (units - df + 0.5) / (df + 0.5)) * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * length / (total / units))) AS DECIMAL(18,9))) AS DOUBLE) AS score, count(*) AS n_terms
FROM posting JOIN frequency USING (term) JOIN (SELECT DISTINCT doc_id, pos FROM sections WHERE NOT regexp_matches(section, 'Licen[sc]e') AND regexp_matches(section, '[0-9]{3}')) USING (doc_id, pos), stats
WHERE term IN ('the', 'tion', '000', 'de') GROUP BY doc_id, pos ORDER BY score DESC, doc_id, pos LIMIT 50"""
    )
)
def ranked_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_audit_procedures: the best sections of one topic (those with figures). The topic is a key of the index, so the search reads no text."""
    topic = notes.topic_of(F.col("section"), {"license": "Licen[sc]e", "figures": "[0-9]{3}"})
    query = "the tion 000 de"
    found = TextIndex.build(px.sections(spark, sf_dir).withColumn("topic", topic), ["doc_id", "pos", "topic"], "section", only=query).search(query, 50, F.col("topic") == "figures")
    return found.select("doc_id", "pos", "score", "n_terms")


@query(
    indexed(
        """SELECT a.doc_id, a.pos, count(*) AS n, min(a.at) AS first, max(a.at) AS last
FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.pos = b.pos AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id, a.pos"""
    )
)
def phrase_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections with a phrase, and its places."""
    found = section_index(spark, sf_dir, "of the").phrase("of the")
    return found.select("doc_id", "pos", "n", F.array_min("places").cast("long").alias("first"), F.array_max("places").cast("long").alias("last"))


@query(
    """SELECT doc_id, topic, "at", CASE WHEN "at" IS NOT NULL THEN substr(text, "at", 40) END AS excerpt, CASE WHEN "at" IS NOT NULL THEN 'available' WHEN known THEN 'unverified' ELSE 'unavailable' END AS state
FROM (SELECT doc_id, text, topic, nullif(instr(text, topic), 0) AS "at", doc_id IN (SELECT doc_id FROM labels) AS known FROM documents, unnest(['License', 'shanwh', 'sch ', 'pour']) AS t(topic))"""
)
def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.accounting_policy(read(spark, sf_dir, "documents").select("doc_id", "text"), ["License", "shanwh", "sch ", "pour"], read(spark, sf_dir, "labels"))


PEERS = "peers AS (SELECT d.doc_id, target, count(*) AS n_lines, count(o.section) AS shared FROM (SELECT DISTINCT lang, source, doc_id, section FROM sections) d JOIN (SELECT lang, source, min(doc_id) AS target FROM documents GROUP BY lang, source) t USING (lang, source) LEFT JOIN (SELECT DISTINCT doc_id, section FROM sections) o ON o.doc_id = target AND o.section = d.section WHERE d.doc_id <> target GROUP BY d.doc_id, target)"


@query(sql("SELECT doc_id, target, n_lines, shared FROM peers", "sections").replace(" SELECT doc_id, target", f", {PEERS} SELECT doc_id, target"))
def peer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.compare_peer_policies(px.sections(spark, sf_dir))


@query(sql("SELECT p.doc_id, target, shared, a.quality AS fact, b.quality AS target_fact, CASE WHEN a.quality IS NULL OR b.quality IS NULL THEN 'unverified' ELSE 'summary_only' END AS state FROM peers p LEFT JOIN labels a ON p.doc_id = a.doc_id LEFT JOIN labels b ON target = b.doc_id", "sections").replace(" SELECT p.doc_id, target", f", {PEERS} SELECT p.doc_id, target"))
def peer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.compare_peer_notes(notes.compare_peer_policies(px.sections(spark, sf_dir)), read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("fact")))


@query(
    """SELECT doc_id, prev, CAST(len(list_distinct(list_filter(lines, lambda x: NOT list_contains(before, x)))) AS BIGINT) AS added, CAST(len(list_distinct(list_filter(before, lambda x: NOT list_contains(lines, x)))) AS BIGINT) AS removed
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, lag(doc_id) OVER w AS prev, lag(string_split(text, chr(10))) OVER w AS before FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)) WHERE prev IS NOT NULL"""
)
def policy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.policy_changes(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'html lang=\"([a-z]+)\"', 1) AS lang, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n_paragraphs FROM pages")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where markup isn't well-formed, parts are located by pattern."""
    paragraphs = (F.length("html") - F.length(F.replace(F.col("html"), F.lit("<p>"), F.lit("")))) / 3
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'html lang="([a-z]+)"', 1).alias("lang"), paragraphs.cast("long").alias("n_paragraphs"))


@query("SELECT page_id, format, CAST(coalesce(n_kinds, 0) AS BIGINT) AS n_kinds FROM pages LEFT JOIN (SELECT page_id, string_agg(tag || '=' || n, ' ' ORDER BY tag) AS format, count(*) AS n_kinds FROM (SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, tag) GROUP BY page_id) USING (page_id)")
def page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format metadata of each page, from a map of its tags."""
    pages = read(spark, sf_dir, "pages").select("page_id", notes.format_of(F.col("html")).alias("format"))
    told = F.array_join(F.transform(F.array_sort(F.map_keys("format")), lambda k: F.concat(k, F.lit("="), F.col("format")[k].cast("string"))), " ")
    return pages.select("page_id", F.when(F.size("format") > 0, told).alias("format"), F.size("format").cast("long").alias("n_kinds"))


@query()
def aligned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get_accounting_policy_changes with spans: each document's sentences aligned with those of the one before in its group. A longest common subsequence isn't SQL; a test holds it against brute force."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return alignment.aligned_changes(notes.with_prior(docs), ["doc_id", "prev"])


# context


@query(
    sql(
        """SELECT corp, fy, CAST(value AS DOUBLE) AS value, n_filings, n_topics, n_events, CASE WHEN n_filings IS NOT NULL AND n_topics IS NOT NULL AND n_events IS NOT NULL THEN 'available' ELSE 'summary_only' END AS state
FROM yearly FULL JOIN (SELECT corp, fy, count(DISTINCT p_type) AS n_topics FROM line JOIN part ON part = p_partkey GROUP BY corp, fy) USING (corp, fy)
FULL JOIN (SELECT user_id AS corp, CAST(year(ts) AS BIGINT) AS fy, count(*) AS n_events FROM events GROUP BY user_id, year(ts)) USING (corp, fy)""",
        "yearly",
        "line",
    )
)
def company_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = px.yearly(spark, sf_dir).withColumn("value", double(F.col("value")))
    matters = topics(spark, sf_dir).groupBy("corp", "fy").agg(F.count("*").alias("n_topics"))
    happened = events(spark, sf_dir).groupBy("corp", F.year("ts").cast("long").alias("fy")).agg(F.count("*").alias("n_events"))
    return semantic.company_context(facts, matters, happened)


@query()
def similar_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """semantic_peer_context_review by what reports say: the five most similar of every hundredth one. Cells are approximate, so there is no SQL; a test measures recall against all pairs."""
    docs = read(spark, sf_dir, "documents")
    return similar.similar(similar.text_vectors(docs, ["doc_id"], "text"), docs.where(F.col("doc_id") % EACH == 0))


@query(
    """SELECT a.vec_id AS target, b.vec_id AS peer, row_number() OVER (PARTITION BY a.vec_id ORDER BY s.score DESC, b.vec_id) AS rank, s.score
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_reduce(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)), lambda x, y: x + y) AS score) s
WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5"""
)
def peer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return semantic.peer_context(vectors, vectors.where(F.col("id") % EACH == 0), 5)


from attestra.plans import tools  # noqa: E402, F401  registers its queries
