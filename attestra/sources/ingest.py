"""From what is collected to release tables: sections and notes of archives, facts and disclosures of JSON lines.

An archive is named by its receipt (``<receipt>.zip``). Titles, topics and field names are parameters; the
defaults are this library's own. What can't be read stays as a row: ``unverified``, with what is known of its place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE, UNVERIFIED
from attestra.operators.notes import topic_of

#: (kind, topic) by a pattern of the title, first fit first; and topics of notes by a pattern of title or text.
SECTION_TITLES = {("procedure", "kam"): "(?i)audit procedure|감사절차", ("audit", "kam"): "(?i)key audit matter|핵심감사", ("audit", "opinion"): "(?i)opinion|감사의견", ("business", "overview"): "(?i)business overview|사업의 개요", ("business", "risks"): "(?i)risk|위험", ("business", "governance"): "(?i)governance|지배구조"}
NOTE_TOPICS = {"leases": "(?i)lease|리스", "commitments": "(?i)commitment|약정", "contingencies": "(?i)contingen|우발", "policies": "(?i)accounting polic|회계정책"}
#: Names that a field has in the lists of one year or another.
FACT_FIELDS = {"corp": ("corp", "corp_code"), "fy": ("fy", "bsns_year"), "reported_in": ("reported_in", "bsns_year", "fy"), "account": ("account", "account_nm"), "value": ("value", "thstrm_amount"), "receipt": ("receipt", "rcept_no")}
DISCLOSURE_FIELDS = {"event_id": ("event_id", "rcept_no"), "corp": ("corp", "corp_code"), "ts": ("ts", "rcept_dt"), "type": ("type", "report_nm")}


def bound(found: DataFrame, filings: DataFrame) -> DataFrame:
    """found: of archive.report_sections. Adds receipt, corp, fy; a receipt that isn't a filing of the release has neither company nor year."""
    receipt = F.regexp_extract("archive", r"([^/]+)\.zip$", 1)
    return found.withColumn("receipt", receipt).join(filings.select("receipt", "corp", "fy"), "receipt", "left")


def release_sections(found: DataFrame, filings: DataFrame, titles: Mapping[tuple[str, str], str] = SECTION_TITLES) -> DataFrame:
    """The section table: kind and topic by title (others are kind ``other``, with the title as topic)."""
    place = topic_of(F.col("title"), {"\t".join(k): p for k, p in titles.items()})
    rows = bound(found, filings).withColumn("place", F.split(place, "\t"))
    kind, topic = F.coalesce(F.get("place", F.lit(0)), F.lit("other")), F.coalesce(F.get("place", F.lit(1)), F.col("title"))
    return rows.select("receipt", "corp", "fy", kind.alias("kind"), topic.alias("topic"), "text", "start", "end", "state")


def release_notes(found: DataFrame, filings: DataFrame, topics: Mapping[str, str] = NOTE_TOPICS, excerpt: int = 400) -> DataFrame:
    """The note table: a row for each topic whose pattern is in a section's title or text, with an excerpt from there on and where it lies; sections that couldn't be read give none."""
    rows = bound(found.where(F.col("state") == AVAILABLE), filings)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.regexp_instr("text", F.lit(p)).alias("at"), F.col("title").rlike(p).alias("titled")) for t, p in topics.items())))
    hits = rows.withColumn("hit", each).where("hit.at > 0 OR hit.titled").withColumn("from", F.greatest(F.col("hit.at"), F.lit(1)))
    text = F.substring(F.col("text"), F.col("from"), F.lit(excerpt))
    begin = F.col("start") + F.col("from") - 1
    locator = F.struct(F.concat_ws("#", "member", "section").alias("section"), begin.alias("start"), (begin + F.length(text)).cast("int").alias("end"))
    return hits.select("receipt", "corp", "fy", F.col("hit.topic").alias("topic"), text.alias("excerpt"), locator.alias("locator"), F.create_map(F.lit("title"), F.coalesce("title", F.lit(""))).alias("format"), "state")


def field(names: Sequence[str]) -> Column:
    """The first of the names that a line has."""
    return F.coalesce(*(F.try_element_at(F.col("line"), F.lit(n)) for n in names))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as maps of strings, whatever fields a year has; null where a line is no JSON."""
    return spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("line"), "value")


def parsed_facts(spark: SparkSession, path: str, accounts: Mapping[str, str], fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every line, parsed as far as it can be: the fact table's columns, line (as it came), and reason (why it is no fact; null: it is one)."""
    names = F.create_map(*(F.lit(x) for pair in accounts.items() for x in pair))
    rows = lines_of(spark, path).select("value", F.col("line").isNull().alias("broken"), *(field(n).alias(f"own_{k}") for k, n in fields.items()))
    number = F.expr("try_cast(replace(own_value, ',', '') AS decimal(38,2))")
    out = rows.select(F.col("own_corp").alias("corp"), F.expr("try_cast(own_fy AS int)").alias("fy"), F.expr("try_cast(own_reported_in AS int)").alias("reported_in"), F.try_element_at(names, F.col("own_account")).alias("account"), number.alias("value"), F.col("own_receipt").alias("receipt"), F.col("value").alias("line"), "broken", "own_account", "own_value", "own_fy")
    missing = [("no JSON", F.col("broken")), ("no company", F.col("corp").isNull()), ("no year", F.col("own_fy").isNull()), ("year is no number", F.col("fy").isNull()), ("no account", F.col("own_account").isNull()), ("account isn't mapped", F.col("account").isNull()), ("no value", F.col("own_value").isNull()), ("value is no number", F.col("value").isNull())]
    return out.withColumn("reason", F.coalesce(*(F.when(test, F.lit(reason)) for reason, test in missing))).drop("broken", "own_account", "own_value", "own_fy")


def rejected_facts(spark: SparkSession, path: str, accounts: Mapping[str, str], fields: Mapping[str, Sequence[str]] = FACT_FIELDS) -> DataFrame:
    """All lines that facts_from_json leaves out, by any of a field's names: corp, fy, receipt (as far as they are known), line, reason, state. Nothing vanishes: a line is here or a fact."""
    return parsed_facts(spark, path, accounts, fields).where("reason IS NOT NULL").select("corp", "fy", "receipt", "line", "reason", F.lit(UNVERIFIED).alias("state"))


def facts_from_json(spark: SparkSession, path: str, accounts: Mapping[str, str], fields: Mapping[str, Sequence[str]] = FACT_FIELDS) -> DataFrame:
    """The fact table. accounts: name in the lists -> account; lines of other accounts, or without company, year or number, are left out (rejected_facts has them, with the reason)."""
    return parsed_facts(spark, path, accounts, fields).where("reason IS NULL").drop("line", "reason")


def facts_from_tables(found: DataFrame, filings: DataFrame, accounts: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """found: of report_tables.table_facts, written before; filings: receipt, corp, fy. The fact table, and what isn't in it with its reason.

    accounts: the last header of a row -> account. A fact's year is the first number of four digits (19.. or 20..) in its column's headers, else its filing's; it
    was reported in its filing's year. Of several cells for one account and year in a report, the first counts; the others are ``repeated``. Nothing vanishes: a cell is in one of the two.
    """
    names = F.create_map(*(F.lit(x) for pair in accounts.items() for x in pair))
    rows = bound(found, filings).withColumnRenamed("fy", "filed_for")
    year = F.regexp_extract("period", r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    own = F.trim(F.element_at(F.split("account", " / "), -1))
    rows = rows.select("archive", "member", "nth", "row", "col", "corp", F.coalesce(F.nullif(year, F.lit("")).cast("int"), F.col("filed_for").cast("int")).alias("fy"), F.col("filed_for").cast("int").alias("reported_in"), F.try_element_at(names, own).alias("own"), "account", "value", "receipt", "text", "reason")
    reason = F.coalesce("reason", F.when(F.col("corp").isNull(), "receipt isn't filed"), F.when(F.col("own").isNull(), "account isn't mapped"))
    rows = rows.withColumn("reason", reason)
    first = Window.partitionBy("receipt", "corp", "fy", "own").orderBy("member", "nth", "row", "col")
    good = rows.where("reason IS NULL").withColumn("reason", F.when(F.row_number().over(first) > 1, "repeated"))
    facts = good.where("reason IS NULL").select("corp", "fy", "reported_in", F.col("own").alias("account"), "value", "receipt")
    left = ["archive", "member", "nth", "row", "col", "account", "text", "reason"]
    rejected = rows.where("reason IS NOT NULL").select(*left).unionByName(good.where("reason IS NOT NULL").select(*left))
    return facts, rejected.withColumn("state", F.lit(UNVERIFIED))


def disclosures_from_json(spark: SparkSession, path: str, fields: Mapping[str, Sequence[str]] = DISCLOSURE_FIELDS) -> DataFrame:
    """The disclosure table. attrs: the line as it came."""
    rows = lines_of(spark, path).where("line IS NOT NULL").select(*(field(n).alias(k) for k, n in fields.items()), F.col("value").alias("attrs"))
    at = F.coalesce(F.expr("try_cast(ts AS timestamp_ntz)"), F.expr("try_to_timestamp(ts, 'yyyyMMdd')").cast("timestamp_ntz"))
    return rows.select("event_id", "corp", at.alias("ts"), "type", "attrs").where("event_id IS NOT NULL")


def rejected_lines(spark: SparkSession, path: str, needed: Sequence[str]) -> DataFrame:
    """value, state: lines that are no JSON or lack a needed field: their place is known, their content isn't."""
    missing = F.col("line").isNull()
    for name in needed:
        missing |= F.try_element_at(F.col("line"), F.lit(name)).isNull()
    return lines_of(spark, path).where(missing).select("value", F.lit(UNVERIFIED).alias("state"))
