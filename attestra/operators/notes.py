"""get_audit_report_sections, search_audit_report_matters, search_audit_procedures, get_accounting_policy, compare_peer_accounting_policies, compare_peer_accounting_notes, get_accounting_policy_changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.bounds import bounded_keys, bounded_limit
from attestra.functions.evidence import AVAILABLE, SUMMARY_ONLY, UNAVAILABLE, UNVERIFIED, shown
from attestra.operators.ranking import with_neighbours
from attestra.operators.search import occurrences


def topic_of(text: Column, patterns: Mapping[str, str]) -> Column:
    """The first topic whose pattern is in the text, else null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(t)) for t, p in patterns.items()))


def format_of(text: Column) -> Column:
    """Format metadata: how often each kind of mark-up is in a text, as a map of tag names."""
    tags = F.regexp_extract_all(text, F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    kinds = F.array_sort(F.array_distinct(tags))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(tags, lambda t: t == k))))


def search_sections(sections: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """sections: doc_id, pos, section. Those with the term, most occurrences first: doc_id, pos, score."""
    return sections.select("doc_id", "pos", occurrences(F.col("section"), query).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id", "pos").limit(bounded_limit(limit))


def accounting_policy(documents: DataFrame, topics: Sequence[str], checked: DataFrame) -> DataFrame:
    """documents: doc_id, text; checked: doc_id. A row for each document and topic: doc_id, topic, at (first place of it, from 1), excerpt, state.

    available: the topic is there; unverified: it isn't found, but the document is known elsewhere; else unavailable.
    """
    grid = documents.withColumn("topic", F.explode(F.array(*map(F.lit, bounded_keys(topics)))))
    found = grid.withColumn("at", F.nullif(F.expr("locate(topic, text)"), F.lit(0)).cast("long")).join(checked.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    state = F.when(F.col("at").isNotNull(), AVAILABLE).when(F.col("known"), UNVERIFIED).otherwise(UNAVAILABLE)
    return found.withColumn("state", state).select("doc_id", "topic", "at", shown(F.expr("substring(text, cast(at AS int), 40)"), F.col("state")).alias("excerpt"), "state")


def compare_peer_policies(sections: DataFrame, group: Sequence[str] = ("lang", "source")) -> DataFrame:
    """sections: doc_id, section and the group's columns. The first document of each group is the target; each other one is a peer: doc_id, target, n_lines, shared (distinct lines it has in common with the target)."""
    lines = sections.select(*group, "doc_id", "section").distinct()
    targets = lines.groupBy(*group).agg(F.min("doc_id").alias("target"))
    marked = lines.join(targets, list(group))
    theirs = marked.where("doc_id = target").select(*group, "section", F.lit(1).alias("same"))
    peers = marked.where("doc_id <> target").join(theirs, [*group, "section"], "left")
    return peers.groupBy("doc_id", "target").agg(F.count("*").alias("n_lines"), F.count("same").alias("shared"))


def compare_peer_notes(policies: DataFrame, facts: DataFrame) -> DataFrame:
    """policies: of compare_peer_policies; facts: doc_id, fact. Adds both facts and a state: counts of shared lines are summary_only at best, unverified where one of the facts is missing."""
    of = lambda key, name: facts.select(F.col("doc_id").alias(key), F.col("fact").alias(name))
    out = policies.join(of("doc_id", "fact"), "doc_id", "left").join(of("target", "target_fact"), "target", "left")
    return out.select("doc_id", "target", "shared", "fact", "target_fact", F.when(F.col("fact").isNull() | F.col("target_fact").isNull(), UNVERIFIED).otherwise(SUMMARY_ONLY).alias("state"))


def earlier(documents: DataFrame, group: Sequence[str]) -> DataFrame:
    """doc_id, prev: the document before each in its group, from ids alone."""
    near = with_neighbours(documents.select(*group, "doc_id"), group, "doc_id", "doc_id", 1)
    return near.select("doc_id", F.get(F.filter("near", lambda x: x["peer"] < F.col("doc_id")), F.lit(0))["peer"].alias("prev")).where("prev IS NOT NULL")


def with_prior(documents: DataFrame, group: Sequence[str] = ("lang", "source")) -> DataFrame:
    """documents: doc_id, text and the group's columns. doc_id, prev, before, after: each document's text with that of the one before in its group."""
    texts = documents.select("doc_id", F.col("text").alias("after"))
    return texts.join(earlier(documents, group), "doc_id").join(documents.select(F.col("doc_id").alias("prev"), F.col("text").alias("before")), "prev").select("doc_id", "prev", "before", "after")


def policy_changes(documents: DataFrame, group: Sequence[str] = ("lang", "source")) -> DataFrame:
    """documents: doc_id, text and the group's columns. Each document against the one before in its group: doc_id, prev, added, removed (distinct lines).

    Who comes before is found from ids alone, in buckets of each group; then texts meet in pairs.
    """
    pairs = earlier(documents, group)
    lines = documents.select("doc_id", F.split("text", "\n").alias("lines"))
    out = lines.join(pairs, "doc_id").join(lines.select(F.col("doc_id").alias("prev"), F.col("lines").alias("before")), "prev")
    return out.select("doc_id", "prev", F.size(F.array_except("lines", "before")).cast("long").alias("added"), F.size(F.array_except("before", "lines")).cast("long").alias("removed"))
