"""search_company, search_dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.bounds import bounded_limit, search_term


def occurrences(text: Column, term: str) -> Column:
    """How often the term is in a text, without overlaps, whatever the case."""
    term = search_term(term).lower()
    text = F.lower(text)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def search_company(companies: DataFrame, query: str, limit: int = 20, typos: int = 0) -> DataFrame:
    """Companies (corp, name) whose name contains the query, whatever the case, or is within ``typos`` edits of it (one for each four letters of the query at most), by edit distance to it, then by key."""
    asked = search_term(query).lower()
    found = F.lower("name").contains(asked)
    if edits := min(typos, len(asked) // 4):
        found |= F.levenshtein(F.lower("name"), F.lit(asked), edits) >= 0
    hits = companies.where(found).select("corp", "name", F.levenshtein("name", F.lit(query)).cast("long").alias("distance"))
    return hits.orderBy("distance", "corp").limit(bounded_limit(limit))


def search_dataset(kinds: Sequence[tuple[str, DataFrame]], query: str, limit: int = 100) -> DataFrame:
    """kinds: (kind, DataFrame of id, label, text and, where ids repeat, at), ids of one type. Hits of all kinds by number of occurrences, then by kind, id, label and at."""
    out = None
    for kind, df in kinds:
        at = F.col("at").cast("long") if "at" in df.columns else F.lit(0).cast("long")
        hits = df.select(F.lit(kind).alias("kind"), "id", "label", at.alias("at"), occurrences(F.col("text"), query).alias("score")).where("score > 0")
        out = hits if out is None else out.unionByName(hits)
    return out.orderBy(F.desc("score"), "kind", "id", "label", "at").limit(bounded_limit(limit)).drop("at")
