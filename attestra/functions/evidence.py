"""Evidence states: what a result may claim about its source.

Absence is a row. A request without a source yields an ``unavailable`` row; a combined
result is no better than the worst of its inputs; only ``available`` rows show an excerpt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, from best to worst.
STATES = ("available", "summary_only", "unverified", "unavailable")
AVAILABLE, SUMMARY_ONLY, UNVERIFIED, UNAVAILABLE = STATES
#: The least that an evidence-bearing result says of its source.
PROVENANCE = ("corp", "fy", "receipt", "topic", "state")


def rank_of(state: Column) -> Column:
    """0 for the best state; null, or anything unknown, ranks as the worst."""
    return F.coalesce(*(F.when(state == s, F.lit(i)) for i, s in enumerate(STATES)), F.lit(len(STATES) - 1))


def state_of(rank: Column) -> Column:
    """The state of a rank; null is ``unavailable``."""
    return F.coalesce(F.get(F.array(*map(F.lit, STATES)), rank.cast("int")), F.lit(UNAVAILABLE))


def best(state: Column) -> Column:
    """Of several sources for one thing, the best (an aggregate)."""
    return state_of(F.min(rank_of(state)))


def combined(*states: Column) -> Column:
    """Of inputs that are all needed, the worst."""
    return state_of(F.greatest(*map(rank_of, states))) if len(states) > 1 else state_of(rank_of(states[0]))


def derived(state: Column) -> Column:
    """Of a value computed from a source: at best ``summary_only``."""
    return combined(state, F.lit(SUMMARY_ONLY))


def shown(excerpt: Column, state: Column) -> Column:
    """The excerpt where it is confirmed, else null."""
    return F.when(state == AVAILABLE, excerpt)


def grid(companies: DataFrame, years: Sequence[int], topics: Sequence[str] = ()) -> DataFrame:
    """A row for each company, year and topic asked for. Years and topics are short lists of the request."""
    out = companies.withColumn("fy", F.explode(F.array(*map(F.lit, years)).cast("array<int>")))
    return out.withColumn("topic", F.explode(F.array(*map(F.lit, topics)))) if topics else out


def answer(facts: dict[str, Column], analysis: dict[str, Column], next_checks: Sequence[Column], provenance: dict[str, Column]) -> list[Column]:
    """Four columns that keep facts, analysis, next checks and provenance apart. Null next checks are left out."""
    if missing := set(PROVENANCE) - set(provenance):
        raise ValueError(f"provenance lacks {sorted(missing)}")
    parts = {"facts": facts, "analysis": analysis, "provenance": provenance}
    structs = {name: (F.struct(*(c.alias(k) for k, c in columns.items())) if columns else F.lit(None).cast("struct<>")).alias(name) for name, columns in parts.items()}
    return [structs["facts"], structs["analysis"], F.array_compact(F.array(*next_checks)).alias("next_checks"), structs["provenance"]]


def response(df: DataFrame) -> DataFrame:
    """One JSON string for each row, nulls included, so that what is missing is seen: what a caller of a tool gets."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("response"))
