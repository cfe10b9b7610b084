"""search_disclosure_events, fetch_disclosure_on_demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.bounds import bounded_keys, bounded_limit
from attestra.functions.evidence import UNVERIFIED
from attestra.operators.asof import as_of

__all__ = ["as_of", "disclosure_lookup", "search_disclosure_events"]


def search_disclosure_events(events: DataFrame, types: Sequence[str], since: str, until: str, limit: int = 100) -> DataFrame:
    """events: event_id, corp, ts, type, value. The latest of the given types from ``since`` to before ``until``."""
    hits = events.where(F.col("type").isin(bounded_keys(types)) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return hits.orderBy(F.desc("ts"), "event_id").limit(bounded_limit(limit))


def disclosure_lookup(requests: DataFrame, filings: DataFrame) -> DataFrame:
    """requests: receipt. What the release holds of them: receipt, corp, state. The network is never asked: a receipt that isn't there is ``unverified``."""
    found = filings.select("receipt", "corp", "state")
    return requests.select("receipt").join(found, "receipt", "left").select("receipt", "corp", F.coalesce("state", F.lit(UNVERIFIED)).alias("state"))
