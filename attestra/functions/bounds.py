"""Bounded inputs: what a request may ask for."""

from __future__ import annotations

from collections.abc import Sequence

DEFAULT_LIMIT, MOST_LIMIT, MOST_KEYS = 100, 1000, 1000


def bounded_limit(limit: int = DEFAULT_LIMIT) -> int:
    if not 1 <= limit <= MOST_LIMIT:
        raise ValueError(f"limit must be 1 to {MOST_LIMIT}, not {limit}")
    return limit


def bounded_keys(keys: Sequence) -> list:
    if not 1 <= len(keys) <= MOST_KEYS:
        raise ValueError(f"1 to {MOST_KEYS} keys may be named, not {len(keys)}")
    return list(keys)


def search_term(term: str) -> str:
    if not term or len(term) > 200:
        raise ValueError("a search term has 1 to 200 characters")
    return term
