"""Nearest peers where many companies have one size."""

from __future__ import annotations

import random
from decimal import Decimal

from attestra.operators.peers import peers_by_size


def test_ties_go_to_the_lowest_keys_of_all(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), Decimal(rng.choice([0, 0, 0, 5, 5, 9, rng.randrange(40)]))) for i in range(120)] + [(500, "a", None), (501, "c", Decimal(1))]
    k, want = 3, []
    for corp, industry, size in rows:
        others = sorted((abs(size - s), c) for c, i, s in rows if i == industry and c != corp and s is not None) if size is not None else []
        want += [(corp, c, n, float(d)) for n, (d, c) in enumerate(others[:k], 1)]
    got = peers_by_size(spark.createDataFrame(rows, "corp long, industry string, size decimal(25,2)"), k).select("target", "peer", "rank", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want)
