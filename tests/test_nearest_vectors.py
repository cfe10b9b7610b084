"""The nearest vectors against all pairs, summed one by one."""

from __future__ import annotations

import math
import random

import pytest

from attestra.operators import semantic


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def order(score):
    return (2, 0) if score is None else (0, 0) if math.isnan(score) else (1, -score)


@pytest.mark.parametrize(("values", "scores"), [(1 << 20, 1 << 21), (24, 90)])
def test_nearest_vectors_are_exact(spark, monkeypatch, values, scores):
    """Ties, near ties, vectors with nulls, other lengths, NaN and numbers whose products overflow; in blocks and chunks. No pairs are made but of the few that have no k others."""
    monkeypatch.setattr(semantic, "TARGET_VALUES", values, raising=False)
    monkeypatch.setattr(semantic, "SCORES", scores, raising=False)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.5, 0.1, -0.3, rng.random()]) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.1, 0.2, 0.3, 0.4 + (i % 3) * 2**-53]) for i in range(60)]  # equal, or differing in the last bit
    regular = list(rows)
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [1.0, 2.0]), (410, [3.0, 2.0]), (403, []), (404, [math.nan, 0.0, 0.0, 1.0]), (405, [1e200, -1e200, 1e200, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    for case, asked in ((regular, 10), (rows, 5)):
        df = spark.createDataFrame(case, "id long, vector array<double>").repartition(3)
        wanted = [r for r in case if r[0] is not None and r[0] % asked == 0]
        got = semantic.peer_context(df, df.where(f"id % {asked} = 0"), 3)
        assert case is rows or "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
        want = {}
        for t, v in wanted:
            best = sorted(((order(s := cosine(w, v)), p, s) for p, w in case if p is not None and p != t))[:3]
            want |= {(t, n): (p, repr(s)) for n, (_, p, s) in enumerate(best, 1)}
        assert {(r.target, r["rank"]): (r.peer, repr(r.score)) for r in got.collect()} == want
