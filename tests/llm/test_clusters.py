"""Ball k-means against Lloyd's rounds in plain Python."""

from __future__ import annotations

import hashlib
import random
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from attestra.llm import clusters
from attestra.llm.clusters import balls, clustered, nearest


def plain(rows, k: int, rounds: int, dims: int) -> list[tuple]:
    kept = [(i, [floor(256 * float(x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(place(v)[1], []).append(v)
        for c, vs in members.items():
            centres[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    inertia = lambda c: sum(d for _, x, d in found if c in (None, x))
    key = lambda r: (r[0] is None, r)
    return sorted(((i, c, d, inertia(c), inertia(None), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=key)


def got(df, k: int, rounds: int, dims: int) -> list[tuple]:
    rows = clustered(df, k, rounds, dims).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def vectors(seed: int, n: int, dims: int, scale: float = 1.0) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    near = lambda c: [float(np.float32(scale * (x + rng.gauss(0, 0.3)))) for x in c]
    rows = [(i, near(rng.choice(centres[: rng.choice([1, 7])]))) for i in range(n)]
    return rows + [(i + n, rows[0][1]) for i in range(n // 3)]  # a third of all rows is one vector


@pytest.mark.parametrize(("k", "rounds", "seed", "at_once"), [(40, 5, 1, 16_384), (5, 3, 2, 50), (1, 2, 3, 7), (12, 0, 4, 100)])
def test_agrees_with_all_distances(spark, monkeypatch, k, rounds, seed, at_once):
    monkeypatch.setattr(clusters, "ROWS_AT_ONCE", at_once)
    rows = vectors(seed, 400, 6)
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), k, rounds, 6) == plain(rows, k, rounds, 6)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, nan, 0.0]), (6, [inf, 0.0, 0.0]), (7, [-0.0, 0.001, -0.001])]
    rows += [(None, [1.0, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (8, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [-1.0, 2.0, 3.0])]
    rows = [(*r, 5, "x", 0.5) for r in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, v string, distance double")
    assert got(df, 4, 3, 3) == plain(rows, 4, 3, 3)
    assert got(df, 40, 3, 3) == plain(rows, 40, 3, 3)
    assert clustered(df.limit(0)).collect() == [] and clustered(df, dims=7).collect() == []


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(60)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 9, 4, 2) == plain(rows, 9, 4, 2)


def test_components_beyond_doubles_exactness(spark):
    rows = vectors(6, 60, 4, 1e5)
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 6, 3, 4) == plain(rows, 6, 3, 4)
    far = [(r.distance, r.inertia) for r in clustered(spark.createDataFrame([(1, [1e18]), (2, [-1e18]), (3, [0.0])], "vec_id long, embedding array<double>"), 1, 0, 1).collect()]
    assert sorted(far, key=str) == [(0, None), (None, None), (None, None)]


def test_stable_members_are_not_compared(monkeypatch):
    """Far-off balls have no neighbours, and members of the core meet no other centroid."""
    centres = [[0, 0], [1000, 0], [0, 1000]]
    found = balls(centres, [10, 10, 10])
    assert [len(b.neighbours) for b in found] == [0, 0, 0]
    wide = balls(centres, [600, 10, 10])
    assert wide[0].neighbours.tolist() == [1, 2] and len(wide[1].neighbours) == 0
    best, distance = nearest(np.array([[1.0, 2.0], [500.0, 0.0], [501.0, 0.0]]), np.zeros(3, np.int64), wide)
    assert best.tolist() == [0, 0, 1] and distance.tolist() == [5, 250_000, 249_001]


def test_k_is_bounded(spark):
    with pytest.raises(ValueError, match="k must be"):
        clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"), 10**6)
