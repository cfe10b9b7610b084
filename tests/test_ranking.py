"""Ranks, medians and neighbours against windows and plain sorting."""

from __future__ import annotations

import random
from statistics import median

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators.ranking import value_ranks, with_neighbours


def test_ranks_agree_with_windows(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rng.choice([None, 5.0, 5.0, rng.random(), float(rng.randrange(20))])) for i in range(1500)] + [(9000, "lone", 1.0), (9001, "unknown", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: r for r in value_ranks(df, ["g"], "v").collect()}
    want = {r.id: r.p for r in df.select("id", F.percent_rank().over(Window.partitionBy("g").orderBy("v")).alias("p")).collect()}
    assert {i: r.pct for i, r in got.items()} == want
    for g in {g for _, g, _ in rows}:
        known = [v for _, x, v in rows if x == g and v is not None]
        assert {r.median for r in got.values() if r.g == g} == {median(known) if known else None}


def test_neighbours_cross_blocks(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 5 == 0], float(rng.randrange(90))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: [x.peer for x in r.near] for r in with_neighbours(df, ["g"], "v", "id", 3, block=10).collect()}
    assert len(got) == 300
    for g in "ab":
        order = [i for v, i in sorted((v, i) for i, x, v in rows if x == g)]
        for at, i in enumerate(order):
            assert got[i] == order[max(0, at - 3) : at] + order[at + 1 : at + 4]


def test_rows_without_a_group_are_a_group(spark):
    rows = [(1, None, 2020, 5.0), (2, None, 2020, 7.0), (3, "a", None, 1.0), (4, "a", 2020, None)]
    got = value_ranks(spark.createDataFrame(rows, "id long, g string, fy int, v double"), ["g", "fy"], "v").collect()
    assert sorted((r.id, r.pct, r.median) for r in got) == [(1, 0.0, 6.0), (2, 1.0, 6.0), (3, 0.0, 1.0), (4, 0.0, None)]
