"""Perimeters, names, as-of joins and versions against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from attestra.operators import asof, fuzzy
from attestra.operators.asof import as_of, known_at, versions
from attestra.operators.fuzzy import near_names
from attestra.operators.perimeter import perimeter


def plain_perimeter(edges, depth=None) -> dict:
    out = defaultdict(dict)
    shares = {}
    for p, c, s in edges:
        if p is not None and c is not None and p != c:
            shares[p, c] = max(shares.get((p, c), 0.0), min(1.0, max(0.0, s or 0.0)))
    below = defaultdict(list)
    for (p, c), s in shares.items():
        below[p].append((c, s))

    def walk(root, at, share, path):
        for c, s in below[at]:
            if c not in path and (depth is None or len(path) <= depth):
                level, best = out[root].get(c, (len(path), -1.0))
                out[root][c] = (min(level, len(path)), max(best, share * s))
                walk(root, c, share * s, [*path, c])

    for p in list(below):
        walk(p, p, 1.0, [p])
    return {(r, c): x for r, own in out.items() for c, x in own.items()}


@pytest.mark.parametrize("depth", [None, 1, 2])
def test_perimeter_with_cycles(spark, depth):
    rng = random.Random(2)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice([0.5, 0.25, 1.0, None, 0.0])) for _ in range(24)]
    edges += [(20, 21, 1.0), (21, 20, 1.0), (21, 22, 0.5), (22, 21, 1.0), (30, 30, 1.0), (31, None, 0.5), (None, 31, 0.5), (40, 41, 7.0), (40, 41, -1.0)]
    df = spark.createDataFrame(edges, "parent long, child long, share double")
    want = plain_perimeter(edges, depth)
    got = {(r.root, r.corp): (r.level, r.share) for r in perimeter(df, depth=depth).collect()}
    if depth is None:
        assert got == want
    else:
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)
    one = perimeter(df, spark.createDataFrame([(20,), (99,)], "root long")).collect()
    assert {(r.root, r.corp): (r.level, r.share) for r in one} == {(20, 21): (1, 1.0), (20, 22): (2, 0.5)}


def test_no_holdings(spark):
    assert perimeter(spark.createDataFrame([], "parent long, child long, share double")).collect() == []


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_near_names_are_all_found(spark, edits):
    rng = random.Random(9)
    stems = ["Alpha Chips", "Customer#000000012", "aaaaaaaa", "가람전자", "ab", "Ω"]
    names = ["", "a", "b", "ab", "ba", "abc", "xyz", "abcd", "zzzz", "a" * 5, "a" * 7]
    for _ in range(150):
        w = rng.choice(stems)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", "x", "0", "람"]) + w[at + rng.randrange(2) :]
        names.append(w)
    df = spark.createDataFrame([(n,) for n in [*names, None, names[3]]], "name string")
    got = {(r.name, r.other): r.distance for r in near_names(df, df, edits).collect()}
    assert got == {(a, b): d for a in set(names) for b in set(names) if a != b and (d := distance(a, b)) <= edits}


@pytest.mark.parametrize(("edits", "masked"), [(1, 3), (2, 3), (2, 8)])
def test_near_names_by_keys_and_by_grams(spark, monkeypatch, edits, masked):
    monkeypatch.setattr(fuzzy, "MASKED", masked, raising=False)
    rng = random.Random(5)
    names = {"".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(11))) for _ in range(250)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [(r.name, r.other, r.distance) for r in near_names(df, df, edits).collect()]
    assert sorted(got) == sorted((a, b, d) for a in names for b in names if a != b and (d := distance(a, b)) <= edits)


def test_names_with_common_parts_are_compared_about_as_often_as_they_are_near(spark, monkeypatch):
    """Numbered names, all of whose grams many have."""
    names = spark.range(10_000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS name")
    found = near_names(names, names.where("name LIKE '%00'")).count()
    compared = spark.sparkContext.accumulator(0)

    def told(a, b):
        compared.add(1)
        return 1

    monkeypatch.setattr(fuzzy.F, "levenshtein", lambda a, b, n: F.udf(told, "int").asNondeterministic()(a, b))
    near_names(names, names.where("name LIKE '%00'")).count()
    assert found > 20_000 and compared.value <= 1.1 * found


def test_a_misspelt_name_is_found(spark):
    names = spark.createDataFrame([("Samsong Electronics",), ("Samsung Electronics",), ("Sam",)], "name string")
    asked = spark.createDataFrame([("Samsung Electroncs",)], "name string")
    assert {(r.other, r.distance) for r in near_names(names, asked).collect()} == {("Samsung Electronics", 1), ("Samsong Electronics", 2)}


@pytest.mark.parametrize("hot", [10**6, 40])
def test_as_of_with_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(asof, "HOT_ROWS", hot)
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rng.choice([None, *range(0, 60)] if i % 2 else [7])) for i in range(400)]
    right = [(rng.choice([None, *range(1000)]), key(), rng.choice([None, *range(10, 50)])) for _ in range(300)]
    a = spark.createDataFrame(left, "name long, k string, t int").selectExpr("name", "k", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,t) AS at", "t AS latest")
    b = spark.createDataFrame(right, "id long, k string, t int").selectExpr("id", "k", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,t) AS at")
    got = {r.name: r.latest_id for r in as_of(a, b, "k", "at", "at", "id").collect()}
    want = {}
    for name, k, t in left:
        found = [(s, i) for i, j, s in right if None not in (i, j, s, k, t) and j == k and s <= t]
        want[name] = max(found)[1] if found else None
    assert got == want


def test_no_task_holds_a_hot_key(spark, monkeypatch):
    """The window over a hot key is partitioned by stretches of time too."""
    monkeypatch.setattr(asof, "HOT_ROWS", 100)
    rows = spark.range(1000).selectExpr("id", "1 AS k", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id) AS at")
    found = as_of(rows, rows, "k", "at", "at", "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "stretch" in plan.split("Window")[1]
    assert found.where("latest_id <> id OR latest_id IS NULL").isEmpty()


def test_versions_of_facts(spark):
    t = lambda d: f"2024-01-{d:02d}"
    said = [("a", 5, t(1), "r1"), ("a", 5, t(3), "r2"), ("a", 7, t(4), "r3"), ("a", 8, t(4), "r4"), ("a", None, t(6), "r5"), ("a", 8, t(9), "r6"), ("b", 1, None, "r7"), ("c", None, t(2), "r8"), (None, 3, t(2), "r9")]
    df = spark.createDataFrame(said, "k string, v int, day string, receipt string").selectExpr("k", "v", "cast(day AS timestamp_ntz) AS at", "receipt")
    found = versions(df, ["k"], "v", "at", "receipt")
    got = sorted(((r.k, r.value, r.known_from.day, r.known_to and r.known_to.day, r.source, r.version) for r in found.collect()), key=str)
    assert got == sorted([("a", 5, 1, 4, "r1", 1), ("a", 8, 4, 6, "r4", 2), ("a", None, 6, 9, "r5", 3), ("a", 8, 9, None, "r6", 4), ("c", None, 2, None, "r8", 1), (None, 3, 2, None, "r9", 1)], key=str)
    asked = spark.createDataFrame([("a", t(1)), ("a", t(5)), ("a", t(6)), ("a", "2023-12-31"), ("b", t(9)), ("x", t(9)), (None, t(9))], "k string, day string").selectExpr("k", "cast(day AS timestamp_ntz) AS at")
    known = {(r.k, str(r.at)[:10]): (r.version, r.value, r.source) for r in known_at(asked, found, ["k"], "at").collect()}
    nothing = (None, None, None)
    assert known == {("a", t(1)): (1, 5, "r1"), ("a", t(5)): (2, 8, "r4"), ("a", t(6)): (3, None, "r5"), ("a", "2023-12-31"): nothing, ("b", t(9)): nothing, ("x", t(9)): nothing, (None, t(9)): nothing}
