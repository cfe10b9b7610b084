"""Alignment of sentences, threads of matters, nearest peers and the market cube against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal
from itertools import combinations

import pytest

from attestra.operators import alignment, nearest
from attestra.operators.alignment import aligned, aligned_changes, changes, lengths, sentences
from attestra.operators.audit import kam_threads, market_cube
from attestra.operators.nearest import nearest_peers
from attestra.operators.peers import cohorts_by_code


def table(a, b) -> list[list[int]]:
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


@pytest.mark.parametrize("bits", [1 << 28, 40])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(alignment, "MOST_BITS", bits)
    rng = random.Random(1)
    for _ in range(300):
        a, b = (["abcdefgh"[rng.randrange(rng.choice([2, 8]))] for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == table(a, b)[-1][-1]
        assert all(i < p and j < q for (i, j), (p, q) in zip(pairs, pairs[1:], strict=False))
        assert lengths(a, b).tolist() == table(a, b)[-1]


def test_sentences_keep_their_places():
    text = "  First one. Second? \n\nThird line\t\nNo 3.5 split!  Ünder.  "
    assert [s for s, *_ in sentences(text)] == ["First one.", "Second?", "Third line", "No 3.5 split!", "Ünder."]
    assert all(text[a:b] == s for s, a, b in sentences(text)) and sentences(" \n ") == []


def test_changes_turn_one_text_into_the_other():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([f"S{rng.randrange(9)}." for _ in range(rng.randrange(12))] for _ in range(2))
        old, new = " ".join(a), " ".join(b)
        rows = changes(old, new)
        moved = [r for r in rows if r[0] == "moved"]
        assert all(old[r[1] : r[2]] == new[r[3] : r[4]] for r in moved)
        gone, came = sum(r[5] for r in rows), sum(r[6] for r in rows)
        kept = table(a, b)[-1][-1]
        assert len(a) - gone == len(b) - came == kept
        # what is neither moved nor kept has no fellow on the other side
        left, right = ([s for r in rows if r[0] != "moved" for s, x, y in sentences(t) if r[at] is not None and r[at] <= x and y <= r[at + 1]] for t, at in ((old, 1), (new, 3)))
        assert all((r[1] is None) == (r[0] == "added") and (r[3] is None) == (r[0] == "removed") for r in rows if r[0] != "moved")
        assert len(left) >= sum(r[5] for r in rows if r[0] != "moved") and len(right) >= sum(r[6] for r in rows if r[0] != "moved")


def test_kinds_and_spans(spark):
    before, after = "Keep this. And this. Old rule. Goes. Moves away. End.", "Moves away. Keep this. And this. New rule. Newer rule. End. Comes."
    rows = aligned_changes(spark.createDataFrame([(1, "x", before, after), (2, "y", None, "Only."), (3, "z", "Same.", "Same."), (4, "w", None, None)], "id long, k string, before string, after string"), ["id", "k"]).collect()
    told = [(r.id, r.nth, r.kind, r.before_start is not None and before[r.before_start : r.before_end], r.after_start is not None and after[r.after_start : r.after_end] if r.id == 1 else None) for r in rows]
    assert sorted(told) == [(1, 1, "moved", "Moves away.", "Moves away."), (1, 2, "changed", "Old rule. Goes.", "New rule. Newer rule."), (1, 3, "added", False, "Comes."), (2, 1, "added", False, None)]


def test_reworded_matters_continue(spark):
    said = [("a", 2020, "revenue recognition"), ("a", 2021, "revenue recognition and cut-off"), ("a", 2022, "revenue recognition and cut-off"), ("a", 2021, "lease liabilities"), ("a", 2022, "Lease liabilities measured"), ("a", 2022, "goodwill"), ("a", 2020, "??"), ("a", 2021, "??"), ("b", 2020, "goodwill"), ("b", 2022, "goodwill")]
    got = {(r.corp, r.fy, r.topic): (r.prior, r.entry, r.exit) for r in kam_threads(spark.createDataFrame(said, "corp string, fy int, topic string"), 2022, 0.4).collect()}
    assert got == {
        ("a", 2020, "revenue recognition"): (None, "new", "kept"),
        ("a", 2021, "revenue recognition and cut-off"): ("revenue recognition", "reworded", "kept"),
        ("a", 2022, "revenue recognition and cut-off"): ("revenue recognition and cut-off", "continued", "open"),
        ("a", 2021, "lease liabilities"): (None, "new", "kept"),
        ("a", 2022, "Lease liabilities measured"): ("lease liabilities", "reworded", "open"),
        ("a", 2022, "goodwill"): (None, "new", "open"),
        ("a", 2020, "??"): (None, "new", "kept"),
        ("a", 2021, "??"): ("??", "continued", "dropped"),
        ("b", 2020, "goodwill"): (None, "new", "dropped"),
        ("b", 2022, "goodwill"): (None, "new", "open"),
    }


def test_matters_without_a_name_a_year_or_a_company_have_no_partner(spark):
    said = [("a", 1, None), ("a", 2, None), ("a", None, "x y"), ("a", None, "x z"), (None, 1, "x y"), (None, 2, "x y"), ("a", 1, "x y"), ("a", 2, "x y"), ("a", 2, "x y")]
    got = sorted((tuple(r) for r in kam_threads(spark.createDataFrame(said, "corp string, fy int, topic string"), 2, 0.4).collect()), key=repr)
    lone = [(c, f, t, None, None, "new", "open" if f == 2 else "dropped") for c, f, t in said[:6]]
    assert got == sorted([*lone, ("a", 1, "x y", None, None, "new", "kept"), ("a", 2, "x y", "x y", 1.0, "continued", "open")], key=repr)


def test_threads_shuffle_topics_once(spark):
    """Words, pairs and links stay with their company: one exchange, where there were a dozen."""
    topics = spark.range(4000).selectExpr("id % 50 AS corp", "cast(id % 7 AS int) AS fy", "concat('w', id % 11, ' v', id % 13) AS topic")
    got = kam_threads(topics, 6, 0.3)
    assert got.count() > 3000 and got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_matters_are_matched_one_to_one(spark):
    rng = random.Random(3)
    rows = {(c, y, " ".join(sorted(rng.sample("abcde", rng.randrange(1, 5))))) for c in "pq" for y in (1, 2, 3) for _ in range(9)}
    want = {}
    for c in "pq":
        for y in (2, 3):
            now, before = ([set(t.split()) and t for k, f, t in rows if (k, f) == (c, x)] for x in (y, y - 1))
            sim = lambda p, t: len(set(p.split()) & set(t.split())) / len(set(p.split()) | set(t.split()))
            for _, _, p, t in sorted((-sim(p, t), p != t, p, t) for p in before for t in now if sim(p, t) >= 0.5):
                if (c, y, t) not in want and not any(k[:2] == (c, y) and v == p for k, v in want.items()):
                    want[c, y, t] = p
    got = {(r.corp, r.fy, r.topic): r.prior for r in kam_threads(spark.createDataFrame(list(rows), "corp string, fy int, topic string"), 3).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and got.keys() == rows


@pytest.mark.parametrize(("cell_rows", "chunks"), [(2048, (8192, 1024)), (16, (8192, 1024)), (16, (5, 3))])
def test_nearest_peers_are_exact(spark, monkeypatch, cell_rows, chunks):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", chunks[0])
    monkeypatch.setattr(nearest, "CHUNK_TARGETS", chunks[1])
    rng = random.Random(8)
    draw = lambda: rng.choice([0.0, 0.0, 1.0, rng.random() * 9, float(rng.randrange(5))])
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), draw(), draw()) for i in range(400)] + [(900 + i, "a", 3.0, 3.0) for i in range(150)]
    rows += [(2000, "a", None, 1.0), (2001, "a", float("nan"), 1.0), (2002, "lone", 1.0, 1.0)]
    known = [r for r in rows if r[0] not in (2000, 2001)]
    df = spark.createDataFrame(rows, "corp long, g string, x double, y double")
    got = defaultdict(list)
    for r in nearest_peers(df, df.where("corp % 4 = 0"), {"x": 2.0, "y": 0.5}, 4, ["g"]).orderBy("target", "rank").collect():
        got[r.target].append((r.distance, r.peer))
    for c, g, x, y in known:
        if c % 4 == 0:
            want = sorted(((p / 2 - x / 2) * (p / 2 - x / 2) + (q / 0.5 - y / 0.5) * (q / 0.5 - y / 0.5), d) for d, h, p, q in known if h == g and d != c)[:4]
            assert got[c] == want
    assert set(got) == {c for c, g, *_ in known if c % 4 == 0 and g != "lone"}
    assert nearest_peers(df.limit(0), df, {"x": 1.0}).collect() == []


@pytest.mark.parametrize("buckets", [12, 4])
def test_cube_agrees_with_counting(spark, monkeypatch, buckets):
    from attestra.operators import audit

    monkeypatch.setattr(audit, "LG_BUCKETS", buckets)
    rng = random.Random(2)
    rows = [(rng.choice([2020, 2021, None]), rng.choice(["x", "y", None]), rng.choice("AAB"), f"c{rng.randrange(40)}", Decimal(rng.randrange(100))) for _ in range(300)]
    want = defaultdict(lambda: [0, 0, set()])
    for fy, industry, auditor, corp, fee in rows:
        own = (fy, industry, auditor)
        for k in range(4):
            for keep in combinations(range(3), k):
                w = want[tuple(v if i in keep else None for i, v in enumerate(own)), sum(4 >> i for i in range(3) if i not in keep)]
                w[0] += float(fee)
                w[1] += 1
                w[2].add(corp)
    df = spark.createDataFrame(rows, "fy int, industry string, auditor string, corp string, fee decimal(12,0)")
    got = {((r.fy, r.industry, r.auditor), r.level): (r.fee, r.n, r.reported) for r in market_cube(df, 20).collect()}
    assert got == {k: (fee, n, len(corps) >= 20) for k, (fee, n, corps) in want.items()}


def test_cohorts(spark):
    df = spark.createDataFrame([(1, "261"), (2, "262"), (3, "47"), (4, None)], "corp long, code string")
    assert sorted(map(tuple, cohorts_by_code(df, 2).collect())) == [(1, "26", 1, 1, "prefix:26"), (2, "26", 1, 1, "prefix:26"), (3, "47", 3, 0, "prefix:47"), (4, None, None, 0, None)]
