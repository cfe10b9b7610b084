"""The pipeline's near-dedup stage against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from attestra.llm import near_copies as s


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """Lowest position of each text's group."""
    own, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def planted():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 9, 60, 200, 300]))) for _ in range(30)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = base + [edited(rng, t, k) for t in base[:20] for k in (1, 2, 3) if len(t.split()) > 20]
    texts += [f"{rng.random()} {passage} {rng.random()}" for _ in range(12)] + [f"{t} {passage}" for t in base]
    texts += [base[0].upper(), base[1], None, "", " ", "one two", "One  two", "one three"]
    one = base[3]
    for i in range(40):  # a chain whose ends are not similar
        one = edited(rng, one, 1) if len(one.split()) > 20 else base[i % 30]
        texts.append(one)
    return texts


def test_stage_leaves_one_row_of_each_group(spark, monkeypatch):
    texts = planted()
    want = brute_groups(texts)
    assert len(set(want)) < len(texts) - 40
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)] * 3, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for often in (2, 3, 10**6):
        monkeypatch.setattr(s, "OFTEN", often)
        rows = p.simhash_dedup(spark, docs, "").collect()
        assert sorted(r.doc_id for r in rows) == sorted(set(want)), often


def candidates(spark, monkeypatch, texts):
    """Groups' lowest positions as the stage gives them, and how many rows the join of sets that stars have not joined makes."""
    made, verified = [], s.verified
    monkeypatch.setattr(s, "verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in s.without_similar(docs).collect()), made[-1]


def test_rows_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies with one to twelve edits each: those of few are similar to each other, those of many to the least edited alone, or to none."""
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(250))
    texts = [edited(rng, base, 1 + i % 12) for i in range(320)]
    few, many = (candidates(spark, monkeypatch, t) for t in (texts[:80], texts))
    assert few[0] == sorted(set(brute_groups(texts[:80]))) and many[0] == sorted(set(brute_groups(texts)))
    assert 1 < len(few[0]) < 80 and few[1] <= 80 and many[1] <= 320, (few[1], many[1])


def test_long_texts_that_share_passages_are_met_once(spark, monkeypatch):
    """Texts of 3,000 words that share no, one or many of their first shingles, but are not similar; and a copy that just is."""
    rng = random.Random(12)
    pool = [" ".join(f"p{k}_{i}" for i in range(300)) for k in range(6)]
    texts = [" ".join([*(f"u{i}_{j}" for j in range(2400)), *rng.sample(pool, 2)]) for i in range(40)]
    texts += [edited(rng, texts[0], k) for k in (5, 60, 62, 64, 66, 68, 70, 90)]
    kept, rows = candidates(spark, monkeypatch, texts)
    assert kept == sorted(set(brute_groups(texts)))
    assert rows <= len(texts), rows


def test_bound_on_unshared_shingles_is_never_too_high(spark):
    """Sets of roots of their own, of any sizes and overlaps: no pair differs in fewer shingles than the bound says, and each that shares some of its first ones is met."""
    rng = np.random.default_rng(13)
    pool = np.unique(rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2))
    last = np.sort(rng.choice(pool, 150, replace=False))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 2, 3, 4, 5, 6, 7, 11, 25, 60, 100, 150, 200, 260, 300, 330, 360, 380, 390, 400)]
    sets += [np.sort(np.concatenate([x[: len(x) - 7], rng.integers(0, 1 << 63, 9, np.uint64)])) for x in sets[9:]]
    first = [s.prefix(x, last) for x in sets]
    rows = [(int(h.view(np.int64)), i, place, i, len(sets[i]), *s.cuts(p, last)) for i, p in enumerate(first) for place, h in enumerate(p)]
    table = spark.createDataFrame(rows, "h long, sid long, place int, root long, n long, " + ", ".join(f"{c} long" for c in s.CUTS))
    several = table.groupBy("h").count().where("count > 1").select("h")
    rest = s.unshared(table.join(several, "h")).cache()
    met = rest.alias("a").join(rest.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.root") < F.col("b.root")))
    got = met.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v"), s.unlike("a", "b").alias("least"), s.first_met("a", "b").alias("met")).collect()
    assert all(r.least <= len(np.setxor1d(sets[r.u], sets[r.v])) for r in got) and any(r.least for r in got)
    assert {(r.u, r.v) for r in got if r.met} == {(u, v) for u, v in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(first[u], first[v]))}
    assert sum(r.met for r in got) < len(got) / 2
