"""Pieces that run in tasks, called directly so that their sizes can be varied; and the exact ways for crowded groups."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import simhash as s
from attestra.llm import substring_dedup as d
from attestra.llm.components import components
from attestra.llm.fm_index import Bits, FmIndex, Wavelet, suffix_order
from attestra.llm.shingles import Words

NONE = np.zeros(0, np.uint64)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.booleans(), min_size=1, max_size=300))
def test_rank_counts_ones(bits):
    ones = Bits(np.array(bits))
    assert ones.rank(np.arange(len(bits) + 1)).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_counts_symbols(symbols):
    w = Wavelet(np.array(symbols), 10)
    for c in range(10):
        at = np.arange(len(symbols) + 1)
        assert w.rank(np.full(len(at), c), at).tolist() == [symbols[:i].count(c) for i in at]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_suffixes_are_in_order(text):
    marked = np.array([*(x + 1 for x in text), 0])
    order = suffix_order(marked, 5, len(marked)).tolist()
    assert order == sorted(range(len(marked)), key=lambda i: marked[i:].tolist())


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(1, 3), min_size=4, max_size=12), min_size=1, max_size=8))
def test_matching_statistics(texts):
    owner = np.array([i * 7 % 5 for i in range(len(texts))])
    index = FmIndex(np.array([w for t in texts for w in t]), np.array([len(t) for t in texts]), owner, 4)
    got = {(int(t), int(p)): int(x) for t, p, x in zip(*index.streamed(), strict=True)}
    want = {(i, p): min(o for o, u in zip(owner, texts, strict=True) for q in range(len(u) - 3) if u[q : q + 4] == t[p : p + 4]) for i, t in enumerate(texts) for p in range(len(t) - 3)}
    assert got == want


def repeats(docs, chunk, shards, frequent):
    """Windows that a smaller id has, by the parts of the operator."""
    messages = defaultdict(list)
    for turn, i in enumerate(range(0, len(docs), chunk)):
        part = docs[i : i + chunk]
        for shard, m in d.dealt([x for x, _ in part], [0] * len(part), [t for _, t in part], shards, frequent, turn):
            messages[shard].append(m)
    import pyarrow as pa

    out = set()
    for shard, ms in messages.items():
        t = d.judged(pa.table({"shard": [shard] * len(ms), "message": ms}))
        for owner, first, n in zip(*(t.column(c).to_pylist() for c in ("owner", "first", "n")), strict=True):
            out |= {(owner, p) for p in range(first, first + n)}
    return out


@pytest.mark.parametrize(("chunk", "shards"), [(1, 1), (3, 5), (100, 2)])
@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("index_words", [4_000_000, 100])
def test_repeats_whatever_the_chunks_and_routes(chunk, shards, hot, index_words, monkeypatch):
    monkeypatch.setattr(d, "INDEX_WORDS", index_words)
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(24):
        w = [rng.choice("abc") for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            w[5:5] = passage[rng.randrange(10) :]
        if i % 5 == 0:
            w += ["same"] * 40
        docs.append((i * 11 % 24, " ".join(w).encode()))
    first = {}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), []).append(i)
    want = {(i, p) for i, t in docs for p in range(len(t.split()) - 12) if min(first[tuple(t.split()[p : p + 13])]) < i}
    frequent = np.unique(np.concatenate([d.Chunk([t], NONE).route for _, t in docs if len(t.split()) > 12])) if hot else NONE
    assert want and repeats(docs, chunk, shards, frequent) == want


def test_messages_grow_little_with_the_shards():
    """Of real documents, as a share of their text: about as much for 6,000 shards as for 24."""
    import duckdb

    texts = [t.encode() for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' LIMIT 3000").fetchall()]
    volume = {shards: sum(len(m) for _, m in d.dealt(list(range(len(texts))), [0] * len(texts), texts, shards, NONE, 0)) / sum(map(len, texts)) for shards in (24, 6000)}
    assert volume[24] < 1.4 and volume[6000] < 1.4 * volume[24], volume


def test_least_of_is_a_sliding_minimum():
    h = np.random.default_rng(0).integers(0, 1000, 50).astype(np.uint64)
    for k in (1, 2, 3, 7, 10):
        assert d.least_of(h, k).tolist() == [h[i : i + k].min() for i in range(len(h) - k + 1)]


def groups(prints):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (int(prints[a]) ^ int(prints[b])).bit_count() <= 2:
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return [find(x) for x in range(len(prints))]


def cluster(n, flips, seed=0):
    rng = np.random.default_rng(seed)
    out = np.full(n, rng.integers(0, 1 << 63), np.uint64)
    for i in range(n):
        for bit in rng.integers(0, 64, rng.integers(0, flips + 1)):
            out[i] ^= np.uint64(1) << np.uint64(bit)
    return np.unique(np.concatenate([out, rng.integers(0, 1 << 63, n // 2).astype(np.uint64)]))


@pytest.mark.parametrize("flips", [2, 4, 7])
@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_groups_of_a_leaf(flips, at_once, monkeypatch):
    monkeypatch.setattr(s, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(s, "AT_ONCE", 50 * at_once)
    prints = cluster(200, flips)
    assert s.grouped(prints, np.ones(len(prints), bool)).tolist() == groups(prints)


def test_tree_lets_every_pair_meet():
    prints = cluster(300, 6, seed=3)
    tree = s.Tree(prints[::2], 12)
    assert tree.leaves > 4
    at_leaf, home = defaultdict(set), {}
    for leaf, at, own in tree.routed(prints):
        for x in at.tolist():
            at_leaf[leaf].add(x)
            if own:
                assert x not in home
                home[x] = leaf
    assert len(home) == len(prints)
    for a in range(len(prints)):
        for b in range(a):
            if (int(prints[a]) ^ int(prints[b])).bit_count() <= 2:
                assert a in at_leaf[home[b]] or b in at_leaf[home[a]]


@pytest.mark.parametrize("most", [200_000, 60])
def test_links_of_crowded_leaves(spark, monkeypatch, most):
    """Leaves of over ``most`` rows get trees of their own, level after level."""
    monkeypatch.setattr(s, "LEAF_MOST", most)
    monkeypatch.setattr(s, "LEAF_ROWS", 200)
    monkeypatch.setattr(s, "SAMPLE_EACH", 10)
    prints = cluster(700, 5, seed=5).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    levels = {r.leaf >> 32 for r in s.leaves(df).select("leaf").distinct().collect()}
    assert len(levels) > 1 or most > 60
    roots = {r.u: r.root for r in components(s.links(spark, df)).collect()}
    got = [roots.get(int(p), int(p)) for p in prints]
    want = groups(prints.view(np.uint64))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_visits_of_two_million_fingerprints():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 2_000_000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 2_000_000).astype(np.uint64)
    tree = s.Tree(prints[: s.SAMPLE_EACH * len(prints) // s.LEAF_ROWS], s.SAMPLE_EACH)
    assert sum(len(at) for _, at, _ in tree.routed(prints)) < 5 * len(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(-5, 200), (7, 7)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {x: 100 for x in range(101, 140)} | {200: -5}


def test_word_hashes_tell_words_apart():
    texts = ["Straße foo  bar\tfoo".encode(), b"", b"foo bar foo bar", b" \n "]
    words = Words(texts)
    h = words.hashes()
    assert [words.buffer[a:b] for a, b in zip(words.start, words.end, strict=True)] == [w for t in texts for w in t.split()]
    assert words.first.tolist() == [0, 4, 4, 8, 8]
    assert h[1] == h[3] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 3
    at, pairs = words.runs(h, 2)
    assert at.tolist() == [0, 1, 2, 4, 5, 6] and pairs[1] == pairs[3] and pairs[2] == pairs[4] == words.runs(h, 2)[1][4]
