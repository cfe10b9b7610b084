"""Long and foreign names, crowded leaves, nearly heavy digests, odd column names."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import simhash as s
from attestra.llm import url_filter as u
from attestra.llm.common import rows_with_text
from attestra.llm.decontamination import without_benchmark
from attestra.llm.exact_dedup import HEAVY_SHARE, exact_duplicates
from attestra.llm.language import in_known_language
from attestra.llm.line_dedup import without_boilerplate
from attestra.llm.mixing import mixed_documents
from attestra.llm.near_copies import without_similar


def test_a_very_long_path_among_words_of_many_lengths(spark):
    """60,000 letters and words of 1 to 399 of them: rows and time stay small."""
    rng = np.random.default_rng(4)
    letters = "".join(chr(97 + x) for x in rng.integers(0, 26, 60_000))
    words = " ".join(letters[i * 100 : i * 100 + i] for i in range(1, 400))
    rows = [(0, f"http://x.example.com/{letters}", words), (1, "http://poker.example.com/a", ""), (2, "http://x.example.com/" + "a" * 5000, "a aa aaa")]
    began = time.perf_counter()
    got = {r.page_id: r.verdict for r in u.judged_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.keys() == {0, 1, 2} and time.perf_counter() - began < 60


def test_names_are_cut_as_before():
    """Substrings that are words are all found, and no name is sent with them."""
    texts = ["cheappills", "ÜberCasino".lower(), "x" * 9, "", "日本語"]
    windows = u.Windows(texts)
    for k in (1, 2, 5, 9, 40):
        which, key = windows.of(k)
        own = [(i, t[j : j + k]) for i, t in enumerate(texts) for j in range(len(t) - k + 1)]
        assert which.tolist() == [i for i, _ in own]
        assert len({x for _, x in own}) == len(set(key.tolist())) and all((a[1] == b[1]) == (p == q) for a, p in zip(own, key.tolist(), strict=True) for b, q in zip(own, key.tolist(), strict=True))


def test_bitmap_has_every_word(spark):
    words = [f"w{i}" for i in range(5000)] + ["ß", "日本"]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long").mapInArrow(u.hashed, "word string, n long, hash long")
    bits = u.word_filter(table)
    keys = np.array([r.hash for r in table.collect()]).view(np.uint64) >> np.uint64(64 - u.FILTER_BITS)
    assert all(bits[int(k) >> 3] >> (int(k) & 7) & 1 for k in keys) and int(np.bitwise_count(bits).sum()) == len(set(keys.tolist()))


@pytest.mark.parametrize(
    ("host", "path", "own"),
    [
        ("casinobücher.de", "/", ["h:casinobücher", "h:de"]),
        ("xn--bcher-kva.example", "", ["h:bücher", "h:example"]),
        ("xn--\udcff.com", "", None),
        ("ÉTÉ.fr", "/caf%C3%A9/M%C3%9CNCHEN/%zz/12", ["h:été", "h:fr", "p:café", "p:münchen", "p:zz", "p:0"]),
        ("", "", []),
    ],
)
def test_words_of_names_in_any_script(host, path, own):
    assert own is None or u.names(host, path) == own


def test_foreign_vocabulary_splits_foreign_names(spark):
    rows = [(i, f"http://casino-gewinn{i}.example.com/", "bücher casino Bücher gewinn") for i in range(30)] + [(100 + i, f"http://bücher{i}.example.com/x", "") for i in range(30)]
    got = {r.page_id: r.verdict for r in u.judged_urls(spark.createDataFrame([*rows, (900, "http://casinobücher.example.com/", "")], "page_id long, url string, html string")).collect()}
    assert all(got[i] == "block" for i in range(30)) and all(got[100 + i] == "allow" for i in range(30)) and got[900] == "block"


def crowd(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64))


@pytest.mark.parametrize("sample_most", [1 << 18, 600])
def test_no_leaf_stays_crowded(spark, monkeypatch, sample_most):
    """However small the samples that trees are built from at once, every crowded leaf gets a tree that thins it out."""
    monkeypatch.setattr(s, "LEAF_MOST", 3000)
    monkeypatch.setattr(s, "LEAF_ROWS", 1000)
    monkeypatch.setattr(s, "SAMPLE_MOST", sample_most)
    prints = crowd(1, 40_000)
    placed = s.leaves(spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")).groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).collect()
    assert max(r.n for r in placed) <= 3000 and sum(r.own for r in placed) == len(prints)


def test_visitors_stay_visitors(spark, monkeypatch):
    """A fingerprint is at home once, however many levels its leaf goes through, and linked ones meet."""
    monkeypatch.setattr(s, "LEAF_MOST", 400)
    monkeypatch.setattr(s, "LEAF_ROWS", 200)
    prints = crowd(2, 3000)
    near = prints[:500] ^ (np.uint64(1) << np.arange(500, dtype=np.uint64) % np.uint64(64))
    every = np.unique(np.concatenate([prints, near]))
    df = spark.createDataFrame([(int(p),) for p in every.view(np.int64)], "fp long")
    rows = s.leaves(df).collect()
    assert len({r.leaf >> 32 for r in rows}) > 1 and sum(r.own for r in rows) == len(every)
    where, home = {}, {}
    for r in rows:
        where.setdefault(r.leaf, set()).add(r.fp)
        if r.own:
            home[r.fp] = r.leaf
    for a, b in zip(prints[:500].view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True):
        assert a in where[home[b]] or b in where[home[a]]


def test_nearly_heavy_digest_can_be_split(spark):
    """A digest just under the share of heavy ones: its rows meet a written aggregate, so no aggregate stands between exchange and join."""
    n = 6000
    same = int(n * HEAVY_SHARE * 0.85)
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < same, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_duplicates(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = plan.split("SortMergeJoin")[1] if "SortMergeJoin" in plan else plan
    assert "HashAggregate" not in joins and "light-groups" in plan
    assert out.where(f"text_sha256 = sha2('same', 256) AND keep_id = {same - 1} AND group_size = {same}").count() == same


def test_stages_keep_columns_with_any_name(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the hunter in the dark wood"
    rows = [(i, f"{text} {i}", "en", "s1", 90, i, "x`y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` string")
    bench = spark.createDataFrame([(1, f"{text} 7")], "item_id long, text string")
    for out in (in_known_language(docs), without_benchmark(docs, bench), without_similar(docs), mixed_documents(docs), rows_with_text(docs, lambda t: [True] * len(t))):
        assert out.columns == docs.columns
        assert all(r[6] == "x`y" and r[5] == r.doc_id for r in out.collect())


def test_null_text_has_no_lines_whatever_the_session(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            got = without_boilerplate(spark.createDataFrame([(1, None, "s"), (2, "a\nb", "s"), (3, "", None)], "doc_id long, text string, source string")).collect()
            assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == [(1, 0, 0, None), (2, 2, 0, "a\nb"), (3, 1, 0, "")]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
