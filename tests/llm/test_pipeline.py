"""The pipeline, and all queries against their SQL."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as p
from attestra.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

from .test_contracts import as_rows, brute_shingles, words
from .test_near_copies import brute_groups


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_returns_rows(name, spark):
    df = QUERIES[name](spark, str(DATA))
    table = {"op9_url_filter": "pages", "op12_clustering": "embeddings"}.get(name, "documents")
    if name in ("op11_spelling_variants", "op13_packing"):  # a row for each word, or piece
        df = df.select("word" if name == "op11_spelling_variants" else "doc_id").distinct()
        assert df.count() >= spark.read.parquet(f"{DATA}/{table}.parquet").count()
    elif name != "op1_decontamination":
        assert df.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_stages_on_odd_rows(spark, odd, odd_rows, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in p.STAGES:
        before = docs.collect()
        after = stage(spark, docs, str(tmp_path))
        rows = after.collect()
        if name != "sharding":
            assert after.columns == odd.columns
        if name == "language_id":
            assert {r.text for r in rows} == {r.text for r in before if r.text and any(c.isalpha() for c in r.text)}
        if name == "simhash_dedup":
            order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(order[i].doc_id) for i in set(brute_groups([r.text for r in order])))
        if name == "decontamination":
            own, _ = brute_shingles(passage)
            clean = [r for r in before if len(own & brute_shingles(r.text)[0]) < 0.8 * len(own)]
            assert len(clean) < len(before) and Counter(r.text for r in rows) == Counter(r.text for r in clean)
        if name == "mixing":
            total, mixed = (sum(len(words(r.text)) for r in x) for x in (before, rows))
            assert abs(mixed / total - 1) < 0.05
        if name == "sharding":
            assert len(rows) == len(before) and {r.law for r in rows} == {"bytes"}
        docs = spark.createDataFrame(rows, after.schema)


def test_run(spark):
    assert [n for n, _ in p.STAGES] == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]
    first, again = (as_rows(p.run(spark, str(DATA)).select("doc_id", "size", "text_crc32")) for _ in range(2))
    assert first and first == again


def test_run_over_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
