"""The language stage against texts in no language that it learned."""

from __future__ import annotations

import base64
import random

from attestra.llm.language import in_known_language
from tests.conftest import DATA


def test_foreign_texts_and_gibberish_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{DATA.parent}/sf0.01/documents.parquet")
    rng = random.Random(4)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "".join(map(chr, range(0x430, 0x450))) + "   ", "".join(map(chr, range(0xAC00, 0xB000))) + " " * 200]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (100, 300, 2000) for _ in range(5)]
    texts += [base64.b64encode(rng.randbytes(n)).decode() for n in (100, 1000)]
    foreign = spark.createDataFrame([(10**6 + 2, t, None, "s", len(t)) for t in texts], docs.schema)
    left = in_known_language(docs.union(foreign))
    assert left.where("doc_id < 1000000").count() == docs.where("text rlike '\\\\p{L}'").count()
    assert left.where("doc_id >= 1000000").count() == 0


def test_a_language_that_few_rows_have_is_known(spark):
    """Of 120,000 labelled rows, eight are in another language: all of its texts stay, held out or not, and what is in no language still goes."""
    rng = random.Random(7)
    rare = "старий будинок стояв біля річки де росли високі дерева та співали птахи кожного ранку коли сонце сходило над полями".split()
    common = spark.range(120_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> element_at(array('the', 'old', 'house', 'stood', 'near', 'river', 'where', 'tall', 'trees', 'were', 'growing', 'every', 'morning'), cast(1 + pmod(hash(id, i), 13) AS int)))) AS text", "'en' AS lang")
    few = spark.createDataFrame([(200_000 + i, " ".join(rng.sample(rare, 12)), "uk") for i in range(12)], "doc_id long, text string, lang string")
    junk = spark.createDataFrame([(300_000 + i, "".join(chr(rng.randrange(0xAC00, 0xB000)) for _ in range(200)), None) for i in range(5)], "doc_id long, text string, lang string")
    left = in_known_language(common.union(few).union(junk)).selectExpr("div(doc_id, 100000) AS kind").groupBy("kind").count().collect()
    assert sum(r["count"] for r in left if r.kind < 2) == 120_000 and {r.kind: r["count"] for r in left if r.kind >= 2} == {2: 12}
