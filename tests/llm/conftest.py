from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, h double, rid int, owner string, key string, n int, kept_text string, range string, order string, digest int"


def words(rng: random.Random, n: int) -> str:
    """n words from a small vocabulary, so that sequences repeat here and there."""
    return "".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "Über", "eps.", "zeta"]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies in groups of two to many, near copies, shared passages, repeated rows, odd blanks and characters."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts: list[str | None] = [None, None, "", "", " \t\n", "one", "One", "two words", "three words now", "ÉCOLE straße ĲSSEL", "a\x0bb\x0cc d e", "日本語 の 文章 です", "123 456 !!", "\U0001f600 x"]
    texts += [words(rng, n) for n in (3, 12, 13, 14, 40, 200, 900)]
    texts.append(" ".join(f"w{rng.randrange(40_000)}" for _ in range(60_000)))
    base = " ".join(f"q{rng.randrange(5000)}" for _ in range(400))
    texts += [base, base, base + " end", base.replace("q1", "Q1"), base.upper(), " ".join(base.split()[:-3])]
    texts += [f"{words(rng, 5)} {passage} {words(rng, 7)}" for _ in range(4)]
    texts += ["same old text " * 6] * 25
    texts += [passage + " " + passage]
    ids = [*range(100, 100 + len(texts))]
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "ß", "", None]), len(t) if t else 0) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[5], rows[5], (None, "no id here", "en", "s1", 10), (None, base, None, None, 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As documents, with columns whose names clash with those that operators use inside."""
    more = (1, "x", 0.5, 2, "o", "k", 3, "kept", "r", "ord", 4)
    return spark.createDataFrame([(*r, *more) for r in odd_rows], DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
