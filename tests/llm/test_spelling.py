"""Spelling variants against comparing all words with all."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from attestra.llm import spelling
from attestra.llm.spelling import deletion_keys, spelling_groups


def plain_words(rows) -> dict[str, int]:
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(words: dict[str, int]) -> list[tuple]:
    rows = {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        form, form_n = (others[0][1], -others[0][0]) if others and -others[0][0] >= 10 * n else (None, None)
        rows[w] = [w, form, None, n, len(others), form_n]
    for r in rows.values():
        at = r[0]
        while rows[at][1] is not None:
            at = rows[at][1]
        r[2] = at
    return sorted(map(tuple, rows.values()))


def groups(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling_groups(df).collect())


def misspelt(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["elephant", "Straßenbahn", "aaaaaaaa", "bananana", "éléphantes", "ÿÀ×÷letters", "mississippi"]
    out = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(stems[: rng.choice([1, 2, 7])])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] * 2, "é"]) + w[at + 1 :]
            words.append(rng.choice([w, w.upper(), w + "!"]))
        out.append((i, rng.choice([" ", "1", "\n", "-"]).join(words)))
    return [*out, out[3], (None, out[4][1]), (7, None), (8, "")]


@pytest.mark.parametrize("keys", [1 << 19, 300])
def test_agrees_with_all_pairs(spark, monkeypatch, keys):
    monkeypatch.setattr(spelling, "PARTITION_KEYS", keys)
    rows = misspelt(4)
    want = plain_groups(plain_words(rows))
    assert any(r[1] and r[2] != r[1] for r in want)  # forms that have a form
    assert groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    """With keys of three bits nearly everything meets; strings decide."""
    rows = misspelt(5)[:60]
    honest = deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda words: (*honest(words)[:2], honest(words)[2] & np.uint64(7)))
    words = sorted(plain_words(rows).items())
    tables = list(spelling.keyed(iter([spelling.pa.RecordBatch.from_arrays([spelling.pa.array([w for w, _ in words]), spelling.pa.array([n for _, n in words])], ["word", "n"])]), 0))
    got = spelling.met_words(spelling.pa.Table.from_batches(tables)).to_pylist()
    assert {r["word"]: r["n_near"] for r in got} == {w: sum(near(w, x) for x, _ in words) for w, _ in words}


def test_odd_rows(odd, odd_rows):
    assert groups(odd) == plain_groups(plain_words(odd_rows))


def test_long_words_cost_what_they_are_long(spark):
    a, b = "a" * 30_000, "a" * 29_999 + "b"
    rows = [(i, f"{w} {w}") for i, w in enumerate([a, a, b, b[1:], a[1:], "ab" * 9000, "ab" * 9000])]
    want = plain_words(rows)
    got = {r.word: r.n_near for r in spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    same = lambda x, y: len(x) == len(y) and sum(c != d for c, d in zip(x, y, strict=True)) == 1
    shorter = lambda x, y: len(x) == len(y) + 1 and (i := next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), len(y))) >= 0 and x[i + 1 :] == y[i:]
    assert got == {w: sum(same(w, x) or shorter(w, x) or shorter(x, w) for x in want if x != w) for w in want}


def test_empty(nothing):
    assert spelling_groups(nothing).collect() == []


def test_deletion_keys_are_hashes_of_what_is_left():
    words = ["abcabc", "zzz", "ßé", "abc"]
    which, at, key = deletion_keys(words)
    texts = {}
    for i, p, k in zip(which.tolist(), at.tolist(), key.tolist(), strict=True):
        left = words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]
        assert texts.setdefault(left, k) == k
    assert len(set(texts.values())) == len(texts)
