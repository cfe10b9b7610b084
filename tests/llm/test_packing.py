"""Packing: exact ids, cuts, places; and how many sequences it takes."""

from __future__ import annotations

import random
import struct
from collections import defaultdict
from zlib import crc32

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestra.llm import packing
from attestra.llm.packing import Encoder, best_fit, fewest, packed, packed_digests, packed_documents, searched, sequences, stretches

MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(MODEL)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def checked(rows: list, want: dict, length: int) -> int:
    """rows: of a packed table; want: how often each (doc_id, piece, start, length, ids) is there. Returns the number of sequences."""
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, bytes(r.ids)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in places.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= length
    return len(places)


def pieces_of(rows: list, plain, length: int) -> dict:
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        ids = plain(text)
        for n, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want[doc_id, n, at, len(part), struct.pack(f"<{len(part)}I", *part)] += 1
    return want


@pytest.mark.parametrize(("length", "group"), [(2048, 8192), (64, 7)])
def test_pieces_and_places(odd, odd_rows, plain, monkeypatch, length, group):
    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    want = pieces_of(odd_rows, plain, length)
    n = checked(packed_documents(odd, MODEL, length).collect(), want, length)
    sizes = [k[3] for k, times in want.items() for _ in range(times)]
    assert fewest(sizes, length) <= n <= len(best_fit(sizes, length)) + (group < 100) * len(sizes) / 20


def test_digests_and_sequences(odd, odd_rows, plain):
    whole = packed_documents(odd, MODEL, 128)
    of_ids = sorted((str(r.doc_id), r.piece, r.start, r.length, crc32(bytes(r.ids))) for r in whole.collect())
    assert of_ids == sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed_digests(odd, MODEL, 128).collect())
    texts = defaultdict(list)
    for doc_id, text, *_ in odd_rows:
        texts[doc_id].append(plain(text))
    for s in sequences(whole).collect():
        ids = struct.unpack(f"<{len(s.ids) // 4}I", bytes(s.ids))
        assert len(ids) <= 128 and len(ids) == sum(p.length for p in s.parts)
        for p in s.parts:
            assert any(list(ids[p.offset : p.offset + p.length]) == t[p.start : p.start + p.length] for t in texts[p.doc_id])


def test_empty(nothing):
    assert packed_digests(nothing, MODEL).collect() == []


def test_words_have_the_ids_of_the_whole_text(plain, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "STRETCH", 40)
    encoder = Encoder(open(MODEL).read())
    assert encoder.apart
    signs = ["don't", "I'LL", "<|endoftext|>", "a<|startoftext|>b", "́", "é", "Å", "Σ", "ΑΣ", "İ", " ", "　", "\x85", "\x1c", "\x00", "한글", "한", "12", "'", "''s", "\U0001f600", "word", "Words", "Þß×÷ÿÀ", "ª º", "ñ's", "É!!", "café,", ",.", "-", " ", " ", "\n", "\t\x0b", "\f", "\r\n"]
    for n in [*range(1, 60), 500, 5000]:
        text = "".join(rng.choice(signs) for _ in range(n))
        ids = struct.unpack(f"<{len(x) // 4}I", x) if (x := encoder.encode(text.encode())) else ()
        assert [*ids, 0] == plain(text)
        assert b"".join(stretches(text.encode())) == text.encode()


def test_search_keeps_pieces_and_never_needs_more_bins():
    rng = random.Random(7)
    for kind in range(6):
        for _ in range(15):
            most = rng.choice([20, 100, 2048])
            draw = [lambda m=most: rng.randint(1, m - 1), lambda m=most: rng.randint(m // 4, m // 2), lambda m=most: rng.choice([m // 3, m // 3 + 1, m // 2, m // 7 or 1]), lambda m=most: max(1, m // 3 + rng.randint(-3, 3)), lambda m=most: rng.randint(m // 2 + 1, m - 1), lambda: 1][kind]
            sizes = [draw() for _ in range(rng.randint(1, 150))]
            start = [[s] for s in sizes] if rng.random() < 0.3 else best_fit(sizes, most)
            out = searched(start, most)
            assert sorted(s for b in out for s in b) == sorted(sizes) and all(0 < sum(b) <= most for b in out)
            assert fewest(sizes, most) <= len(out) <= len(start)


def test_exchanges_empty_a_bin_that_best_fit_leaves():
    """Best fit puts 6 with 4 and leaves 3, 3, 3, 3 (12 of 10) in two bins with 5; one bin fewer is possible."""
    found = 0
    for seed in range(200):
        rng = random.Random(seed)
        sizes, left = [], 0
        for _ in range(8):  # eight full bins, cut at random
            cuts = sorted(rng.sample(range(1, 100), rng.choice([2, 3])))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        start = best_fit(sizes, 100)
        out = searched(start, 100)
        found += len(out) < len(start)
        assert len(out) >= 8
    assert found > 5


def test_bins_that_are_not_full_meet_again(spark, monkeypatch):
    """Groups of about twelve pieces leave bins that only other groups can fill."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 12)
    rng = random.Random(1)
    sizes = [rng.choice([10, 30, 55, 60, 70]) for _ in range(600)]
    rows = packed(spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "id long, length long, fill string"), 100).collect()
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(sizes)) and {r.fill for r in rows} == {"x"}
    alone = sum(len(searched(best_fit(sizes[i : i + 12], 100), 100)) for i in range(0, 600, 12))
    assert fewest(sizes, 100) <= len({r.sequence_id for r in rows}) < alone
