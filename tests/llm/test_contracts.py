"""Operators against brute force on rows with nulls, ties, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from attestra.llm.decontamination import contaminated, without_benchmark
from attestra.llm.exact_dedup import exact_duplicates, without_copies
from attestra.llm.line_dedup import without_boilerplate
from attestra.llm.mixing import mix_counts, mixed_documents
from attestra.llm.sharding import shard_by_splitters
from attestra.llm.simhash import near_duplicates, without_near_copies
from attestra.llm.substring_dedup import without_repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def words(text):
    return WORD.findall((text or "").encode())


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(odd, odd_rows):
    groups = defaultdict(list)
    digest = lambda t: hashlib.sha256(ascii_lower(t or "").encode()).hexdigest()
    for i, t, *_ in odd_rows:
        groups[digest(t)].append(i)
    want = []
    for i, t, *_ in odd_rows:
        group = groups[digest(t)]
        keep = max((x for x in group if x is not None), default=None)
        want.append((i, keep, len(group), i == keep, digest(t)))
    assert as_rows(exact_duplicates(odd)) == sorted(want, key=repr)
    left = without_copies(odd)
    assert left.columns == odd.columns
    ids = {d: max((x for x in group if x is not None), default=None) for d, group in groups.items()}
    assert sorted((digest(r.text), str(r.doc_id)) for r in left.collect()) == sorted((d, str(i)) for d, i in ids.items())


def test_substring_dedup(odd, odd_rows):
    first = {}
    for i, t, *_ in odd_rows:
        w = words(t)
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    want = []
    for i, t, *_ in odd_rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < (LAST if i is None else i):
                gone |= set(range(p, p + 13))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    assert as_rows(without_repeats(odd).drop("text")) == sorted(want, key=repr)


def test_substring_dedup_with_small_chunks_and_frequent_hashes(odd, odd_rows, spark, monkeypatch):
    """Whole chunks, runs and routes take part in no result."""
    from attestra.llm import substring_dedup as s

    want = as_rows(without_repeats(odd))
    monkeypatch.setattr(s, "frequent_routes", lambda docs: __import__("numpy").arange(0, dtype="uint64"))
    monkeypatch.setattr(s, "SHARD_BYTES", 100_000)
    assert as_rows(without_repeats(odd)) == want


def brute_fingerprint(text):
    w = [x.lower() for x in words(text)]
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k, n in ones.items() if 2 * n > len(shingles))


def brute_components(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            least[find(x)] = min(least.get(find(x), LAST), i)
    return [(i, f"{f:016x}", least.get(find(x))) for x, (i, f) in enumerate(prints)]


def test_simhash(odd, odd_rows):
    want = brute_components([(i, t) for i, t, *_ in odd_rows])
    assert as_rows(near_duplicates(odd)) == sorted(want, key=repr)
    left = without_near_copies(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({str(c) for _, _, c in want})


def test_one_row_of_each_group_whatever_ids_repeat(spark):
    """Rows are told apart by id and text: an id that stays elsewhere doesn't keep a copy, and a repeated row stays once."""
    rows = [(1, "a b c d e"), (3, "completely other words that nothing else has in it"), (3, "a b c d e"), (None, "x y z"), (None, "x y z"), (7, "u v w"), (7, "u v w"), (None, "u v w")]
    left = without_near_copies(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, key int, th string"))
    assert as_rows(left) == sorted([(1, "a b c d e", 1, "k"), (3, rows[1][1], 1, "k"), (None, "x y z", 1, "k"), (7, "u v w", 1, "k")], key=repr)


def brute_shingles(text):
    w = re.sub(rb"[\x00-/:-@\[-`{-\x7f]+", b" ", ascii_lower(text).encode()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set(), w


def test_decontamination(odd, odd_rows, spark):
    passage = " ".join(f"P{i}" for i in range(60))
    texts = [passage, " ".join(passage.split()[:49] + ["other"] * 11), " ".join(passage.split()[:40] + ["zz"] * 20), "three words", "", None, "q1", passage, "!!", "日本語、の 文章"]
    items = list(enumerate(texts))
    want = []
    for d, t, *_ in odd_rows:
        for i, x in items:
            own, w = brute_shingles(x or "")
            if t is not None and own:
                k = len(next(iter(own)))
                theirs = brute_shingles(t)[1]
                grams = {tuple(theirs[p : p + k]) for p in range(len(theirs) - k + 1)}
                shared = len(own & grams)
                if 5 * shared >= 4 * len(own):
                    want.append((d, i, len(own), shared, shared / len(own)))
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    assert len({i for _, i, *_ in want}) >= 4
    assert as_rows(contaminated(odd, bench)) == sorted(want, key=repr)
    hit = {x[0] for x in want if x[0] is not None}
    assert sorted(r.doc_id for r in without_benchmark(odd, bench).where("doc_id IS NOT NULL").collect()) == sorted(i for i, *_ in odd_rows if i is not None and i not in hit)
    assert contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(odd, spark, monkeypatch):
    from attestra.llm import decontamination as d

    bench = spark.createDataFrame([(i, " ".join(f"p{x}" for x in range(i, i + 30))) for i in range(20)], "item_id long, text string")
    want = as_rows(contaminated(odd, bench))
    left = as_rows(without_benchmark(odd, bench))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert as_rows(contaminated(odd, bench)) == want
    assert as_rows(without_benchmark(odd, bench)) == left


def test_line_dedup_in_blocks(spark, monkeypatch):
    from attestra.llm import line_dedup as ld

    docs = spark.createDataFrame([(i, f"head {i % 3}\nown {i}\nfoot {i % 2}", f"site{i}") for i in range(40)], "doc_id long, text string, source string")
    want = as_rows(without_boilerplate(docs, 5))
    assert {r[3] for r in want} == {f"own {i}" for i in range(40)}
    monkeypatch.setattr(ld, "BLOCK_LINES", 2)
    assert as_rows(without_boilerplate(docs, 5)) == want


def test_sharding(odd, odd_rows):
    got = shard_by_splitters(odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(40))


def test_shards_are_even_and_groups_stay_together(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7)) for i in range(6000)] + [(10_000 + i, f"group {i % 500}") for i in range(2000)] + [(20_000 + i, "one hot text " * 3) for i in range(4000)]
    got = shard_by_splitters(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=16).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(n / mean - 1) < 0.06 for n in sizes.values())
    shards = defaultdict(set)
    text = dict(rows)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert len(shards["one hot text " * 3]) > 3
    assert all(len(s) == 1 for t, s in shards.items() if not t.startswith("one hot"))


def test_large_groups_stay_whole(spark):
    """Groups of equal texts of 0.05 to 1 shard, none split; shards even within the stated tolerance; the rest fills up what they leave."""
    shards, part = 16, 40_000
    parts = [1.0] * 2 + [0.9] * 2 + [0.6] * 3 + [0.5] * 4 + [0.3] * 5 + [0.1] * 8 + [0.05] * 16
    rows, at = [], 0
    for g, x in enumerate(parts):
        for _ in range(round(x * part / 100)):
            rows.append((at, f"group {g} ".ljust(84, "x")))
            at += 1
    rest = (shards * part - 100 * len(rows)) // 50
    rows += [(at + i, f"single {i} ".ljust(34, "y")) for i in range(rest)]
    got = shard_by_splitters(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=shards).collect()
    sizes, where, text = Counter(), defaultdict(set), dict(rows)
    for r in got:
        sizes[r.shard] += r.size
        where[text[r.doc_id]].add(r.shard)
    assert len(got) == len(rows) and all(len(x) == 1 for x in where.values())
    assert len(sizes) == shards and all(abs(n / part - 1) < 0.07 for n in sizes.values()), sizes


def test_packing_cuts_only_what_no_shard_can_hold():
    from attestra.llm.sharding import packed

    pieces, load = packed([(1, 250), (2, 60), (3, 60), (4, 25)], 4, 100.0)
    assert sum(load) == 395 and max(load) <= 105
    assert [p[0] for p in pieces].count(1) == 3 and {h: n for h, n in Counter(p[0] for p in pieces).items() if h in (2, 4)} == {2: 1, 4: 1}


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        over = {s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / max(1, sum(weight[x] for x in left)) for s in left}
        target |= {s: 3 * sizes[s] for s in over}
        left -= over


def test_mixing(odd, odd_rows):
    sizes = Counter()
    for _, t, _, s, _ in odd_rows:
        sizes[s] += len(words(t))
    targets = brute_targets(sizes)
    got = mix_counts(odd, block_words=16).collect()
    again = mix_counts(odd.repartition(3), block_words=16).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, *_ in odd_rows)
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    by = {(r.source_size, round(r.target, 6)): 0 for r in got}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size, round(r.target, 6)] += r.taken
    assert set(by) == {(sizes[s], round(targets[s], 6)) for s in sizes}
    assert all(abs(n - t) <= 32 for (_, t), n in by.items())


def test_mixed_documents_hold_what_is_counted(odd):
    counts, texts = Counter(), Counter()
    for r in mix_counts(odd, block_words=16).collect():
        counts[r.doc_id] += r.taken
    mixed = mixed_documents(odd, block_words=16)
    assert mixed.columns == odd.columns
    original = defaultdict(set)
    for r in odd.collect():
        original[r.doc_id].add(r.text)
    whole = 0
    for r in mixed.collect():
        texts[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        whole += r.text in original[r.doc_id]
        assert set(words(r.text)) <= {w for t in original[r.doc_id] for w in words(t)}
    assert +counts == +texts and whole


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97])
def test_permutations_hit_every_index(spark, n):
    from pyspark.sql import functions as F

    from attestra.llm.mixing import permuted

    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("a"), permuted(F.col("id"), F.lit(n).cast("long"), F.lit(2)).alias("b")).collect()
    assert sorted(r.a for r in df) == sorted(r.b for r in df) == list(range(n))
    assert n < 10 or [r.a for r in df] != [r.b for r in df]


def test_targets_of_many_sources(spark, monkeypatch):
    """Levels and places agree with sharing anew source by source, also where sources are numbered by several tasks."""
    import random

    from attestra.llm import mixing as m

    monkeypatch.setattr(m, "SOURCE_CHUNK", 7)
    rng = random.Random(9)
    sizes = {s: rng.choice([0, 1, 5, 40, 300, 9000]) for s in [None, "", "ß", "Z", "a", *(f"s{i}" for i in range(40))]}
    got = m.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert {r.source: r.sid for r in got} == {s: i for i, s in enumerate(order)}
    assert {r.source: pytest.approx(r.target) for r in got} == brute_targets(sizes)


def test_source_counts_of_shards_are_multinomial_given_their_sum(spark):
    """Mean and variance over 80 seeds of what the permutation gives a shard of each source; the same without the condition is a multinomial draw."""
    from statistics import mean, variance

    from pyspark.sql import functions as F

    from attestra.llm.mixing import permuted

    counts, shard, seeds = {0: 300, 1: 900, 2: 60}, 400, 80
    n = sum(counts.values())
    rows = spark.range(n).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("sid", F.when(F.col("id") < 300, 0).when(F.col("id") < 1200, 1).otherwise(2))
    found = rows.where(permuted(F.col("id"), F.lit(n).cast("long"), F.col("seed")) < shard).groupBy("seed", "sid").count().collect()
    for sid, size in counts.items():
        drawn = [r["count"] for r in found if r.sid == sid]
        want, spread = shard * size / n, shard * size / n * (1 - size / n) * (n - shard) / (n - 1)
        assert len(drawn) == seeds and abs(mean(drawn) - want) < 4 * (spread / seeds) ** 0.5
        assert 0.6 < variance(drawn) / spread < 1.6


def test_taken_agrees_with_blocks_counted_one_by_one(odd, odd_rows):
    """taken, from the slots: each block's words, as often as it is drawn; passes before the last draw every block once."""
    from attestra.llm.mixing import Mix

    mix = Mix(odd, block_words=16)
    drawn = defaultdict(Counter)
    for r in mix.slots().collect():
        drawn[r.sid][r.block] += 1
    for r in mix.sources.collect():
        times = sorted(drawn[r.sid].values())
        assert sum(times) == r.n_slots and (not times or times[-1] - (times[0] if len(times) == r.n_blocks else 0) <= 1)
    want, rest = Counter(), {r.rid: r for r in mix.rows.collect()}
    for r in mix.streamed.collect():
        want[r.rid] = sum(drawn[r.sid][p // 16] for p in range(r.start, r.start + r.size))
    got = Counter((r.doc_id, r.size, r.taken) for r in mix_counts(odd, block_words=16).collect())
    assert got == Counter((r.doc_id, r.size, want[i]) for i, r in rest.items())


def test_line_dedup(odd, odd_rows, spark):
    rows = [(1000 + i, f"own {i}\n  boiler plate \t\nrare line\r\n\n" if i < 9 else f"boiler plate\n{'rare line' if i == 9 else ''}", "en", f"site{i // 2 if i < 12 else i}", 0) for i in range(30)]
    rows += [*odd_rows, (5000, "boiler plate", None, None, 0), (5001, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r"):
                sites[line.strip(" \t\r")].add(s)
    for least in (3, 5):
        want = []
        for i, t, _, _, _ in rows:
            own = t.split("\n") if t is not None else []
            left = [x for x in own if len(sites[x.strip(" \t\r")]) < least]
            want.append((i, len(own), len(own) - len(left), "\n".join(left) if t is not None else None))
        assert any(x[2] for x in want)
        assert as_rows(without_boilerplate(docs, least)) == sorted(want, key=repr)


def test_empty_tables(nothing, spark):
    from attestra.llm.language import in_known_language, predicted_languages
    from attestra.llm.quality import resampled
    from attestra.llm.url_filter import judged_urls

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for f in (exact_duplicates, without_repeats, near_duplicates, shard_by_splitters, mix_counts, mixed_documents, without_boilerplate, predicted_languages, in_known_language, without_near_copies, without_copies):
        assert f(nothing).count() == 0, f
    assert contaminated(nothing, bench).count() == resampled(nothing, labels).count() == judged_urls(pages).count() == 0


def test_misra_gries_keeps_heavy_digests():
    from attestra.llm.exact_dedup import summarized

    counts = Counter({bytes([i]): 1 for i in range(100)}) + Counter({b"hot": 60, b"warm": 30})
    left = summarized(dict(counts), 10)
    assert set(left) == {b"hot", b"warm"} and left[b"hot"] == 59


def test_heavy_digest_is_settled_without_shuffle(spark):
    rows = [(i, "HOT" if i % 3 else f"cold {i}") for i in range(3000)]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 1001
    assert got.where("group_size = 2000").select("keep_id").distinct().collect()[0][0] == 2999


def test_ratio_of_gumbel_sample(spark):
    from attestra.llm.quality import resampled

    rows = [(i, ("good clean prose here " if i % 2 else "$$$ !!! ### spam ") * 20) for i in range(400)] + [(None, None), (1000, ""), (7, "good")]
    labels = [(i, i % 2, 0) for i in range(0, 100)] + [(None, 1, 0), (3, None, None)]
    got = resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep=0.5).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == math.ceil(len(rows) * 0.5)
    assert sum(r.kept for r in got if r.doc_id and r.doc_id % 2 and r.doc_id < 400) >= 199
    assert next(r for r in got if r.doc_id is None).log_weight == 0


def test_kth_largest(spark):
    from attestra.llm.quality import kth_largest

    values = [float(x) for x in [5, 5, 5, -3, 1e-300, 1e300, 0, 7]] + [1 / (i + 1) for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 3, 4, 6, 30, len(values)):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    close = [1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 1.0, math.nextafter(math.nextafter(1.0, 0), 0)]
    df = spark.createDataFrame([(v,) for v in close], "x double")
    for k in range(1, 6):
        assert kth_largest(df, "x", k) == sorted(close, reverse=True)[k - 1]
    assert kth_largest(df, "x", 0) == kth_largest(df.limit(0), "x", 3) == math.inf
