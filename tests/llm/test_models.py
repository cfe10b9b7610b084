"""Language identification, quality selection and url filtering: held-out accuracy, edge cases, plain versions of what they compute."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from attestra.llm import url_filter as u
from attestra.llm.language import BUCKETS, GRAMS, SMOOTHING, LanguageModel, gram_buckets, in_known_language, predicted_languages
from attestra.llm.quality import grams, resampled
from tests.conftest import DATA

SF = DATA.parent / "sf0.01"


def plain_buckets(text: str) -> Counter:
    padded = " " + text.lower().replace("\n", " ") + " "
    out = Counter()
    for n in GRAMS:
        for i in range(len(padded) - n + 1):
            h = n
            for ch in padded[i : i + n]:
                h = ((h ^ ord(ch)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out[h % BUCKETS] += 1
    return out


def test_language_agrees_with_plain_naive_bayes(odd, odd_rows, monkeypatch):
    from attestra.llm import language

    counts = {}
    for i, t, lang, *_ in odd_rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 4 != 2 and t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_buckets(t))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + SMOOTHING * BUCKETS for x in langs}
    want = {}
    for i, t, *_ in odd_rows:
        if not t or not any(ch.isalpha() for ch in t):
            want[i, t] = ("und", 0.0)
            continue
        logs = {x: sum(n * math.log((counts[x][b] + SMOOTHING) / total[x]) for b, n in plain_buckets(t).items()) for x in langs}
        best = max(langs, key=lambda x: logs[x])
        want[i, t] = (best, 1 / sum(math.exp(logs[x] - logs[best]) for x in langs))
    for at_once in (1 << 18, 60):  # rows with equal ids, or none, among them; texts whole and in pieces
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        got = sorted(((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in predicted_languages(odd).collect()), key=repr)
        wanted = sorted(((str(i), zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2, *want[i, t]) for i, t, *_ in odd_rows), key=repr)
        assert [x[:3] for x in got] == [x[:3] for x in wanted]
        assert [x[3] for x in got] == pytest.approx([x[3] for x in wanted], abs=1e-6)


def test_many_languages_are_taken_in_blocks(spark, monkeypatch):
    """With ten times more languages than a broadcast may hold, each has all buckets, and results are those of one block."""
    from attestra.llm import language

    rows = [(i, f"{chr(97 + i % 26) * 2}{chr(98 + i % 25)} " * 9, f"l{i % 26}") for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in predicted_languages(docs).collect())
    whole, clean = told(), sorted(in_known_language(docs).collect())
    monkeypatch.setattr(language, "MATRIX_CELLS", 3 << 15)
    model = language.train(docs)
    assert len(model.langs) == 26 and [m.logs.shape for m in model.blocks()] == [(3, BUCKETS + 1)] * 8 + [(2, BUCKETS + 1)]
    assert sum(model.judged(t)[0] == x for _, t, x in rows) > 230
    assert told() == whole and sorted(in_known_language(docs).collect()) == clean


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = predicted_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_pieces_of_long_texts_lose_no_gram(monkeypatch):
    from attestra.llm import language

    text = "".join(chr(97 + i * 7 % 26) for i in range(1000))
    whole = Counter(itertools.chain.from_iterable(h.tolist() for h in gram_buckets(text)))
    assert whole == plain_buckets(text)
    monkeypatch.setattr(language, "AT_ONCE", 100)
    pieces = Counter(itertools.chain.from_iterable(h.tolist() for h in gram_buckets(text)))
    assert pieces == whole


def test_model_without_languages():
    assert LanguageModel([], np.zeros((0, BUCKETS))).judged("text") == ("und", 0.0)


def test_known_language_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 !!", "en", "s", 6), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    left = in_known_language(docs.union(junk))
    assert left.columns == docs.columns
    assert left.exceptAll(docs).count() == 0 and left.count() >= 0.99 * docs.count()


def test_quality_agrees_with_plain_models(spark):
    from attestra.llm import quality as q

    docs = [(i, f"w{i % 5} w{i % 3} Same\ttext {'x ' * (i % 4)}") for i in range(40)] + [(99, None), (98, "")]
    labels = [(i, int(i % 3 == 0), int(i == 9)) for i in range(30)]
    raw, target = np.zeros(1 << q.LG_BUCKETS), np.zeros(1 << q.LG_BUCKETS)
    good = {i for i, a, b in labels if a and not b}
    for i, t in docs:
        bucket, _ = grams([(t or "").encode()])
        np.add.at(raw, bucket, 1)
        if i in good:
            np.add.at(target, bucket, 1)
    ratio = np.log((target + q.SMOOTHING) / (raw / raw.sum() * target.sum() + q.SMOOTHING))
    want = {i: ratio[grams([(t or "").encode()])[0]].sum() for i, t in docs}
    got = resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.doc_id: pytest.approx(r.log_weight) for r in got.collect()} == want


def test_quality_takes_the_top_of_gumbel_noise(spark):
    """Kept rows are the k largest of weight and noise; the noise follows Gumbel's law; long texts, clashing names and repeated null ids are rows like any other."""
    rows = [(i, f"w{i % 50} v{i % 7}", 1.0, "k") for i in range(4000)] + [(None, "x " * 200_000, 1.0, "k"), (None, "x y", 1.0, "k"), (None, None, 1.0, "k"), (7, "", 1.0, "k")]
    labels = [(i, i % 3 == 0, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, perturbed double, kept string")
    got = resampled(docs, spark.createDataFrame([(i, int(a), b) for i, a, b in labels], "doc_id long, quality int, toxic int"), keep=0.3).collect()
    order = sorted((r.perturbed for r in got), reverse=True)
    k = math.ceil(0.3 * len(rows))
    assert len(got) == len(rows) and {r.perturbed for r in got if r.kept} == set(order[:k]) and sum(r.kept for r in got) >= k
    noise = np.array([r.perturbed - r.log_weight for r in got if r.doc_id is not None and r.doc_id != 7])
    assert abs(noise.mean() - 0.5772) < 0.08 and abs(noise.var() - math.pi**2 / 6) < 0.25
    share = np.mean(noise < 1.0)
    assert abs(share - math.exp(-math.exp(-1.0))) < 0.03


def test_quality_prefers_labelled_good(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.quality: r.share for r in resampled(docs, labels).join(labels, "doc_id").selectExpr("quality", "cast(kept as int) k").groupBy("quality").agg({"k": "avg"}).withColumnRenamed("avg(k)", "share").collect()}
    assert kept[1] > 0.92 and kept[0] < 0.5, kept


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (None, "", ""),
        ("", "", ""),
        ("no scheme/path", "", ""),
        ("http://A.Net", "a.net", ""),
        ("HTTP://a.net?x=/y", "a.net", ""),
        ("x://ÄB.org/P/Q#f?g", "Äb.org", "/P/Q"),
        ("http://a://b/c", "a:", "//b/c"),
        ("://", "", ""),
        ("http://u@h:80/p?q#r", "u@h:80", "/p"),
    ],
)
def test_parts_of_urls(url, host, path):
    assert u.split_url(url) == (host, path)


@pytest.mark.parametrize(
    ("host", "path", "rule"),
    [
        ("net", "/", "net/"),
        ("a.net", "/x", "net/"),
        ("anet", "/x", None),
        ("a.net", "", None),
        ("example.net", "/en/1", "example.net/en/"),
        ("m.example.net", "/en/", "example.net/en/"),
        ("example.net", "/en", "net/"),
        ("myexample.net", "/en/", "net/"),
        ("a.example.com", "/de/1", "example.com/de/"),
        ("example.com", "/fr/1", None),
        ("x.org", "/fr/", "org/fr/"),
        ("x.org", "/FR/", None),
        ("", "", None),
    ],
)
def test_longest_rule(host, path, rule):
    found = u.ruled(host, path)
    assert (found and found[1]) == rule


def test_viterbi_finds_the_likeliest_split():
    counts = {"cheap": 50, "pill": 5, "pills": 30, "the": 400, "there": 40, "fore": 2, "therefore": 1, "a": 300, "win": 20}
    s = u.Segmenter(counts)
    assert s.words("cheappills") == ["cheap", "pills"] and s.words("casinowin") == ["casino", "win"]
    assert s.words("qqq") == ["qqq"] and s.words("") == [] and "".join(s.words("thereforeqqpillsa")) == "thereforeqqpillsa"

    def cost(parts):
        return sum(s.logs[p] if p in s.logs else u.UNKNOWN * len(p) for p in parts)

    for name in ("therefore", "cheapthere", "apillsx", "winwin"):
        splits = [[name[i:j] for i, j in itertools.pairwise([0, *cut, len(name)])] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
        assert cost(s.words(name)) == pytest.approx(max(map(cost, splits)))


def test_long_words_and_letters_are_words_too():
    s = u.Segmenter({"a": 5, "x" * 40: 3, "b": 1})
    assert s.words("a" + "x" * 40 + "b") == ["a", "x" * 40, "b"]


def plain_odds(rows):
    """log odds of each (url, html), all counts in dictionaries."""
    counts = Counter()
    for url, html in rows:
        counts.update(u.LETTERS.findall(u.TAGS.sub(" ", html or "").translate(u.ASCII_LOWER)))
        counts.update(w for label in u.split_url(url)[0].split(".") if "-" in label for w in u.LETTERS.findall(label))
    s = u.Segmenter(counts)
    own, bad = [], []
    for url, _ in rows:
        host, path = u.split_url(url)
        split = [(n[:2], w) for n in u.names(host, path) for w in (["0"] if n[2:] == "0" else s.words(n[2:]))]
        rule = u.ruled(host, path)
        bad.append(rule[0] == "block" if rule else any(w in u.UNWANTED for _, w in split))
        own.append([m + w for m, w in split if w not in u.RULE_WORDS])
    n = [Counter(), Counter()]
    for words, b in zip(own, bad, strict=True):
        n[b].update(words)
    size = len(n[0] | n[1])
    total = [sum(c.values()) + u.SMOOTHING * size for c in n]
    prior = math.log((sum(bad) + u.SMOOTHING) / (len(bad) - sum(bad) + u.SMOOTHING))
    return [prior + sum(math.log((n[1][w] + u.SMOOTHING) / total[1]) - math.log((n[0][w] + u.SMOOTHING) / total[0]) for w in words) for words in own]


def test_log_odds_agree_with_plain_naive_bayes(spark):
    rows = [(f"https://news{i % 7}.example.com/en/{i}", "<p>free bets on horses, cheap flights, été I a big farm</p>") for i in range(60)]
    rows += [(f"http://{n}.example.{t}/{p}/{i}", None) for i in range(3) for n in ("casino-win", "cheappills", "bigfarm", "freebets") for t in ("com", "net", "org") for p in ("de", "fr", "en")]
    rows += [(None, None), ("nothing", ""), ("http://" + "cheapbig" * 4000 + ".org/x", ""), ("://", "x"), ("http://ÄB.org/Q/é", "<style>a</style>")]
    got = u.judged_urls(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)).collect()
    assert [r.log_odds for r in sorted(got)] == pytest.approx(plain_odds(rows), abs=1e-6)


def test_verdicts_that_are_not_the_lists(spark):
    """Held-out urls, which no rule fits: words that rules block are blocked without being listed, and a listed word that rules allow is allowed."""
    rows = [(f"http://{w}.example.net/fr/{i}", "zorp widget") for i in range(40) for w in ("zorp", "widget")]
    rows += [(f"http://{w}.example.org/fr/{i}", "poker garden club") for i in range(40) for w in ("poker-club", "garden")]
    rows += [(f"http://garden-club.example.com/en/{i}", "") for i in range(40)]
    held = {"http://zorpwidget.example.com/en/1": "block", "http://widget.example.org/en/2": "block", "http://poker-club.example.com/en/3": "allow", "http://garden.example.org/de/4": "allow"}
    got = u.judged_urls(spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, *((x, "") for x in held)])], "page_id long, url string, html string")).where(f"page_id >= {len(rows)}").collect()
    assert all(r.rule is None for r in got) and [r.verdict for r in sorted(got)] == list(held.values())
    listed = ["block" if any(w in x for w in u.UNWANTED) else "allow" for x in held]
    assert sum(a != b for a, b in zip(listed, held.values(), strict=True)) == 3


def test_urls_by_rule_and_by_words(spark):
    rows = [(i, f"https://news{i % 7}.example.com/en/{i}", "<p>free bets on horses, cheap flights, big farm</p>") for i in range(200)]
    rows += [(1000 + i, f"http://{n}.example.com/en/{i}", "<p>x</p>") for i in range(5) for n in ("casino-win", "cheappills", "spam-farm", "freebets")]
    rows += [(2000, None, None), (2001, "nothing", "<b>"), (2002, "http://good.example.net/en/x", ""), (2002, "http://good.example.net/en/x", ""), (2003, "http://casino-win.net/", ""), (2004, "https://casino.example.org/fr/", None), (None, "http://x.example.org/fr/1", "")]
    got = u.judged_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].verdict == "allow" and by[i].rule is None for i in range(200))
    assert all(by[1000 + i].verdict == "block" for i in range(5))
    assert sum(r.verdict == "block" for r in got if r.page_id and 1000 <= r.page_id < 2000) == 20
    assert (by[2000].host, by[2000].path, by[2000].verdict) == ("", "", "allow")
    assert (by[2002].rule, by[2002].verdict, by[2003].rule, by[2003].verdict, by[2004].verdict, by[None].verdict) == ("example.net/en/", "allow", "net/", "block", "allow", "allow")
