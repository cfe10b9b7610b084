"""URL filtering: rules first, then naive Bayes over segmented host names and path tokens.

A unigram model, counted over the words of all pages, splits concatenated names by Viterbi. No
vocabulary is cut or broadcast whole: rolling hashes of a name's substrings meet a bitmap of all words'
hashes (of fixed size), those that are there are joined to the words, and each name is split by its own words.

Naive Bayes learns from all urls. Where a rule fits, its verdict is the label, whatever the url
says; elsewhere a url is taken to be unwanted if a segmented word is one of UNWANTED. So a listed word that
the rules let pass speaks for allowing, and words that the rules block speak against urls that no
rule fits. The words that rules name are no features: they would only repeat the rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import LOWER, UPPER, by_volume, materialize, sliced, small
from attestra.llm.shingles import BYTE_BASE, mixed, powers

#: Fixed values: (verdict, rule). A rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that mark a name as unwanted.
UNWANTED = ("adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "loans", "pills", "poker", "porn", "pharma", "sex", "slots", "spam", "viagra", "warez", "xxx")
#: What a character of an unknown word costs (as a log probability).
UNKNOWN = -12.0
#: Weight of UNWANTED words in the unigram model, in words of a million.
KNOWN_SHARE = 1e-4
SMOOTHING = 0.5
#: Distinct words that a task counts, or names that it tells apart, before it passes them on.
FLUSH = 1 << 19
#: Bits of the slot that a word's hash has in the bitmap: 2**FILTER_BITS bits are broadcast, whatever the vocabulary.
FILTER_BITS = 26
INVERSE = pow(BYTE_BASE, -1, 1 << 64)
TAGS, LETTERS, TOKEN = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.S), re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+|[0-9]+")
HOST, PATH = re.compile("[^/?#]*"), re.compile("[^?#]*")
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    host = HOST.match(rest)[0] if found else ""
    return host.translate(ASCII_LOWER), PATH.match(rest, len(host))[0] if found else ""


def ruled(host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    fits = [(v, r) for v, r in RULES if f".{host}".endswith("." + r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    return max(fits, key=lambda x: len(x[1]), default=None)


#: Words that rules name.
RULE_WORDS = sorted({w for _, rule in RULES for w in TOKEN.findall(rule)})


class Segmenter:
    """Splits names into words by Viterbi over a unigram model. total: the sum of all counts, if more words were counted than are given."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = total or sum(counts.values()) or 1
        self.logs = {w: log(n / total) for w, n in counts.items() if n} | {w: max(log(KNOWN_SHARE), log(counts.get(w, 0) / total or KNOWN_SHARE)) for w in UNWANTED}
        self.lengths = sorted({len(w) for w in self.logs})

    def words(self, name: str) -> list[str]:
        """The likeliest words of a run of letters. Letters that are in no known word come out together."""
        best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
        for end in range(1, len(name) + 1):
            found = [(best[end - 1][0] + UNKNOWN, end - 1, False)]
            for n in self.lengths:
                if n > end:
                    break
                if (p := self.logs.get(name[end - n : end])) is not None:
                    found.append((best[end - n][0] + p, end - n, True))
            best.append(max(found))
        out: list[str] = []
        end, whole = len(name), True
        while end:
            _, begin, known = best[end]
            if known or whole:
                out.append(name[begin:end])
            else:
                out[-1] = name[begin:end] + out[-1]
            end, whole = begin, known
        return out[::-1]


def plain_label(label: str) -> str:
    """A part of a host name as it is read: what xn-- stands for, where it stands for something."""
    try:
        return label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label
    except UnicodeError:
        return label


def names(host: str, path: str) -> list[str]:
    """Runs of letters of the host, marked as such, and of the path, in lower case and without escapes; numbers count as one word."""
    parts = (("h:", ".".join(map(plain_label, host.split(".")))), ("p:", unquote(path)))
    return [f"{mark}{'0' if t[0] in '0123456789' else t}" for mark, part in parts for t in TOKEN.findall(part.lower())]


def counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the pages' text, and the parts of hyphenated host names. Columns: url, html."""
    counts: Counter[str] = Counter()
    for batch in sliced(batches):
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update(LETTERS.findall(TAGS.sub(" ", html or "").lower()))
            counts.update(w for label in split_url(url)[0].split(".") if "-" in label for w in LETTERS.findall(plain_label(label).lower()))
        if len(counts) > FLUSH:
            yield counted(counts)
            counts.clear()
    yield counted(counts)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, host, path, rule, ruled (its verdict), names. Columns: page_id, url."""
    for batch in sliced(batches):
        split = [split_url(u) for u in batch.column(1).to_pylist()]
        rules = [ruled(*p) or (None, None) for p in split]
        columns = [[h for h, _ in split], [p for _, p in split], [r for _, r in rules], [v for v, _ in rules]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array([names(*p) for p in split], pa.list_(pa.string()))], ["page_id", "host", "path", "rule", "ruled", "names"])


class Windows:
    """Hashes of the substrings of many names: differences of prefix sums of a polynomial, with the offset divided out. A substring has one hash wherever it is."""

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.which = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(points)), out=self.sums[1:])
        self.back = powers(INVERSE, len(points))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all substrings of k code points."""
        n = len(self.which) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        (inside,) = np.nonzero(self.which[:n] == self.which[k - 1 :])
        return self.which[inside], mixed((self.sums[inside + k] - self.sums[inside]) * self.back[inside])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, hash. Columns: word, n."""
    for batch in sliced(batches):
        words = batch.column(0).to_pylist()
        keys = np.zeros(len(words), np.uint64)
        lengths = np.array([len(w) for w in words], np.int64)
        for k in np.unique(lengths).tolist():
            (own,) = np.nonzero(lengths == k)
            keys[own] = Windows([words[i] for i in own.tolist()]).of(k)[1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["word", "n", "hash"])


def word_filter(words: DataFrame) -> np.ndarray:
    """One bit for each slot of a word's hash. words: hash."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    parts = words.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    out = np.zeros((max(1, (1 << FILTER_BITS) >> 15), 4096), np.uint8)
    for part, bits in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        out[part - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def segmented(found: DataFrame, words: DataFrame) -> DataFrame:
    """found: name (distinct); words: word, n, hash, written before. name and its words, each name split by those of its substrings that are words.

    A name is sent to its words as a number, with a hash for each substring that may be a word: work and rows are bounded by the
    name's letters times the lengths that words have, and the name itself isn't repeated.
    """
    total = words.agg(F.sum("n")).first()[0] or 1
    lengths = sorted(r.k for r in words.select(F.length("word").alias("k")).distinct().collect())
    known_bits = found.sparkSession.sparkContext.broadcast(word_filter(words))
    named = materialize(found.withColumn("nid", F.monotonically_increasing_id()), "names")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in by_volume([t.encode() for t in texts]):
                own = [texts[i] for i in part]
                windows, longest = Windows(own), max(map(len, own))
                for k in lengths[: np.searchsorted(lengths, longest, "right")]:
                    which, key = windows.of(k)
                    slot = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    there = (known_bits.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    pairs = np.unique(np.stack([which[there].astype(np.uint64), key[there]]), axis=1)
                    for begin in range(0, pairs.shape[1], 1 << 16):
                        some = pairs[:, begin : begin + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some[0].astype(np.int64) + part.start]), pa.array(some[1].view(np.int64))], ["nid", "hash"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            own = lambda name, words, counts: {w: n for w, n in zip(words or (), counts or (), strict=True) if w in name}
            out = [(name, Segmenter(own(name, words, counts), total).words(name) if name != "0" else ["0"]) for name, words, counts in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.string()))], ["name", "words"])

    pieces = named.where("name <> '0'").select("nid", "name").mapInArrow(cut, "nid long, hash long")
    known = pieces.join(words, "hash").groupBy("nid").agg(F.collect_list(F.struct("word", "n")).alias("own"))
    return named.join(known, "nid", "left").select("name", F.col("own.word").alias("words"), F.col("own.n").alias("counts")).mapInArrow(split, "name string, words array<string>")


def odds(good: Column, bad: Column, totals: tuple[float, float]) -> Column:
    """What a word of so many good and bad urls adds to the log odds; rounded, so that a sum is the same in any order."""
    return (F.log((bad + SMOOTHING) / totals[1]) - F.log((good + SMOOTHING) / totals[0])).cast("decimal(20,12)")


def judged_urls(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, log_odds (of being unwanted).

    The longest rule that fits decides; without one (rule null), log odds over 0 block. A url that is null or has no
    ``://`` has neither host nor path, and only the prior speaks. Repeated rows are judged alike. Other columns are not
    looked at; an empty table gives an empty result.
    """
    words = pages.select("url", "html").mapInArrow(word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.mapInArrow(hashed, "word string, n long, hash long"), "words")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(parts, "page_id long, host string, path string, rule string, ruled string, names array<string>")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "urls")
    marked = rows.select("rid", "ruled", F.explode("names").alias("marked"))
    found = marked.select(F.substring("marked", 3, 1 << 30).alias("name")).distinct()
    split = materialize(segmented(found, words), "segments").withColumn("listed", F.arrays_overlap("words", F.array(*map(F.lit, UNWANTED))))

    # labels: the rule's verdict, or else whether a word is listed
    name = F.substring("marked", 3, 1 << 30)
    listed = small(materialize(split.where("listed").select("name", "listed"), "listed"))
    weak = marked.withColumn("name", name).join(listed, "name").select("rid").distinct().withColumn("listed", F.lit(True))
    bad = F.coalesce(F.col("ruled") == "block", F.col("listed"), F.lit(False))
    labels = materialize(rows.select("rid", "ruled", "names").join(weak, "rid", "left").select("names", bad.alias("bad")), "labels")
    urls = {r.bad: r["count"] for r in labels.groupBy("bad").count().collect()}
    prior = log((urls.get(True, 0) + SMOOTHING) / (urls.get(False, 0) + SMOOTHING))

    # words of marked names, with the urls of either label that have them
    sums = labels.select(F.explode("names").alias("marked"), "bad").groupBy("marked").agg(F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count(F.when(~F.col("bad"), 1)).alias("good"))
    spread = materialize(sums.withColumn("name", name).join(split.select("name", "words"), "name").select("marked", "good", "bad", F.explode("words").alias("word")).where(~F.col("word").isin(RULE_WORDS)).withColumn("word", F.concat(F.substring("marked", 1, 2), "word")), "name-words")
    model = materialize(spread.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "model")
    good, blocked, n = model.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    totals = (good + SMOOTHING * n, blocked + SMOOTHING * n)
    shares = materialize(spread.select("marked", "word").join(model, "word").groupBy("marked").agg(F.sum(odds(F.col("good"), F.col("bad"), totals)).alias("odds")), "odds") if n else None

    scores = marked.join(small(shares), "marked").groupBy("rid").agg(F.sum("odds").alias("odds")) if n else rows.select("rid", F.lit(None).cast("double").alias("odds"))
    log_odds = F.lit(prior) + F.coalesce(F.col("odds").cast("double"), F.lit(0.0))
    out = rows.join(scores, "rid", "left").withColumn("log_odds", log_odds)
    verdict = F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")
