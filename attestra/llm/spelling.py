"""Grouping of spelling variants by rolling-hash deletions.

Two words of one length differ in one place if they are equal without it; a word is another with
one more code point if it is equal to that one without it. So each word has a key for itself and
one for each of its deletions: 64-bit polynomial hashes, each deletion's from the hash of the
prefix before it and of the suffix behind it, computed in numpy for many words at once. Keys are
partitioned by their first bits and sorted within a partition; where keys meet, strings decide.

What meets in a key is never paired: the members of a group need its size and its two most
frequent words only, so a group costs what it has.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, by_volume, discard, materialize, sliced
from attestra.llm.shingles import BYTE_BASE, mixed, powers

#: Code points of a word at least, occurrences of a word at least, how many times as frequent a form is at least.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Of so many runs of a document one loses a code point.
ONE_IN = 31
#: Shorter runs can't give a word.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Distinct words that a task counts before it passes them on; keys of a partition, about.
FLUSH, PARTITION_KEYS = 1 << 18, 1 << 19
INVERSE = pow(BYTE_BASE, -1, 1 << 64)


def altered(run: str, doc: int) -> str:
    """The run, without a code point if the crc32 of the document's part and the run asks for it. doc: the crc32 of ``<doc_id>:``."""
    h = crc32(run.encode(), doc)
    return run if h % ONE_IN else run[: (i := h % len(run))] + run[i + 1 :]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n. Columns: doc_id, text."""
    counts: Counter[str] = Counter()
    table = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            doc = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # bytes.lower() changes A-Z only
            runs = Counter(m[0] for m in RUN.finditer((text or b"").lower().decode()))
            for run, n in runs.items():
                word = altered(run, doc)
                if len(word) >= LEAST_LENGTH:
                    counts[word] += n
            if len(counts) > FLUSH:
                yield table()
                counts.clear()
    yield table()


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words that occur LEAST_COUNT times or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word and -1 (nothing deleted) or a place: the word's number, the place, the key of what is left."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words], np.int64)
    start, n = np.cumsum(lengths) - lengths, len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, n), out=sums[1:])
    back = powers(INVERSE, n + 1)
    which, at = np.repeat(np.arange(len(words)), lengths), np.arange(n)
    prefix, suffix = sums[at] - sums[start[which]], sums[(start + lengths)[which]] - sums[at + 1]
    deleted = mixed((prefix + suffix * np.uint64(INVERSE)) * back[start[which]])
    own = mixed((sums[start + lengths] - sums[start]) * back[start])
    return np.concatenate([np.arange(len(words)), which]), np.concatenate([np.full(len(words), -1), at - start[which]]), np.concatenate([own, deleted])


def keyed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """radix, word, n, places, keys: a word once for each partition that it has keys in, so that a long one isn't sent for each of its places. Columns: word, n."""
    for batch in sliced(batches, 1 << 14):
        texts = as_bytes(batch.column(0))
        for part in by_volume(texts):
            which, at, key = deletion_keys([texts[i].decode() for i in part])
            radix = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            order = np.lexsort((at, radix, which))
            which, at, key, radix = which[order], at[order], key[order], radix[order]
            first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (radix[1:] != radix[:-1])]))
            offsets = pa.array(np.append(first, len(which)).astype(np.int32))
            rows = pa.array(which[first] + part.start)
            columns = [pa.array(radix[first]), batch.column(0).take(rows), batch.column(1).take(rows)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)))], ["radix", "word", "n", "places", "keys"])


class Near:
    """For each word of a partition: how many near words it has met, and the most frequent of them (ties: the smallest)."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.counts = words, counts
        self.n: dict[int, int] = defaultdict(int)
        self.best: dict[int, tuple[int, str]] = {}

    def order(self, i: int) -> tuple[int, str]:
        return -self.counts[i], self.words[i]

    def met(self, i: int, others: int, best: int) -> None:
        self.n[i] += others
        self.best[i] = min(self.best.get(i, self.order(best)), self.order(best))

    def alike(self, members: list[int]) -> None:
        """Words that are all near to each other."""
        first, second = sorted(members, key=self.order)[:2]
        for i in members:
            self.met(i, len(members) - 1, second if i == first else first)


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of over one row in which all these sorted columns are equal."""
    same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def met_words(table: pa.Table) -> pa.Table:
    """word, n (of the word, in the partition that has its own key, else 0), n_near, form_n, form (of the near words met here): for each word of a partition."""
    words, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
    places = table.column("places").combine_chunks()
    which, at = np.repeat(np.arange(len(words)), places.value_lengths().to_numpy()), places.flatten().to_numpy()
    key = table.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64)
    near = Near(words, counts)
    own, deleted = at < 0, at >= 0

    # one code point replaced: equal without the same place; two words can be so in one place only
    w, p, k = which[deleted], at[deleted], key[deleted]
    order = np.lexsort((p, k))
    w, p, k = w[order], p[order], k[order]
    for a, b in runs_of(k, p):
        groups: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, place in zip(w[a:b].tolist(), p[a:b].tolist(), strict=True):
            groups[words[i][:place], words[i][place + 1 :]].append(i)
        for members in groups.values():
            if len(members) > 1:
                near.alike(members)

    # one inserted: equal to the other without a place; in a run of equal code points its first place stands for all
    w0 = which[own]
    k0 = key[own]
    order = np.argsort(k0, kind="stable")
    w0, k0 = w0[order], k0[order]
    low, high = np.searchsorted(k0, k, "left"), np.searchsorted(k0, k, "right")
    for x in np.flatnonzero(high > low).tolist():
        long, place = int(w[x]), int(p[x])
        word = words[long]
        if place and word[place - 1] == word[place]:
            continue
        for short in w0[low[x] : high[x]].tolist():
            if len(words[short]) == len(word) - 1 and words[short].startswith(word[:place]) and words[short].endswith(word[place + 1 :]):
                near.met(long, 1, short)
                near.met(short, 1, long)

    home = set(w0.tolist())
    rows = [(words[i], counts[i] if i in home else 0, near.n.get(i, 0), -near.best[i][0] if i in near.best else None, near.best[i][1] if i in near.best else None) for i in sorted(home | near.n.keys())]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n, written before. word, n, n_near, form, form_n: the near words' number, and the most frequent of them, whatever its count."""
    keys = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    bits = max(0, int(keys // PARTITION_KEYS).bit_length())
    rows = words.select("word", "n").mapInArrow(lambda batches: keyed(batches, bits), "radix long, word string, n long, places array<int>, keys array<long>")
    met = rows.groupBy("radix").applyInArrow(met_words, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))))
    found = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def followed(links: DataFrame) -> DataFrame:
    """links: word, form, written before; no word comes back to itself. word, root: the last of the forms, found by doubling the way looked ahead."""
    ways = links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        used, ways = ways, longer
        if hasattr(used, "written_at"):
            discard(used)
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words come from the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased; a run whose crc32 with
    its document's id (nothing for a null one) is a multiple of ONE_IN loses a code point first. Those of LEAST_LENGTH code
    points and LEAST_COUNT occurrences or more are words. Near words differ by one code point inserted, deleted or replaced.
    form: the most frequent near word (ties: the smallest), if it is ``times`` times as frequent, else null; root: the end of
    the forms from there, the word itself if it has none. Each occurrence counts, in repeated rows too. Null and empty texts
    have no words, long words are words like any others, other columns are not looked at, and an empty table gives an empty
    result.
    """
    words = materialize(words_of(docs, id_col, text_col), "words")
    near = near_words(words)
    far = F.col("form_n") >= times * F.col("n")
    found = materialize(near.select("word", "n", "n_near", F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "near-words")
    roots = followed(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
