"""Substring dedup with an FM-index per shard.

A window is WINDOW consecutive words. Windows are dealt to shards by content: by the least
hash of GRAM consecutive words within (the route), which neighbouring windows share, so that
what is shuffled are short runs of words, and all places of one word sequence meet in one
shard. Shards are as many as the text's bytes ask for. A shard indexes its runs (suffix order,
wavelet matrix over the Burrows-Wheeler transform) and streams them against the index: backward
search gives, for each window, the interval of suffixes that start with its very words, and so
the smallest id that has them. Runs whose route no other document has are passed over: they have
nothing to be held against. Memory is bounded by INDEX_WORDS: routes are indexed in groups of that
size, and a larger one is dealt on by its windows' hashes.

Routes that a sample of documents shows to be frequent would make hot shards. Their windows are
indexed and searched within each chunk of a task first, so that a passage in a third of all
documents is sent once for each chunk, and go to shards by a hash of their own. The sample
decides on load, not on results.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import LAST_ID, as_bytes, by_volume, materialize, small
from attestra.llm.fm_index import FmIndex
from attestra.llm.shingles import WORD_BASE, mixed

WINDOW, GRAM = 13, 4
#: UTF-8 bytes of text taken at once, about; windows in a run at most; UTF-8 bytes of text for each shard.
CHUNK_BYTES, RUN_MOST, SHARD_BYTES = 8 << 20, 24, 8 << 20
#: Words in one index, about.
INDEX_WORDS = 4_000_000
#: A route is frequent if it is in this share of documents, or in so many of them; it then occurs SEEN times in the sample, about.
FREQUENT, ROUTE_DOCS, SEEN = 0.02, 50_000, 40
#: Frequent routes at most (the most frequent); 8 bytes each are broadcast.
FREQUENT_MOST = 1 << 22


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive entries."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(WORD_BASE) + h[i : i + len(out)]
    return mixed(out)


def least_of(h: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive entries."""
    width = 1
    while width < k:
        step = min(width, k - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    return h


class Chunk:
    """Words of some texts: number in vocabulary, text, place in the text; windows by their first word, each with its route and whether that is frequent."""

    def __init__(self, texts: list[bytes], frequent: np.ndarray) -> None:
        words = [t.split() for t in texts]
        self.lengths = np.array([len(w) for w in words])
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int32, int(self.lengths.sum()))
        self.vocabulary = np.array(list(numbers), object)
        self.sizes = np.fromiter(map(len, numbers), np.int64, len(numbers)) + 1
        del words
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        begin = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.place = np.arange(len(self.ids), dtype=np.int32) - begin[self.text]
        n = max(0, len(self.ids) - WINDOW + 1)
        self.windows = np.flatnonzero(self.place[:n] + WINDOW <= self.lengths[self.text[:n]])
        if len(self.windows):
            h = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)[self.ids]
            self.route = least_of(chained(h, GRAM), WINDOW - GRAM + 1)[self.windows]
            self.frequent = np.isin(self.route, frequent)
            self.route[self.frequent] = chained(h, WINDOW)[self.windows[self.frequent]]


def runs(*columns: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entries and lengths of runs in which the columns are constant and step goes up by one; a run has RUN_MOST entries at most."""
    n = len(step)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = step[1:] != step[:-1] + 1
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    new[(np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % RUN_MOST == 0] = True
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each entry, one after the other."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + length, length)


def packed(*parts: object) -> bytes:
    return zstandard.compress(pickle.dumps(parts, 5), 3)


#: Columns of a message: windows, text, place and half of the route of each run; id and key of each text. Numbers that go up are told by their steps.
OF_RUNS, OF_TEXTS = (np.uint8, np.int32, np.int32, np.uint32), (np.int64, np.int64)


def message(words: bytes, *columns: np.ndarray) -> bytes:
    """Runs for a shard. words: one blank between them, one line for each run."""
    length, own, place, route, ids, keys = columns
    parts = zip(OF_RUNS + OF_TEXTS, (length, np.diff(own, prepend=0), place, route, np.diff(ids, prepend=0), keys), strict=True)
    return zstandard.compress(b"".join([np.array([len(length), len(ids)], np.int32).tobytes(), *(c.astype(kind).tobytes() for kind, c in parts), words]), 3)


def opened(packet: bytes) -> tuple[bytes, list[np.ndarray]]:
    """What message() was given."""
    raw = zstandard.decompress(packet)
    n_runs, n_texts = np.frombuffer(raw, np.int32, 2).tolist()
    columns, at = [], 8
    for kinds, n in ((OF_RUNS, n_runs), (OF_TEXTS, n_texts)):
        for kind in kinds:
            columns.append(np.frombuffer(raw, kind, n, at))
            at += columns[-1].nbytes
    return raw[at:], [np.cumsum(c) if i in (1, 4) else c for i, c in enumerate(columns)]


def repeated(words: np.ndarray, length: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: numbers from 1, of runs one after the other; length: words of each run. Runs of windows that a smaller owner has too: run, first window, number of windows."""
    text, start, least = FmIndex(words, length, owner, WINDOW).streamed()
    later = least < owner[text]
    text, start = text[later], start[later]
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    first, n = runs(text, step=start)
    return text[first], start[first], n


def dealt(ids: list[int], keys: list[int], texts: list[bytes], shards: int, frequent: np.ndarray, turn: int) -> Iterator[tuple[int, bytes]]:
    """(shard, runs of words) of a chunk; and what is found in it already, as a message to no shard (a negative number)."""
    chunk = Chunk(texts, frequent)
    if not len(chunk.windows):
        return
    ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
    window, text, route = chunk.windows, chunk.text[chunk.windows], chunk.route
    if chunk.frequent.any():
        common = np.flatnonzero(chunk.frequent)
        first, n = runs(text[common], step=window[common])
        at, own = window[common[first]], text[common[first]]
        run, start, n_found = repeated(chunk.ids[spread(at, n + WINDOW - 1)] + 1, n + WINDOW - 1, ids[own])
        yield -1 - turn % shards, packed(ids[own[run]], keys[own[run]], chunk.place[at[run]] + start, n_found)
        left = np.ones(len(window), bool)
        left[common[spread(first[run] + start, n_found)]] = False
        window, text, route = window[left], text[left], route[left]
    first, n = runs(text, route, step=window)
    shard = (route[first] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        mine = order[bounds[s] : bounds[s + 1]]
        at, own, length = window[first[mine]], text[first[mine]], n[mine]
        numbers = chunk.ids[spread(at, length + WINDOW - 1)]
        words = bytearray(b" ".join(chunk.vocabulary[numbers]))
        ends = np.cumsum(chunk.sizes[numbers])[np.cumsum(length + WINDOW - 1) - 1] - 1
        np.frombuffer(words, np.uint8)[ends[:-1]] = ord("\n")
        texts_here, own = np.unique(own, return_inverse=True)
        yield s, message(bytes(words), length, own, chunk.place[at], half(route[first[mine]]), ids[texts_here], keys[texts_here])


def half(route: np.ndarray) -> np.ndarray:
    return (route >> np.uint64(32)).astype(np.uint32)


def with_company(route: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which runs have a route that another owner has too."""
    order = np.argsort(route, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], route[order][1:] != route[order][:-1]]))
    several = np.minimum.reduceat(owner[order], first) < np.maximum.reduceat(owner[order], first)
    out = np.empty(len(order), bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    return out


def unpacked(messages: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of one shard, runs whose route another owner has: their words as numbers from 1, a hash of each number's word; windows, owner, key and place of each run. Words of all other runs stay packed."""
    numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    packets = [opened(m) for m in messages]
    kept = with_company(np.concatenate([c[3] for _, c in packets]), np.concatenate([c[4][c[1]] for _, c in packets]))
    parts, at = [], 0
    for words, (length, own, place, _, ids, keys) in packets:
        (some,) = kept[at : at + len(length)].nonzero()
        at += len(length)
        lines = words.split(b"\n")
        found = [x for i in some.tolist() for x in lines[i].split(b" ")]
        parts.append((np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)), length[some].astype(np.int32), ids[own[some]], keys[own[some]], place[some]))
    words, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    return words, np.array([0, *map(xxhash.xxh64_intdigest, numbers)], np.uint64), *rest


def grouped(route: np.ndarray, size: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of runs to be indexed together, of INDEX_WORDS or little more: all runs of some routes, but for routes of one owner."""
    order = np.argsort(route, kind="stable")
    order = order[with_company(route, owner)[order]]
    if not len(order):
        return
    first = np.flatnonzero(np.concatenate([[True], route[order][1:] != route[order][:-1]]))
    begin = np.cumsum(np.add.reduceat(size[order], first)) // INDEX_WORDS
    part = np.repeat(begin, np.diff(np.append(first, len(order))))
    for cut in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        yield np.sort(cut)


def found_in(messages: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of one shard: owner, key, first window and number of windows for runs of windows that a smaller owner has."""
    words, hashes, length, owner, key, place = unpacked(messages)
    if not len(length):
        return (np.zeros(0, np.int64),) * 4
    begin = np.cumsum(length + WINDOW - 1) - (length + WINDOW - 1)
    route = least_of(chained(hashes[words], GRAM), WINDOW - GRAM + 1)[begin]
    out = []
    for some in grouped(route, length + WINDOW - 1, owner):
        if (length[some] + WINDOW - 1).sum() <= 2 * INDEX_WORDS:
            todo = [(begin[some], length[some], owner[some], key[some], place[some])]
        else:  # one large route: its windows by their own hash
            window, run = spread(begin[some], length[some]), np.repeat(some, length[some])
            at, h = place[run] + window - begin[run], np.zeros(len(window), np.uint64)
            for i in range(WINDOW):
                h = h * np.uint64(WORD_BASE) + hashes[words[window + i]]
            todo = [(window[x], np.ones(len(x), np.int32), owner[run[x]], key[run[x]], at[x]) for x in grouped(mixed(h), np.full(len(h), WINDOW), owner[run])]
        for at, n, who, which, where in todo:
            run, start, n_found = repeated(words[spread(at, n + WINDOW - 1)], n + WINDOW - 1, who)
            out.append((who[run], which[run], where[run] + start, n_found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def judged(table: pa.Table) -> pa.Table:
    messages = table.column("message").to_pylist()
    if table.column("shard")[0].as_py() < 0:
        found = [np.concatenate(x) for x in zip(*(pickle.loads(zstandard.decompress(m)) for m in messages), strict=True)]
    else:
        found = found_in(messages)
    return pa.table([pa.array(x.astype(np.int64)) for x in found], ["owner", "key", "first", "n"])


def frequent_routes(docs: DataFrame) -> np.ndarray:
    """Routes of windows in over FREQUENT of the documents, or over ROUTE_DOCS of them, as a sample has it. Its size follows from what it must show."""
    n = max(1, docs.count())
    share = min(FREQUENT, ROUTE_DOCS / n)
    drawn = min(1.0, SEEN / share / n)

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for part in by_volume(texts, CHUNK_BYTES):
                chunk = Chunk(texts[part.start : part.stop], np.zeros(0, np.uint64))
                if len(chunk.windows):
                    text = chunk.text[chunk.windows]
                    order = np.lexsort((chunk.route, text))
                    h, text = chunk.route[order], text[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("owner", F.lit(5)), F.lit(1 << 40)) <= int(drawn * (1 << 40)))
    found = sample.select("text").mapInArrow(routes, "h long").groupBy("h").count().where(F.col("count") > max(SEEN // 2, share * drawn * n))
    return found.orderBy(F.desc("count")).limit(FREQUENT_MOST).select("h").toArrow().column(0).to_numpy().view(np.uint64)


def keyed(docs: DataFrame) -> DataFrame:
    """docs: owner, text, and what else. Adds key, which tells texts of one owner apart: a hash where an owner has several, else 0, which costs messages nothing."""
    several = docs.groupBy("owner").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low < high")
    several = small(materialize(several.select("owner", F.lit(True).alias("several")), "several"))
    return docs.join(several, "owner", "left").withColumn("key", F.when(F.col("several"), F.xxhash64("text")).otherwise(0)).drop("several")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """docs: owner, key, text. Runs of windows whose words a smaller owner has too: owner, key, first, n."""
    shards = 1 + (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SHARD_BYTES
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_routes(docs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            for part in by_volume(texts, CHUNK_BYTES):
                own = slice(part.start, part.stop)
                for shard, message in dealt(ids[own], keys[own], texts[own], shards, frequent.value, turn):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([message], pa.binary())], ["shard", "message"])
                turn += 1

    messages = docs.select("owner", "key", "text").mapInArrow(deal, "shard int, message binary")
    return messages.groupBy("shard").applyInArrow(judged, "owner long, key long, first long, n long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, text (the kept words, joined by one space).

    A window's words are removed where the same words start in a document with a smaller doc_id; all windows are
    judged on the input. Null ids come after all others and are equal to each other. A null text has no words. Texts
    of under 13 words lose none. Repeated rows have one id, so they don't count against each other. Other columns are
    not looked at; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("owner", F.coalesce("doc_id", F.lit(LAST_ID)))
    docs = keyed(docs)
    found = materialize(repeated_windows(docs.where("text IS NOT NULL")), "repeats")
    found = found.groupBy("owner", "key").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))
    rows = docs.join(found.hint("shuffle_hash"), ["owner", "key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, first, n in zip(as_bytes(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = (text or b"").split()
                total = len(words)
                if first.is_valid:
                    first, n = first.values.to_numpy(), n.values.to_numpy()
                    change = np.bincount(first, minlength=total + 1) - np.bincount(first + n + WINDOW - 1, minlength=total + 1)
                    words = [w for w, gone in zip(words, np.cumsum(change)[:total].tolist(), strict=True) if not gone]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return rows.select("doc_id", "text", "first", "n").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
