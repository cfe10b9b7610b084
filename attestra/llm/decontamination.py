"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least THRESHOLD of its distinct shingles (five
words) occur in it. Under one hash, the sketch of an item of n shingles is its bottom
n - needed(n) + 1 of them: a document that contains the item lacks fewer, so it
has at least one of the sketch, and no pair is lost. Items are partitioned by size, in
powers of two. Each partition has its own hash bound, the largest in its sketches, and only
documents of enough shingles look into it, with those of their hashes that the bound
admits: about a quarter. Whole documents are searched, however much longer they are.

Every pair found this way is verified: shared shingles are counted as words, not hashes.

Benchmark items are a stated query set. They are taken in blocks of BLOCK_BYTES, each
broadcast and held against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, by_volume, materialize, rows_with_text, sliced
from attestra.llm.shingles import PLAIN, Words

WIDTH = 5
#: As a fraction, 0.8, so that it holds exactly.
THRESHOLD = (4, 5)
#: UTF-8 bytes of items in one block, about.
BLOCK_BYTES = 16 << 20


def needed(n: int) -> int:
    """The fewest of n shingles that are THRESHOLD of them."""
    return -(-THRESHOLD[0] * n // THRESHOLD[1])


def shingles(text: bytes) -> list[bytes]:
    """Distinct shingles of a text with blanks for all ASCII but letters and digits, lower case. Fewer than five words are one shingle; no words, none."""
    words = text.translate(PLAIN).split()
    return list({b" ".join(words[i : i + WIDTH]): None for i in range(max(1, len(words) - WIDTH + 1))}) if words else []


class Partition:
    """The sketches of items of one width and size class: sorted hashes, the item of each; bound, least (shingles of a document that can contain one)."""

    def __init__(self, sketches: list[tuple[int, np.ndarray]], least: int) -> None:
        hashes = np.concatenate([h for _, h in sketches])
        items = np.concatenate([np.full(len(h), i) for i, h in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.bound, self.least = hashes[order], items[order], hashes.max(), least
        self.seen = np.zeros(1 << (len(hashes).bit_length() + 5), bool)
        self.seen[hashes & np.uint64(len(self.seen) - 1)] = True

    def found(self, hashes: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) for all sketch hashes among the texts' hashes."""
        some = np.flatnonzero(self.seen[hashes & np.uint64(len(self.seen) - 1)] & (hashes <= self.bound))
        h, t = hashes[some], text[some]
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        return {(int(t[i]), int(x)) for i in np.flatnonzero(high > low) for x in self.items[low[i] : high[i]]}


class Index:
    """Items of one block: their shingles, and the partitions by width and size."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.ids, self.shingles = [], []
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for key, text in zip(ids, texts, strict=True):
            if own := shingles(text):
                words = Words(own)
                width = min(WIDTH, len(own[0].split()))
                n = len(own)
                hashes = np.sort(words.runs(words.hashes(), width)[1])[: n - needed(n) + 1]
                groups.setdefault((width, n.bit_length()), []).append((len(self.ids), hashes))
                self.ids.append(key)
                self.shingles.append(own)
        self.widths: dict[int, list[Partition]] = {}
        for (width, bits), sketches in groups.items():
            self.widths.setdefault(width, []).append(Partition(sketches, needed(1 << bits - 1)))

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) for all items that texts contain."""
        texts = [t.translate(PLAIN) for t in texts]
        words = Words(texts)
        hashes = words.hashes()
        pairs: set[tuple[int, int]] = set()
        for width, partitions in self.widths.items():
            at, h = words.runs(hashes, width)
            text = np.searchsorted(words.first, at, "right") - 1
            n = np.bincount(text, minlength=len(texts))[text]
            for p in partitions:
                enough = n >= p.least
                pairs |= p.found(h[enough], text[enough])
        last, padded = -1, b""
        for t, item in sorted(pairs):
            if t != last:
                last, padded = t, b" " + b" ".join(texts[t].split()) + b" "
            shared = sum(b" " + s + b" " in padded for s in self.shingles[item])
            if shared >= needed(len(self.shingles[item])):
                yield t, item, shared


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """One index for each block of items with text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    for block in range(blocks):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        yield Index(table.column("item_id").to_pylist(), as_bytes(table.column("text").combine_chunks()))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, item_shingles, shared, containment.

    Null texts, and items without words, match nothing. An item of under five words is one shingle of that many.
    Repeated rows on either side each give rows of their own. Empty tables give an empty result. Other columns
    are not looked at.
    """
    schema = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    out = []
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in sliced(batches):
                ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
                found = [(ids[part[t]], index.ids[i], len(index.shingles[i]), n) for part in by_volume(texts) for t, i, n in index.matches(texts[part.start : part.stop])]
                columns = [list(x) for x in zip(*found, strict=True)] or [[]] * 4
                columns.append([n / size for size, n in zip(*columns[2:], strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 4 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "item_id", "item_shingles", "shared", "containment"])

        out.append(source.mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, out)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, in their columns, without those that contain an item. Null texts stay. Each block of items after the first takes what the one before left, written."""
    for block, index in enumerate(indexes(benchmark)):
        if block:  # or all blocks would be in memory together
            docs = materialize(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(column: pa.Array, shared=shared) -> list[bool]:
            texts = [t or b"" for t in as_bytes(column)]
            hit = {part[t] for part in by_volume(texts) for t, _, _ in shared.value.matches(texts[part.start : part.stop])}
            return [i not in hit for i in range(len(texts))]

        docs = rows_with_text(docs, clean)
    return docs
