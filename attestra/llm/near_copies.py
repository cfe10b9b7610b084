"""Near copies by exact Jaccard similarity of five-word shingles: SimHash candidates first, then those it can't see.

Fingerprints of 64 bits differ in about ten bits at a similarity of 0.8, where vantage-point
bounds no longer prune anything. So the tree (llm/simhash.py) finds pairs within its two bits,
which join most copies, and prefix filtering finds the rest: under any one order of all
shingles, two sets with a similarity of THRESHOLD share one of the first n - ceil(THRESHOLD n) + 1
of each, so no pair is lost. Shingles that a sample of documents has often come last in that order;
the sample decides on load, not on results. All candidates are verified: sizes, the places of the
shared shingle, first shingles that only one of them has and parity bitmaps bound from above how much
two sets can share, and what they let through is held against each other as whole sets.

Groups are connected components. Stars come first: fingerprints that the tree links, and sets that
share a shingle, to the lowest of them and to the one with the fewest rarer shingles: of copies that
were edited, the least edited, which is similar to all that are similar to any other. Then only pairs
that these have not joined are looked at, so that a large group doesn't give all its pairs, and at
one of the shingles that they share, not at each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, by_volume, discard, materialize, one_of_each, sliced, small
from attestra.llm.components import components
from attestra.llm.shingles import Words
from attestra.llm.simhash import links, majority, set_bits

WIDTH = 5
#: As a fraction, 0.8, so that it holds exactly.
THRESHOLD = (4, 5)
#: Documents sampled for the order of shingles, at least, and as a share (so that what a shared shingle costs doesn't grow with the corpus); occurrences among them from which a shingle comes last; shingles that are broadcast at most, the most frequent ones.
SAMPLE_ROWS, SAMPLE_SHARE, OFTEN, LAST_MOST = 8_000, 1 / 16, 2, 1 << 22
#: 64-bit words of the bitmap that joins look at; and shingles for each 64-bit word of the wide one, which has a power of two of these.
MAPS, SHINGLES_EACH = 8, 32
BITMAP = [f"b{i}" for i in range(MAPS)]
#: Parts of a prefix, at whose ends its own shingles are counted; and shingles before a shared one that are looked at for another.
PARTS, BEFORE = 4, 4
CUTS = [f"cut{i}" for i in range(1, PARTS + 1)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles. A-Z in lower case; under five words are one shingle; no words, none."""
    words = Words([t.lower() for t in texts])
    hashes = words.hashes()
    at, h = words.runs(hashes, WIDTH)
    cut = np.searchsorted(at, words.first)
    out = []
    for i in range(len(texts)):
        own = h[cut[i] : cut[i + 1]]
        if not len(own) and len(few := hashes[words.first[i] : words.first[i + 1]]):
            own = np.array([xxhash.xxh3_64_intdigest(few.tobytes())], np.uint64)
        out.append(np.unique(own))
    return out


def all_sets(column: pa.Array) -> Iterator[np.ndarray]:
    texts = [t or b"" for t in as_bytes(column)]
    for part in by_volume(texts):
        yield from shingle_sets(texts[part.start : part.stop])


def bitmap(own: np.ndarray, maps: int) -> np.ndarray:
    """Bit i: whether an odd number of the set's hashes fall on i. Two sets differ in as many shingles as bits, at least."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * maps), minlength=64 * maps) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bitmap(own: np.ndarray) -> bytes:
    return bitmap(own, max(MAPS, 1 << (len(own) // SHINGLES_EACH).bit_length())).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps. The wider one is folded: its bits lie on those of the narrower one."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def simhash(own: np.ndarray) -> int:
    """The SimHash of a set: bits that more than half of its shingles have."""
    return majority(sum((set_bits(own[i : i + (1 << 14)]) for i in range(0, len(own), 1 << 14)), np.zeros(64, np.int64)), len(own))


def prefix(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first hashes of a set, those of last (sorted) after all others: each similar set has one of them among its own first."""
    often, n = among(own, last), len(own)
    return np.concatenate([own[~often], own[often]])[: n + THRESHOLD[0] * -n // THRESHOLD[1] + 1 if n else 0]


def among(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    return last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(len(own), bool)


def cuts(first: np.ndarray, last: np.ndarray) -> list[int]:
    """Where each part of a prefix ends: numbers that never fall along the order of all shingles. -1 for a part that ends before the first."""
    ends = [len(first) * i // PARTS - 1 for i in range(1, PARTS + 1)]
    return [int(first[e] >> np.uint64(2)) + (int(among(first[e : e + 1], last)[0]) << 62) if e >= 0 else -1 for e in ends]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (len(a) + len(b) - shared)


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that a sample of documents has OFTEN or more times."""
    share = int((1 << 30) * min(1, max(SAMPLE_SHARE, SAMPLE_ROWS / max(1, docs.count()))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for own in all_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share).select("text").mapInArrow(each, "h long")
    often = some.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LAST_MOST)
    return np.sort(often.select("h").toArrow().column(0).to_numpy().view(np.uint64))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, th, sid (a digest of the set), n, fp (its SimHash), the cuts of the prefix, both bitmaps, and the prefix as bytes."""
    last = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    names = ["doc_id", "th", "sid", "n", "fp", *CUTS, *BITMAP, "wide", "prefix"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [
                (xxhash.xxh3_64_intdigest(own.tobytes()), len(own), simhash(own), cuts(begin := prefix(own, last.value), last.value), bitmap(own, MAPS), wide_bitmap(own), begin.tobytes())
                for own in all_sets(batch.column(2))
            ]
            sids, sizes, prints, at, maps, wide, prefixes = zip(*rows, strict=True) if rows else ((),) * 7
            at, bits = np.array(at, np.int64).reshape(-1, PARTS), np.array(maps, np.int64).reshape(-1, MAPS)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, prints)]
            columns = [signed[0], pa.array(sizes, pa.int64()), signed[1], *(pa.array(at[:, i]) for i in range(PARTS)), *(pa.array(bits[:, i]) for i in range(MAPS)), pa.array(wide, pa.binary()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    schema = "doc_id long, th long, sid long, n long, fp long, " + ", ".join(f"{b} long" for b in CUTS + BITMAP) + ", wide binary, prefix binary"
    return docs.select("doc_id", "th", "text").mapInArrow(digest, schema).withColumn("at", F.monotonically_increasing_id())


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, sid, place: one row for each hash of a prefix."""
    for batch in sliced(batches):
        hashes = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
        sids = np.repeat(batch.column(0).to_numpy(), [len(h) for h in hashes])
        places = np.concatenate([*(np.arange(len(h), dtype=np.int32) for h in hashes), np.zeros(0, np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)])), pa.array(sids), pa.array(places)], ["h", "sid", "place"])


def possible(a: str, b: str) -> Column:
    """Whether the sizes and bitmaps of two sets allow THRESHOLD."""
    t, u = THRESHOLD
    differ = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in BITMAP[1:]), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    sizes = (F.col(f"{a}.n") * u >= F.col(f"{b}.n") * t) & (F.col(f"{b}.n") * u >= F.col(f"{a}.n") * t)
    return sizes & allowed(a, b, differ)


def reachable(a: str, b: str) -> Column:
    """Whether two sets can share enough if the shingle at their places is the first that they share: what comes before it is not shared."""
    t, u = THRESHOLD
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return left * (u + t) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * t


def unshared(rows: DataFrame) -> DataFrame:
    """rows: h, sid, place, n, for each h that sets of several roots have in their prefixes. With before, the BEFORE shingles ahead of h among a set's rows, and own1 .. : those of its
    prefix up to each cut that are in no row, so that no set of another root has them in its own prefix."""
    t, u = THRESHOLD
    of_set = Window.partitionBy("sid")
    ordered = of_set.orderBy("place")
    length = F.expr(f"n - (n * {t} + {u - 1}) div {u} + 1")
    ends = [F.floor(length * i / PARTS) for i in range(1, PARTS + 1)]
    before = F.array(*(F.lag("h", i).over(ordered) for i in range(1, BEFORE + 1)))
    return rows.withColumn("before", before).withColumns({f"own{i}": e - F.count(F.when(F.col("place") < e, 1)).over(of_set) for i, e in enumerate(ends, 1)})


def first_met(a: str, b: str) -> Column:
    """False only where two sets also share a shingle shortly before this one."""
    return ~F.coalesce(F.arrays_overlap(f"{a}.before", f"{b}.before"), F.lit(False))


def unlike(a: str, b: str) -> Column:
    """How many shingles only one of two sets with different roots has, at least: what is in one's prefix, and not in the other's, isn't in the other at all, if it comes before the end of the other's prefix."""

    def alone(x: str, y: str) -> Column:
        return F.greatest(F.lit(0), *(F.when(F.col(f"{x}.{cut}") < F.col(f"{y}.{CUTS[-1]}"), F.col(f"{x}.own{i}")) for i, cut in enumerate(CUTS, 1)))

    return alone(a, b) + alone(b, a)


def allowed(a: str, b: str, differ: Column) -> Column:
    """Whether two sets that differ in so many shingles, at least, may reach THRESHOLD: similar ones differ in (1 - t) / (1 + t) of both sizes at most."""
    t, u = THRESHOLD
    return differ * (u + t) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (u - t)


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Those of the pairs (u, v: sids) that are similar, by their whole sets."""
    t, u = THRESHOLD

    def with_both(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
        for end in ("u", "v"):
            pairs = pairs.join(facts.select(F.col("sid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return pairs.select("u", "v", *(f"{c}_{end}" for c in columns for end in ("u", "v")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            most = (batch.column(4).to_numpy() + batch.column(5).to_numpy()) * (u - t)
            differ = np.array([differing(x, y) for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True)], np.int64)
            yield batch.select(["u", "v"]).filter(pa.array(differ * (u + t) <= most))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in all_sets(batch.column(1))], pa.binary())], ["sid", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = ([np.frombuffer(x, np.uint64) for x in as_bytes(batch.column(i))] for i in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    close = materialize(with_both(pairs.distinct(), first, "wide", "n").mapInArrow(near, "u long, v long"), "close")
    ends = close.select(F.col("u").alias("sid")).union(close.select("v")).distinct()
    wanted = materialize(first.select("sid", "doc_id", "th").join(ends, "sid").select("sid", F.xxhash64("doc_id", "th").alias("key"), "th"), "wanted")
    texts = docs.select(F.xxhash64("doc_id", "th").alias("key"), "th", "text").join(small(wanted), ["key", "th"]).select("sid", "text").dropDuplicates(["sid"])
    sets = materialize(texts.mapInArrow(whole, "sid long, own binary"), "sets")
    out = materialize(with_both(close, sets, "own").mapInArrow(check, "u long, v long"), "similar")
    discard(close, wanted, sets)
    return out


def fingerprint_stars(first: DataFrame) -> DataFrame:
    """u, v: sets that the tree links, as stars: each fingerprint's lowest set to that of the fingerprint it links to, and to the others that have the same."""
    prints = materialize(first.groupBy("fp").agg(F.min("sid").alias("low")), "prints")
    found = materialize(links(first.sparkSession, prints.select("fp")), "links")
    ends = prints.select(F.col("fp").alias("v"), F.col("low").alias("other"))
    across = found.join(prints.select(F.col("fp").alias("u"), "low"), "u").join(ends, "v").select(F.col("low").alias("u"), F.col("other").alias("v"))
    return across.unionByName(first.join(prints, "fp").where("sid <> low").select(F.col("low").alias("u"), F.col("sid").alias("v")))


def similar_groups(docs: DataFrame) -> DataFrame:
    """docs: doc_id, th (xxhash64 of text), text. doc_id, th, root for each row: rows of equal root are one group."""
    rows = materialize(digested(docs), "digests")
    # every set once, by one of its rows
    several = materialize(rows.groupBy("sid").agg(F.min("at").alias("first"), F.count("*").alias("rows")).where("rows > 1"), "several")
    copies = materialize(rows.select("at", "sid").join(small(several), "sid").where("at <> first").select("at"), "copies")
    first = rows.join(small(copies), "at", "left_anti")
    facts = first.select("sid", "n", *CUTS, *BITMAP)
    postings = first.select("sid", "prefix").mapInArrow(posted, "h long, sid long, place int")
    # written, here and below, so that Spark can split a common shingle's rows in the join
    ends = materialize(postings.groupBy("h").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high"), "ends")
    shared = materialize(postings.join(ends, "h").select("h", "sid", "place", "low"), "shared")

    # min_by of one number, so that Spark needs no sort; its lower half settles ties
    order = F.col("place").cast("long") * (1 << 32) + F.col("sid").bitwiseAND((1 << 32) - 1)
    middle = shared.groupBy("h").agg(F.min_by("sid", order).alias("middle"), F.count("*").alias("sets")).where("sets > 2").select("h", "middle")
    stars = shared.where("sid <> low").select(F.col("low").alias("u"), F.col("sid").alias("v")).unionByName(fingerprint_stars(first))
    stars = stars.unionByName(shared.join(middle, "h").where("sid <> middle").select(F.least("middle", "sid").alias("u"), F.greatest("middle", "sid").alias("v"))).distinct()
    stars = stars.join(facts.alias("a"), F.col("u") == F.col("a.sid")).join(facts.alias("b"), F.col("v") == F.col("b.sid")).where(possible("a", "b")).select("u", "v")
    similar = verified(stars, docs, first)

    roots = components(similar).withColumnRenamed("u", "sid")
    placed = shared.select("h", "sid", "place").join(small(roots), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ends = materialize(placed.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most"), "ends")
    rest = materialize(unshared(placed.join(ends, "h").drop("least", "most").join(facts, "sid")), "apart")
    may = reachable("a", "b") & possible("a", "b") & allowed("a", "b", unlike("a", "b")) & first_met("a", "b")
    pairs = rest.alias("a").join(rest.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.root") < F.col("b.root")) & may)
    more = verified(pairs.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")), docs, first)
    discard(shared, rest)

    roots = components(similar.union(more)).withColumnRenamed("u", "sid")
    return rows.select("doc_id", "th", "sid").join(roots, "sid", "left").select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def without_similar(docs: DataFrame) -> DataFrame:
    """docs, in their columns, with one row of each group of near copies: that with the smallest id, nulls last; of rows that repeat it, one.

    Texts are similar if the Jaccard similarity of their distinct five-word shingles is 0.8 or more, and in a group if
    a chain of similar texts joins them. A-Z is lower-cased, words are split at ASCII white space. Texts without a word,
    or null, are one group. Shingles are told apart by 64-bit hashes.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return one_of_each(docs, materialize(similar_groups(named), "groups"))
