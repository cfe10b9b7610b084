"""Names within a few edits of each other: keys of what two names share once the edits are left out.

Two names of one length within two edits are equal but in one place, but in two, or once each has lost a
code point. If one is longer by one, it is the other once it has lost a code point, but in one place perhaps; if by two,
once it has lost two. So a name's keys are hashes of itself with one or two places left open, with code points deleted,
or both, and near names share one: keys meet about as often as there are near names, however common their parts are.
Keys grow with the square of a name's length. Names above MASKED code points meet by their rarest grams instead: an edit
changes at most Q of these, so names within d edits share one of the first Q * d + 1 of each, in one order. The edit distance decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.tables import materialize, small

#: Code points of a gram, and of the longest names that meet by keys.
Q, MASKED = 2, 48
#: Signs before and behind a name, so that its ends are grams of their own.
BEGIN, END = "\x02", "\x03"
#: Keys that a task makes at once. Bits of the bitmap of wanted keys for each of these, and at most (a power of two).
KEYS_AT_ONCE, BITS_A_KEY, MOST_LG_BITS = 1 << 20, 16, 28
#: Kinds of keys: places left open in names of one length; one code point less in each; less of them in the name, as the longer one; or in the target.
OPEN, MOVED, LONGER, SHORTER = range(4)


def grams(name: Column) -> Column:
    """The distinct runs of Q code points of a name, its ends included."""
    padded = F.concat(F.lit(BEGIN * (Q - 1)), name, F.lit(END * (Q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) + Q - 1), lambda i: F.substring(padded, i, Q)))


def prefixes(names: DataFrame, frequency: DataFrame, edits: int) -> DataFrame:
    """names: name (distinct). name, mark: each name's rarest grams, of which two long names within ``edits`` share one."""
    own = names.select("name", F.explode(grams(F.col("name"))).alias("gram")).join(frequency, "gram", "left")
    first = own.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, Q * edits + 1).alias("first"))
    return first.select("name", F.explode(F.col("first.gram")).alias("mark"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def at(places: np.ndarray | int, codes: np.ndarray | int) -> np.ndarray:
    """A number for a code point at a place (0: left open); a text's hash is the sum of these."""
    return mixed((np.asarray(codes, np.uint64) + (np.asarray(places, np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def salted(kind: int, n: int, left: int) -> np.uint64:
    """Told apart by kind, the length of what is hashed, and the places left open."""
    return mixed(np.array([(kind + 1) << 48 | n << 8 | left], np.uint64) * np.uint64(0xD1342543DE82EF95))[0]


def deleted(codes: np.ndarray, i: int) -> np.ndarray:
    return np.delete(codes, i, axis=1)


def keys_of(codes: np.ndarray, edits: int, lengths: set[int], target: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """codes: names x code points, of one length. (kind, rows, key, and the code points in the places left open, or -1) of each kind of key, as the other side's lengths ask for them.

    Of a run of equal code points the first is deleted. In places left open the other name has to have other code points, so a pair meets at the number of places in which it differs.
    """
    m, n = codes.shape
    longer, shorter = (SHORTER, LONGER) if target else (LONGER, SHORTER)
    rows, none = np.arange(m), np.full(m, -1)

    def opened(c: np.ndarray, of: np.ndarray, kind: int, most: int) -> Iterator[tuple]:
        z = at(np.arange(c.shape[1]), c + np.uint64(1))
        whole = z.sum(axis=1, dtype=np.uint64)
        for left in range(1, min(most, c.shape[1]) + 1):
            for places in combinations(range(c.shape[1]), left):
                key = whole + salted(kind, c.shape[1], left)
                for p in places:
                    key = key - z[:, p] + at(p, 0)
                yield kind, of, key, c[:, places[0]].astype(np.int64), c[:, places[1]].astype(np.int64) if left == 2 else none[: len(of)]

    def closed(c: np.ndarray, of: np.ndarray, kind: int) -> tuple:
        key = at(np.arange(c.shape[1]), c + np.uint64(1)).sum(axis=1, dtype=np.uint64) + salted(kind, c.shape[1], 0)
        return kind, of, key, none[: len(of)], none[: len(of)]

    begins = [rows if i == 0 else rows[codes[:, i] != codes[:, i - 1]] for i in range(n)]
    if n in lengths:
        yield from opened(codes, rows, OPEN, edits)
        if edits == 2:
            for i in range(n):
                yield closed(deleted(codes[begins[i]], i), begins[i], MOVED)
    if n + 1 in lengths or edits == 2 and n + 2 in lengths:
        yield closed(codes, rows, shorter)
    if n + 1 in lengths and edits == 2:
        yield from opened(codes, rows, shorter, 1)
    if n - 1 in lengths:
        for i in range(n):
            less = deleted(codes[begins[i]], i)
            yield closed(less, begins[i], longer)
            if edits == 2:
                yield from opened(less, begins[i], longer, 1)
    if n - 2 in lengths and edits == 2:
        for i in range(n):
            for j in range(i + 1, n):
                yield closed(deleted(codes[begins[i]], [i, j]), begins[i], longer)


def key_count(n: int) -> int:
    """Keys of a name, about."""
    return 2 * n * n + 2


def lettered(names: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) of names of each length."""
    told = names.to_pylist()
    lengths = np.array([len(x) for x in told])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, KEYS_AT_ONCE // key_count(int(n)))
        for begin in range(0, len(rows), step):
            part = rows[begin : begin + step]
            codes = np.frombuffer("".join([told[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, codes.reshape(len(part), n).astype(np.uint64)


def bit_places(key: np.ndarray, lg: int) -> tuple[np.ndarray, np.ndarray]:
    return key >> np.uint64(64 - lg), (key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - lg)


def keyed(edits: int, lengths: set[int], wanted: Callable[[], tuple[np.ndarray, int]] | None = None) -> Callable:
    """For mapInArrow over name: kind, key, one, two (code points in the places left open), name. Of targets all keys, of names those in the bitmap of these."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for rows, codes in lettered(names):
                parts = []
                for kind, of, key, one, two in keys_of(codes, edits, lengths, wanted is None):
                    if wanted is not None:
                        bitmap, lg = wanted()
                        hit = np.ones(len(key), bool)
                        for place in bit_places(key, lg):
                            hit &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        of, key, one, two = of[hit], key[hit], one[hit], two[hit]
                    if len(key):
                        parts.append((np.full(len(key), kind, np.int32), key.view(np.int64), one.astype(np.int32), two.astype(np.int32), rows[of]))
                if parts:
                    kind, key, one, two, of = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(one), pa.array(two), names.take(pa.array(of))], ["kind", "key", "one", "two", "name"])

    return keys


KEYED = "kind int, key long, one int, two int, name string"


def bitmap_of(keys: DataFrame) -> tuple[np.ndarray, int]:
    """keys: key, written. A bitmap that has two bits of each key, and the logarithm of its size: 32 MB at most, whatever the number of keys. Tasks return the bytes that aren't zero."""
    lg = min(MOST_LG_BITS, max(10, (keys.count() * BITS_A_KEY - 1).bit_length()))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (lg - 3), np.uint8)
        for batch in batches:
            for place in bit_places(batch.column(0).to_numpy().view(np.uint64), lg):
                np.bitwise_or.at(own, place >> np.uint64(3), np.left_shift(1, place & np.uint64(7)).astype(np.uint8))
        for block in range(0, len(own), 1 << 16):
            if own[block : block + (1 << 16)].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bits": pa.array([own[block : block + (1 << 16)].tobytes()], pa.binary())})

    out = np.zeros(1 << (lg - 3), np.uint8)
    for row in keys.select("key").coalesce(4).mapInArrow(bytes_of, "block long, bits binary").toLocalIterator():
        out[row.block : row.block + len(row.bits)] |= np.frombuffer(row.bits, np.uint8)
    return out, lg


def differing(a: Column, b: Column) -> Column:
    """In how many places two names of one length differ."""
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int"))


def by_keys(names: DataFrame, targets: DataFrame, edits: int) -> DataFrame:
    """names and targets: name (distinct), written. target, name: the pairs that may be near of which the target has up to MASKED code points. Names of one length that differ in one or two places meet once, and are most; the others may meet several times."""
    spark = names.sparkSession
    names, targets = names.where(F.length("name") <= MASKED + edits), targets.where(F.length("name") <= MASKED)
    theirs, own = ({r.n for r in df.select(F.length("name").alias("n")).distinct().collect()} for df in (names, targets))  # MASKED + 3 at most
    wanted = materialize(targets.mapInArrow(keyed(edits, theirs), KEYED).withColumnRenamed("name", "target"), "wanted-keys")
    shared = spark.sparkContext.broadcast(bitmap_of(wanted))
    found = names.mapInArrow(keyed(edits, own, lambda: shared.value), KEYED)
    other = lambda c: (F.col(c) == -1) | (F.col(c) != F.col(f"{c}__"))  # noqa: E731  both or neither are left open
    wanted = wanted.withColumnsRenamed({"one": "one__", "two": "two__"})
    pairs = found.join(wanted, ["kind", "key"]).where(other("one") & other("two") & (F.col("target") != F.col("name")))
    opened = pairs.where(F.col("kind") == OPEN).select("target", "name")
    rest = pairs.where(F.col("kind").isin(LONGER, SHORTER) | (F.col("kind") == MOVED) & (differing(F.col("target"), F.col("name")) > edits)).select("target", "name").distinct()
    return opened.unionByName(rest)


def by_grams(names: DataFrame, targets: DataFrame, edits: int) -> DataFrame:
    """names and targets: name (distinct), written. target, name: the pairs that may be near of which the target has over MASKED code points."""
    names, targets = names.where(F.length("name") > MASKED - edits), targets.where(F.length("name") > MASKED)
    frequency = small(materialize(names.select(F.explode(grams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "grams"))
    all_marks = prefixes(names, frequency, edits)
    wanted = prefixes(targets, frequency, edits).withColumnRenamed("name", "target")
    near = F.abs(F.length("target") - F.length("name")) <= edits
    return wanted.join(all_marks, "mark").where((F.col("target") != F.col("name")) & near).select("target", "name").distinct()


def near_names(names: DataFrame, targets: DataFrame, edits: int = 2) -> DataFrame:
    """names and targets: name. name (of a target), other, distance: all pairs of different names within ``edits`` insertions, deletions or replacements.

    Each distinct name counts once; null names have no pairs. Up to two edits. Candidates are those that share a key (of names above MASKED
    code points, one of their Q * edits + 1 rarest grams); of all names' keys, only those that a bitmap of the targets' keys has are shuffled.
    """
    if not 1 <= edits <= 2:
        raise ValueError("names meet within one or two edits")
    names, targets = (materialize(df.select("name").where("name IS NOT NULL").distinct(), "names") for df in (names, targets))
    pairs = by_keys(names, targets, edits)
    if not targets.where(F.length("name") > MASKED).isEmpty():
        pairs = pairs.unionByName(by_grams(names, targets, edits))
    found = pairs.withColumn("distance", F.levenshtein("target", "name", edits).cast("long")).where("distance >= 0")
    return found.select(F.col("target").alias("name"), F.col("name").alias("other"), "distance")
