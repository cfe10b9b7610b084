"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are partitioned by Hamming distance: a tree of vantage points and
radii, built from a sample of bounded size, sends every fingerprint to a leaf. By the
triangle inequality a neighbour within RADIUS lies beyond a node's radius only if the
fingerprint is within RADIUS of that radius; then it visits the leaves there too. A leaf
that is still crowded gets a tree of its own, and so on. Within a leaf, distances to two
more vantage points bound which pairs are compared bit by bit; links are joined to groups
as they are found, so a leaf holds no list of pairs and yields a star for each group. The
stars are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, materialize, one_of_each, sliced, small
from attestra.llm.components import components

SHINGLE = 3
SEED = 42
#: Differing bits up to which fingerprints link.
RADIUS = 2
#: Fingerprints that a leaf should have, sampled ones among them, and the most that trees are built from at once (8 bytes each).
LEAF_ROWS, SAMPLE_EACH, SAMPLE_MOST = 32_768, 24, 1 << 18
#: Leaves that the tree of a crowded leaf has at least, if its sample tells them apart: with more crowded leaves than SAMPLE_MOST allows that for, trees are built for some of them at a time.
BRANCHES = 8
#: Fingerprints in a leaf, visitors among them, beyond which it gets a tree of its own.
LEAF_MOST = 1 << 20
#: Pairs compared at once, and links gathered before they are joined.
AT_ONCE, LINKS_AT_ONCE = 1 << 20, 1 << 18
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Bits set in more than half of the shingles' hashes; 0 without words. Unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(SHINGLE, len(words))
    start, end = start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(start), 1 << 14):
        ones += set_bits(np.array([digest(line[a:b], SEED) for a, b in zip(start[i : i + (1 << 14)], end[i : i + (1 << 14)], strict=True)], np.uint64))
    return majority(ones, len(start))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of up to 2**15 hashes have each bit set."""
    return np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)


def majority(ones: np.ndarray, n: int) -> int:
    return int(BITS[2 * ones > n].sum(dtype=np.uint64))


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column(2))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "th", "fp"])


class Tree:
    """Nodes: vantage point, radius, node for distances up to the radius, node for those beyond; a leaf is a negative number.

    A radius is the median of the sample's distances. On fingerprints of unlike texts any other radius has as many
    boundary visits for what it tells apart: measured on random ones, radii of the least boundary mass for their
    entropy gave 4.8 visits a fingerprint where medians gave 4.5.
    """

    def __init__(self, sample: np.ndarray, leaf_sample: int, seed: int = 8) -> None:
        self.vantage: list[np.uint64] = []
        self.radius: list[int] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.random = np.random.default_rng(seed)
        self.root = self.grown(sample, leaf_sample)

    def grown(self, sample: np.ndarray, leaf_sample: int) -> int:
        if len(sample) > leaf_sample:
            some = self.random.choice(sample, min(12, len(sample)), replace=False)
            distance = np.bitwise_count(some[:, None] ^ sample[None, :]).astype(np.int16)
            best = int(distance.std(axis=1).argmax())  # the point that tells the others apart best
            radius = int(np.median(distance[best]))
            inside = distance[best] <= radius
            if not inside.all():
                node = len(self.vantage)
                self.vantage.append(some[best])
                self.radius.append(radius)
                self.children.append([])
                self.children[node] = [self.grown(sample[inside], leaf_sample), self.grown(sample[~inside], leaf_sample)]
                return node
        self.leaves += 1
        return -self.leaves

    def routed(self, prints: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, positions in prints, whether it is their own leaf). A leaf is visited only from those before it, so each pair meets once. Visitors of the tree (own: the others) visit every leaf that they are near to."""
        own = np.ones(len(prints), bool) if own is None else own
        todo = [x for x in ((self.root, np.flatnonzero(own), True), (self.root, np.flatnonzero(~own), False)) if len(x[1])]
        while todo:
            node, at, own = todo.pop()
            if node < 0:
                yield -node, at, own
                continue
            distance = np.bitwise_count(prints[at] ^ self.vantage[node]).astype(np.int16)
            inside, outside = self.children[node]
            near, far = distance <= self.radius[node], distance > self.radius[node]
            reach = distance + RADIUS > self.radius[node]
            if own:
                todo += [(inside, at[near], True), (outside, at[far], True), (outside, at[near & reach], False)]
            else:
                todo += [(inside, at[distance - RADIUS <= self.radius[node]], False), (outside, at[reach], False)]
            todo = [x for x in todo if len(x[1])]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest node of each node's component, once links a - b are added. label: the same before."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(prints: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within RADIUS, one of them at least with own set, a block at a time. Only pairs whose distances to both vantage points allow it are compared."""
    cells, width = [], 65 + 2 * RADIUS
    for vantage in (prints[0], prints[len(prints) // 2]):
        cells.append(np.bitwise_count(prints ^ vantage).astype(np.int64) + RADIUS)
    cell = cells[0] * width + cells[1]
    order = np.argsort(cell, kind="stable")
    bounds = np.searchsorted(cell[order], np.arange(width * width + 1))
    mine = order[own[order]]
    for c in np.unique(cell[mine]).tolist():
        home = mine[np.searchsorted(cell[mine], c) : np.searchsorted(cell[mine], c, "right")]
        near = np.concatenate([order[bounds[x - RADIUS] : bounds[x + RADIUS + 1]] for x in range(c - RADIUS * width, c + RADIUS * width + 1, width)])
        for i in range(0, len(home), step := max(1, AT_ONCE // len(near))):
            x, y = np.nonzero(np.bitwise_count(prints[home[i : i + step], None] ^ prints[None, near]) <= RADIUS)
            x, y = home[i : i + step][x], near[y]
            some = x != y
            yield x[some], y[some]


def grouped(prints: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The lowest position of each fingerprint's group."""
    label, waiting, n = np.arange(len(prints)), [], 0
    for pair in linked(prints, own):
        waiting.append(pair)
        n += len(pair[0])
        if n > LINKS_AT_ONCE:
            label, waiting, n = joined(label, *map(np.concatenate, zip(*waiting, strict=True))), [], 0
    return joined(label, *map(np.concatenate, zip(*waiting, strict=True))) if waiting else label


def stars(table: pa.Table) -> pa.Table:
    """u, v: the fingerprints of a leaf that have company, with the lowest position of their group."""
    prints = table.column("fp").to_numpy().view(np.uint64)
    label = grouped(prints, table.column("own").to_numpy())
    (some,) = np.nonzero(label != np.arange(len(label)))
    return pa.table({"u": prints[some].view(np.int64), "v": prints[label[some]].view(np.int64)})


def leaves(prints: DataFrame) -> DataFrame:
    """leaf, fp, own: the leaf that each distinct fingerprint (fp) is at home in (own), and those that it visits.

    One level of trees after another, as long as a leaf has over LEAF_MOST rows; one that has 0.9 of its parent's or more (its
    fingerprints are all as far from any vantage point) stays as it is. Each crowded leaf has a sample of its own. The driver sees
    SAMPLE_MOST sampled fingerprints at once, and the numbers and sizes of crowded leaves, under a LEAF_MOST-th of the rows.
    """
    spark = prints.sparkSession
    rows, crowded, out = prints.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("own")), {0: prints.count()}, []
    for level in range(64):
        each = max(BRANCHES * SAMPLE_EACH, SAMPLE_MOST // len(crowded))
        at_once, names = max(1, SAMPLE_MOST // each), sorted(crowded)
        parent: dict[int, int] = {}
        passes, more = [], 0
        for begin in range(0, len(names), at_once):
            some = {x: min(1.0, SAMPLE_EACH / LEAF_ROWS, each / max(1, crowded[x])) for x in names[begin : begin + at_once]}
            shares = F.broadcast(spark.createDataFrame([(x, int(s * (1 << 40))) for x, s in some.items()], "leaf long, share long"))
            mine = rows.join(shares, "leaf")
            drawn = mine.where(F.pmod(F.xxhash64("fp", F.lit(level)), F.lit(1 << 40)) < F.col("share")).select("leaf", "fp").toArrow()
            leaf, fp = drawn.column("leaf").to_numpy(), drawn.column("fp").to_numpy().view(np.uint64)
            order = np.argsort(leaf, kind="stable")
            leaf, fp = leaf[order], fp[order]
            trees, first = {}, {}
            for x in some:
                trees[x] = Tree(np.sort(fp[np.searchsorted(leaf, x) : np.searchsorted(leaf, x, "right")]), SAMPLE_EACH)
                first[x] = (level << 32) + more
                parent |= dict.fromkeys(range(first[x] + 1, first[x] + trees[x].leaves + 1), x)
                more += trees[x].leaves
            shared = spark.sparkContext.broadcast((trees, first))

            def route(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                trees, first = shared.value
                for batch in batches:
                    leaf, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                    for x in np.unique(leaf).tolist():
                        (mine,) = np.nonzero(leaf == x)
                        for to, at, home in trees[x].routed(fp[mine].view(np.uint64), own[mine]):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first[x] + to)), pa.array(fp[mine[at]]), pa.array(np.full(len(at), home))], ["leaf", "fp", "own"])

            passes.append(materialize(mine.select("leaf", "fp", "own").mapInArrow(route, "leaf long, fp long, own boolean"), "leaves"))
        placed = reduce(DataFrame.unionByName, passes)
        found = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().where(F.col("count") > LEAF_MOST).collect()}
        crowded = {x: n for x, n in found.items() if n < 0.9 * crowded[parent[x]]}
        if not crowded:
            out.append(placed)
            break
        again = small(spark.createDataFrame([(x,) for x in crowded], "leaf long"))
        out.append(placed.join(again, "leaf", "left_anti"))
        rows = placed.join(again, "leaf", "left_semi")
    return reduce(DataFrame.unionByName, out)


def links(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """u, v: links that connect all distinct fingerprints (fp) within RADIUS of each other."""
    return leaves(prints).groupBy("leaf").applyInArrow(stars, "u long, v long")


def groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (a hash of the text), fp, root: rows of equal root are one group."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = materialize(named.mapInArrow(fingerprinted, "doc_id long, th long, fp long"), "fingerprints")
    prints = materialize(rows.select("fp").distinct(), "distinct")
    roots = components(links(docs.sparkSession, prints)).withColumnRenamed("u", "fp")
    return rows.join(roots, "fp", "left").select("doc_id", "th", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    A-Z is lower-cased and words are split at ASCII white space. Texts that are null or have no word have fingerprint
    zero and are linked like any other. Null ids are passed over for component_id, which is null where no member has
    an id. Repeated rows are rows of one group. Other columns are not looked at; an empty table gives an empty result.
    """
    rows = materialize(groups(docs, id_col, text_col), "groups")
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # written, so that Spark can split a large group's rows in the join
    return rows.join(small(least), "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs, in their columns, with one row of each group: that with the smallest id, nulls last; of rows that repeat it, one."""
    return one_of_each(docs, materialize(groups(docs, "doc_id", "text"), "groups"))
