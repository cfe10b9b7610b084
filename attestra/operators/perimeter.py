"""The perimeter of a group: all that a company holds, over any number of levels, cycles included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.tables import discard, materialize


def perimeter(edges: DataFrame, roots: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """edges: parent, child, share (0 to 1). root, corp, level, share: each company that a root (all parents, or those given: root) holds.

    level: the fewest edges to it; share: the largest product of shares along a way there (each step times the next, from the
    root on), so that a cycle, which never adds to a product, ends by itself. No company is in its own perimeter. A null share is unknown and
    counts as 0; shares beyond 0 to 1 are taken as the nearer of them; parallel edges count as the largest. Edges without a parent or child are left out. depth: levels at most;
    a share is then the best of ways that short.

    Semi-naive: only what is new or has a larger share goes one step further, until nothing is. A company with many
    holdings is a hot key of an ordinary join of written tables, which adaptive execution splits.
    """
    known_share = F.least(F.greatest(F.coalesce(F.col("share").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    edges = edges.where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").groupBy("parent", "child").agg(F.max(known_share).alias("part"))
    edges = materialize(edges, "holdings")
    first = edges if roots is None else edges.join(roots.select(F.col("root").alias("parent")).distinct(), "parent", "left_semi")
    found = [materialize(first.select(F.col("parent").alias("root"), F.col("child").alias("corp"), F.lit(1).cast("long").alias("level"), F.col("part").alias("share")), "perimeter")]
    best = (F.min("level").alias("level"), F.max("share").alias("share"))
    level = 1
    while depth is None or level < depth:
        level += 1
        step = found[-1].select("root", F.col("corp").alias("parent"), "share").join(edges, "parent").where("child <> root")
        step = step.groupBy("root", F.col("child").alias("corp")).agg(F.max(F.col("share") * F.col("part")).alias("new"))
        known = reduce(DataFrame.unionByName, found).groupBy("root", "corp").agg(*best)
        more = step.join(known, ["root", "corp"], "left").where("share IS NULL OR new > share")
        more = materialize(more.select("root", "corp", F.coalesce("level", F.lit(level)).cast("long").alias("level"), F.col("new").alias("share")), "perimeter")
        if more.isEmpty():
            discard(more)
            break
        found.append(more)
    return reduce(DataFrame.unionByName, found).groupBy("root", "corp").agg(*best)
