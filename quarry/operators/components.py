"""Connected components by alternating large-star and small-star.

Every round rewrites the edge list (Kiveris et al., "Connected Components
in MapReduce and Beyond"): large-star hangs each node's larger neighbours
on its smallest neighbour, small-star hangs the smaller ones on it.  Both
keep the components unchanged, and together they end in a star forest whose
centres are the smallest ids, after O(log^2 n) rounds.  The loop ends only
when the edges *are* a star forest; there is no round count after which an
unfinished answer is returned.

A hub is never gathered: the smallest neighbour is a map-side combined
``min``, and the edges meet it in a plain join that AQE can split.  Each
round is checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint

# Far above the O(log^2 n) bound for any table; reaching it is an error.
SAFETY_ROUNDS = 500


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (edges.join(least, "a").where(F.col("b") != F.col("m"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    roles = (edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
             .union(edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
             .groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")))
    return roles.where((F.col("child") > 1) | ((F.col("child") == 1) & (F.col("parent") == 1))).isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """(id, root) for every node that has an edge to another node and is not
    its component's smallest id.  ``edges`` has ``src`` and ``dst``; nulls
    and self-loops link nothing; repeated edges count once."""
    cur = (edges.where(F.col("src") != F.col("dst"))
           .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    cur = reliable_checkpoint(cur)
    for _ in range(SAFETY_ROUNDS):
        if _is_star_forest(cur):
            return cur.select(F.col("a").alias("id"), F.col("b").alias("root"))
        cur = reliable_checkpoint(_small_star(_large_star(cur)))
    raise RuntimeError(f"connected components not finished after {SAFETY_ROUNDS} rounds")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): smallest id of each vertex's component, itself included."""
    forest = star_forest(edges)
    return (vertices.select("id").join(forest, "id", "left")
            .select("id", F.coalesce("root", "id").alias("root")))
