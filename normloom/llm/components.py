"""Connected components by alternating large-star and small-star steps.

Only edges are kept, never more than there were at first; each round is cut
from its lineage in the shared folder, so a lost executor costs one round.  The
joins are not broadcast, since each round's would pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.llm.common import cut

#: Tasks among which the edges of one node are dealt in a large star.
SALTS = 16


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node to the least of its neighbours and itself; a hub's edges go to SALTS tasks."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    parts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    larger = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return larger.join(parts.hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, to the least of them; after a large star these are few."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # the edge to the least stays, the others lead from it
    return edges.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v) that is not its component's least node.

    Null ends, loops and repeated edges do not matter; without edges the result
    is empty.
    """
    state, mark = cut(_tidy(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna())), None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark or not now["n"]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (now["n"], now["h"])
        state = cut(_tidy(_small_star(_tidy(_large_star(state)))))
