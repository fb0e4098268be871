"""Connected components of an edge table by repeated contraction; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.plans.scratch import discard, materialize

#: Rounds after which the labels are written, so that their plan stays short.
WRITE_EVERY = 4


def _roots(parent: DataFrame) -> DataFrame:
    """(u, p) with p followed to the end of its path: pointers double until none moves, so paths of n steps take log n joins.

    Pointers go to smaller vertices only, hence never in a circle. The table that is given is deleted."""
    given = parent
    while True:
        # two doublings a table: the second one moves nothing where all paths have two steps or fewer
        for _ in range(2):
            up = parent.select(F.col("u").alias("u2"), F.col("p").alias("p2"))
            parent = parent.select("u", "p").join(up, F.col("p") == F.col("u2"), "left").select("u", F.coalesce("p2", "p").alias("p"), (F.col("p2") != F.col("p")).alias("moved"))
        last, parent = given, materialize(parent, "parents")
        discard(last)
        if parent.filter("moved").isEmpty():
            return parent
        given = parent


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp): comp is the smallest vertex reachable from v, for every vertex that has an edge.

    Each round every vertex points to its smallest neighbour (a pre-aggregated minimum, so hubs do no harm), pointers
    are followed to their ends, and the edges are rewritten to the vertices pointed to, until no edge is left.

    The vertices that stay are local minima. One that nothing points to has a neighbour that points to a smaller
    vertex, so it is no minimum in the next round and goes then; the others stand for two vertices at least. Two rounds
    thus halve the vertices at least: 2 log2 n rounds, whatever the order of the ids.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("w")).filter(F.col("u") != F.col("w"))
    live = materialize(both.union(both.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct(), "edges")
    labels, rounds, done = None, 0, []
    while not live.isEmpty():
        rounds += 1
        parent = live.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("p"))
        parent = _roots(materialize(parent, "parents"))
        if labels is None:
            labels = parent.select(F.col("u").alias("v"), F.col("p").alias("comp"))
        else:
            labels = labels.join(parent, F.col("comp") == F.col("u"), "left").select("v", F.coalesce("p", "comp").alias("comp"))
        done.append(parent)
        of_u, of_w = parent.select(F.col("u"), F.col("p").alias("pu")), parent.select(F.col("u").alias("w"), F.col("p").alias("pw"))
        read, live = live, materialize(
            live.join(of_u, "u").join(of_w, "w").filter(F.col("pu") != F.col("pw")).select(F.col("pu").alias("u"), F.col("pw").alias("w")).distinct(), "edges"
        )
        discard(read)
        if rounds % WRITE_EVERY == 0:
            labels = materialize(labels, "components")
            discard(*done)
            done = [labels]
    if labels is None:
        return live.select(F.col("u").alias("v"), F.col("w").alias("comp"))
    out = materialize(labels, "components")
    discard(live, *done)
    return out
