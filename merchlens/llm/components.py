"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.common import stored

EDGES = 1 << 16  # that a task takes at least


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): root is the component's smallest node.

    Union-find in rounds: each node takes the smallest root among its neighbours' and its own,
    then the root of that root. Roots only fall, so rounds end when none changes; paths halve
    each time. Every round is stored, so that a lost executor costs one round's reads. Few links
    are stored by few tasks: else each round writes as many tiny files as a shuffle has partitions.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    tasks = 1 + 2 * links.count() // EDGES
    edges = stored(edges.coalesce(tasks), "edges")
    roots = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")).coalesce(tasks), "roots")
    while True:
        offered = edges.join(roots, edges["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("offer"))
        hooked = roots.join(offered, roots["node"] == offered["a"]).select("node", "root", F.least("root", "offer").alias("near"))
        above = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = hooked.join(above, F.col("near") == F.col("_node"), "left").select(
            "node", F.least("near", F.coalesce("_root", "near")).alias("root"), F.col("root").alias("_old")
        )
        after = stored(jumped.select("node", "root", (F.col("root") < F.col("_old")).alias("moved")).coalesce(tasks), "roots")
        roots = after.select("node", "root")
        if not after.where("moved").head(1):
            return roots
