"""Walks over links between sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept


#: Rounds whose frontiers stay tables of their own before they are written together.
MERGE = 16


def walk(seeds: DataFrame, edges: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """GW: node and depth of all that is reached from the seeds. Only open nodes lead on. edges: a, b. seeds, open_nodes: node.

    Links that can lead on are found once; equal ones stay, as what a round reaches is made distinct anyway and a table of all links takes memory. A round joins the frontier alone and writes it to the shared folder; every MERGE rounds the frontiers become one
    table, so a visited node is written twice or so, not once a round.
    """
    leads = kept(edges.join(open_nodes.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"), "links")
    frontier = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    older, rounds, depth = None, [frontier], 0
    together = lambda: reduce(DataFrame.unionByName, ([older] if older is not None else []) + rounds)
    while True:
        depth += 1
        reached = frontier.select(F.col("node").alias("a")).join(leads, "a").select(F.col("b").alias("node")).distinct()
        frontier = kept(reached.join(together().select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return together()
        rounds.append(frontier)
        if len(rounds) == MERGE:
            older, rounds = kept(together(), "visited"), []
