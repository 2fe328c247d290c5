"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (x, y): root is the smallest node that can be reached.

    Each round, a node takes the smallest root among its own and its neighbours', and then that root's root, so chains
    shorten by halves.  Every round is written to the shared folder; only a count comes back to the driver.
    """
    both = cut(links.where("x <> y").select("x", "y").union(links.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    roots = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")))
    while True:
        met = both.join(roots.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(met, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        above = roots.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        step = cut(least.join(above, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("root")))
        if step.where("old <> root").limit(1).count() == 0:
            return step.select("node", "root")
        roots = step.select("node", "root")
