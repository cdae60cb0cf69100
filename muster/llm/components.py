"""Connected components of a table of links, by rounds of joins and aggregates.

Every round each vertex takes the least vertex among itself and its neighbours, and links are redrawn between
what was taken; chains shrink with each round and the loop ends when no link is left. Links, vertices and roots
stay distributed: a round keeps two tables in the shared folder, which shrink as components grow together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.tables import kept


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (a, b): the least vertex reachable from it. Vertices are bigint."""
    links = kept(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        taken = kept(taken, "taken")
        redrawn = (
            links.join(taken.select("a", F.col("to").alias("x")), "a")
            .join(taken.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if roots is None:
            roots = taken.select(F.col("a").alias("v"), F.col("to").alias("root"))
        else:
            onward = taken.select(F.col("a").alias("root"), "to")
            roots = kept(roots.join(onward, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "roots")
        links = kept(redrawn, "links")
    if roots is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots
