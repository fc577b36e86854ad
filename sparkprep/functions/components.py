"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); nodes should be digests, so that long chains have a random order.

    In a round each node joins the least node next to it, and links become those between
    the joined nodes; a share of all nodes is gone each time. The rounds' joins are then followed back.
    """
    open_links = durable(links.select("a", "b").where("a != b").distinct())
    rounds: list[DataFrame] = []
    while not open_links.isEmpty():
        ends = open_links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        joins = durable(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("joined")))
        rounds.append(joins)
        a, b = joins.toDF("a", "ja"), joins.toDF("b", "jb")
        open_links = durable(open_links.join(a, "a").join(b, "b").where("ja != jb").select(F.least("ja", "jb").alias("a"), F.greatest("ja", "jb").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = rounds[-1].toDF("node", "component")
    for joins in reversed(rounds[:-1]):
        found = joins.join(found.toDF("joined", "end"), "joined", "left").select("node", F.coalesce("end", "joined").alias("component"))
    return found
