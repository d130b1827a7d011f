"""Connected components by contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node.

    Each round every node moves to the neighbour (or itself) of least seeded hash, and
    links between moved nodes are kept; about half the nodes are left.  Minima and
    distinct links use partial aggregation, joins on a hub can be split by AQE, and each
    round starts from files.  No edges: no rows.
    """
    now = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "cc-edges")
    both = now.select("a").unionAll(now.select("b")).distinct()
    home = both.select(F.col("a").alias("node"), F.col("a").alias("at"))
    r = 0
    while now.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        near = now.select("a", order("b").alias("x")).unionAll(now.select(F.col("b"), order("a"))).unionAll(now.select("a", order("a"))).unionAll(now.select("b", order("b")))
        move = stage(near.groupBy("a").agg(F.min("x")["id"].alias("to")).withColumnRenamed("a", "old"), f"cc-move-{r}")
        home = stage(home.join(move, home["at"] == move["old"], "left").select("node", F.coalesce("to", "at").alias("at")), f"cc-home-{r}")
        next_ = now.join(move, now["a"] == move["old"]).select(F.col("to").alias("a"), "b")
        next_ = next_.join(move, next_["b"] == move["old"]).select("a", F.col("to").alias("b")).filter("a <> b")
        now = stage(next_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"cc-edges-{r}")
        r += 1
    least = home.groupBy("at").agg(F.min("node").alias("component"))
    return home.join(least, "at").select("node", "component")
