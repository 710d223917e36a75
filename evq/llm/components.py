"""Connected components of an edge list as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import written


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``(a, b)`` long edges; the root is the smallest id of the component.

    Alternates the large-star and small-star steps, which turn any graph into stars around its smallest nodes in a
    logarithmic number of rounds. Each round is two joins with aggregated minima, written to the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("_e"))
        after = written(small.select("_e.a", "_e.b").where("a <> b").distinct(), "edges")
        moved = after.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(after, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if not moved:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
