"""Connected components by alternating large-star and small-star steps over written edge tables.

Least neighbours are written before they are joined, so that adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import written

#: Edges of a file of the tables between two steps, and the least number of files.
FILE_ROWS, LEAST_FILES = 50_000, 12


def large_star(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """The new edges, and the written table that they are read through."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(files), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), least


def small_star(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), least


def open_ends(edges: DataFrame) -> tuple[int, int]:
    """Rows of edges (u > v), and how many nodes have two lower neighbours or lie between two others: none in closed stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    rows, left = nodes.agg(F.sum("up"), F.count(F.when((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)), 1))).first()
    return rows or 0, left


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges (u, v) that is no root itself; nodes without edges don't occur.

    Null ends and loops are no edges; repeated edges count once; no edges give no rows.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows, left = open_ends(now)
    while left:
        files = max(LEAST_FILES, -(-rows // FILE_ROWS))
        large, least = large_star(now, files)
        small, lower = small_star(large, files)
        now = written(small.coalesce(files), "edges", now, least, lower)
        rows, left = open_ends(now)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.written_at = now.written_at
    return out
