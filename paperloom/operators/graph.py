"""Connected components by alternating large-star and small-star steps; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch


def kept(df: DataFrame, name: str, fold: int = 8) -> DataFrame:
    """The frame as Parquet in the shared folder; ``fold`` shuffle partitions share a file, for results that are small."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // fold)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge upwards or only edges that lead to it: then b is a's component."""
    ends = edges.selectExpr("a AS x", "1 AS up", "0 AS down").union(edges.selectExpr("b AS x", "0 AS up", "1 AS down"))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of the edges (a, b) reaches. Nulls and loops are left out.

    Minima are partial sums before the shuffle and are joined back, so the neighbours of a node never meet in one row.
    """
    edges = kept(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    while not is_forest_of_stars(edges):
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").selectExpr("b AS a", "m AS b")
        large = large.union(least.filter("a != m").selectExpr("a", "m AS b")).distinct()
        # now every edge leads to a smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b")).distinct()
        edges = kept(small, "edges")
    return edges.selectExpr("a AS id", "b AS component").union(edges.selectExpr("b AS id", "b AS component").distinct())
