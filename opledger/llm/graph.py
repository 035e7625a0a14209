"""Connected components of an edge table, by contraction; nothing but counts of rows reaches the driver.

Edge cases: loops, repeated edges and edges with a null end make no difference;
without an edge between two nodes the result is empty; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kept


def _roots(step: DataFrame) -> DataFrame:
    """node, name with every name replaced by the end of its chain: chains halve with each join, so a path of n takes log n."""
    while True:
        further = step.select(F.col("node").alias("name"), F.col("name").alias("next"))
        jumped = kept(step.join(further, "name", "left").select("node", F.coalesce("next", "name").alias("name"), (F.col("next") < F.col("name")).alias("moved")), "names")
        done = jumped.filter("moved").isEmpty()
        discard(step)
        step = kept_select(jumped, "node", "name")
        if done:
            return step


def kept_select(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a kept table, still known as kept."""
    out = df.select(*columns)
    out.kept_path = df.kept_path
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of the edges (a, b); a component has the name of one of its nodes.

    Each round names every node after its least neighbour or itself, follows the
    names to their ends and joins nodes of one name, until no edge is left between
    two names.  A node that a round leaves alone has lower names all around it and
    is joined in the next, so rounds are logarithmic.  Hot nodes only meet partial
    aggregates and joins that may be split.
    """
    rest = kept(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    names = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = _roots(kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("name")), "names"))
        if names is None:
            now = kept(step.select("node", F.col("name").alias("component")), "components")
        else:
            further = step.select(F.col("node").alias("component"), "name")
            now = kept(names.join(further, "component", "left").select("node", F.coalesce("name", "component").alias("component")), "components")
            discard(names)
        names = now
        left = step.select(F.col("node").alias("a"), F.col("name").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("name").alias("y"))
        met = rest.join(left, "a").join(right, "b").filter("x <> y")
        fewer = kept(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(rest, step)
        rest = fewer
    if names is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names
