"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    In each round every component that has a smaller neighbour points to its smallest one, pointers are
    followed to their ends by doubling, and links are relabelled, made distinct and dropped once both ends are in
    one component. A component that stays without taking in another has a smaller neighbour in the round after, so
    two rounds at least halve those of a connected part: rounds grow with the logarithm for any order of ids. Only
    the contracted links are left for the next round; links and labels stay distributed and are cut to files."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-links")
    ids = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(ids.withColumn("component", F.col("node")), "cc-labels")
    while not edges.isEmpty():
        step = _ends(cut(edges.groupBy("a").agg(F.min("b").alias("to")), "cc-step"))
        new = labels.join(step, labels.component == step.a, "left").select("node", F.coalesce("to", "component").alias("component"))
        one, two = step.select("a", F.col("to").alias("ta")), step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(one, "a").join(two, "b", "left").select(F.col("ta").alias("x"), F.coalesce("tb", "b").alias("y")).filter("x <> y")
        old = (labels, edges, step)
        labels = cut(new, "cc-labels")
        edges = cut(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc-links")
        for x in old:
            drop_cut(x)
    drop_cut(edges)
    return labels


def _ends(step: DataFrame) -> DataFrame:
    """Pointers (a, to), ``to`` below ``a``, led on to where no pointer starts; each pass doubles their reach."""
    while True:
        on = step.select(F.col("a").alias("mid"), F.col("to").alias("end"))
        both = step.join(on, F.col("to") == F.col("mid"), "left")
        if both.filter("mid is not null").isEmpty():
            return step
        longer = cut(both.select("a", F.coalesce("end", "to").alias("to")), "cc-step")
        drop_cut(step)
        step = longer
