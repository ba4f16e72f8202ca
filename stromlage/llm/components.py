"""Connected components by distributed union-find: alternating star contraction.

Every pass hangs all larger neighbours of a node on its smallest neighbour
(large star), then all smaller ones (small star), until each component is one
star around its smallest node. Only built-in joins and minima; a node with very
many neighbours is aggregated before the shuffle, and its join may be split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.session import stage


def _mark(pairs: DataFrame) -> tuple[int, int | None]:
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return row["n"], row["x"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; the component is its smallest node.

    Links may repeat, in either direction; loops and nulls are left out. The
    result is staged.
    """
    least, most = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    pairs = stage(
        links.where(F.col(a) != F.col(b)).select(most.alias("u"), least.alias("v")).distinct(), "links"
    )
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")
        ).select("p.u", "p.v").where(F.col("u") != F.col("v")).distinct()
        pairs = stage(small, "links")
        before, mark = mark, _mark(pairs)
        if before == mark:
            break
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after ``links`` (a, b) between components. Staged.

    A node that ``found`` lacks is a component of its own name. Only the links
    between components are gone through again.
    """
    merged = components(links)
    moved = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    known = moved.select("node", F.coalesce("_to", "component").alias("component"))
    new = merged.join(found.select("node"), "node", "left_anti")
    return stage(known.unionByName(new), "components")
