"""Co-change analysis over baskets (basket, item): which items change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import ratio


def pair_counts(touches: DataFrame) -> DataFrame:
    """(a, b, co, na, nb, jaccard), a < b: baskets with both, with each, and their Jaccard similarity.

    Repeats in a basket count once. The pairs of a basket grow with the square
    of its size, as the measure demands; counts are summed before any shuffle.
    Dealt by basket once, the rows serve the distinct and both sides of the join.
    """
    t = touches.select("basket", "item").where("basket is not null and item is not null").repartition("basket").distinct()
    sizes = t.groupBy("item").agg(F.count("*").alias("n"))
    a, b = t.select("basket", F.col("item").alias("a")), t.select("basket", F.col("item").alias("b"))
    co = a.join(b, "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co"))
    both = co.join(sizes.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "co", "na", "nb", ratio(F.col("co"), F.col("na") + F.col("nb") - F.col("co")).alias("jaccard"))


def hidden_coupling(pairs: DataFrame, static_edges: DataFrame, least: float = 0.25, least_co: int = 3) -> DataFrame:
    """Pairs that change together although no static edge (src, dst) joins them, either way."""
    known = static_edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.where((F.col("co") >= least_co) & (F.col("jaccard") >= least)).join(known, ["a", "b"], "left_anti")


def merge_candidates(pairs: DataFrame, static_edges: DataFrame, least: float = 0.5, least_co: int = 3) -> DataFrame:
    """Pairs that nearly always change together, with whether an edge links them."""
    known = static_edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("linked", F.lit(True))
    strong = pairs.where((F.col("co") >= least_co) & (F.col("jaccard") >= least))
    return strong.join(known, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def blast(touches: DataFrame, wide: int = 5) -> DataFrame:
    """One row: baskets, mean and largest number of items, baskets with more than `wide`."""
    sizes = touches.select("basket", "item").repartition("basket").distinct().groupBy("basket").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("baskets"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_blast"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_blast"),
        F.count_if(F.col("n") > wide).alias("wide_baskets"),
    )


def locality(a_module, b_module, a_package, b_package):
    """1 inside a module, 2 inside a package, 3 across."""
    return F.when(a_module == b_module, 1).when(a_package == b_package, 2).otherwise(3)


def cluster_cochange(members: DataFrame, touches: DataFrame) -> DataFrame:
    """(cluster, n_pairs, max_jaccard, mean_jaccard) over the member pairs of clusters (cluster, item).

    Member pairs that never met count with similarity 0: they are counted, not
    listed. Baskets are split by cluster before their pairs are formed, so pairs
    across clusters aren't formed either.
    """
    m = members.select("cluster", "item").where("cluster is not null and item is not null").distinct()
    t = touches.select("basket", "item").where("basket is not null and item is not null").repartition("basket").distinct()
    sized = m.join(t.groupBy("item").agg(F.count("*").alias("n")), "item")
    own = t.join(sized, "item").repartition("basket", "cluster")
    side = lambda s: own.select("basket", "cluster", F.col("item").alias(s), F.col("n").alias(f"n{s}"))
    met = side("a").join(side("b"), ["basket", "cluster"]).where("a < b").groupBy("cluster", "a", "b", "na", "nb").agg(F.count("*").alias("co"))
    score = ratio(F.col("co"), F.col("na") + F.col("nb") - F.col("co"))
    some = met.groupBy("cluster").agg(F.max(score).alias("top"), F.sum(score).alias("whole"))
    sizes = m.groupBy("cluster").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("n_pairs")).where("n_pairs > 0")
    both = sizes.join(some, "cluster", "left").na.fill(0.0, ["top", "whole"])
    return both.select("cluster", "n_pairs", F.col("top").alias("max_jaccard"), (F.col("whole") / F.col("n_pairs")).alias("mean_jaccard"))


def shared_kernel(uses: DataFrame, least_consumers: int = 2) -> DataFrame:
    """(symbol, consumers): symbols that two or more consumers (symbol, consumer) use."""
    u = uses.select("symbol", "consumer").repartition("symbol").distinct()
    return u.groupBy("symbol").agg(F.count("*").alias("consumers")).where(F.col("consumers") >= least_consumers)


def consumer_pairs(uses: DataFrame) -> DataFrame:
    """(a, b, shared): consumers that share symbols, and how many."""
    u = uses.select("symbol", "consumer").repartition("symbol").distinct()
    pairs = u.select("symbol", F.col("consumer").alias("a")).join(u.select("symbol", F.col("consumer").alias("b")), "symbol").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
