"""History sampling and replay over ordered points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut


def even_sample(points: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """At most n rows spread evenly over the order, first and last included.

    Position i of n takes the row nearest to i * (rows - 1) / (n - 1), halves to
    the even row; rows that come up twice are taken once; n <= 1 takes the last.
    Positions are numbered per range of the order, so no task holds all rows.
    """
    total = points.count()
    if total == 0 or n <= 0:
        return points.limit(0)
    at = numbered(points, order)
    if n == 1:
        return at.where(F.col("at") == total - 1).drop("at")
    if n >= total:
        return at.drop("at")
    i = F.sequence(F.lit(0), F.lit(n - 1))
    wanted = points.sparkSession.range(1).select(F.explode(F.transform(i, lambda k: F.bround(k * F.lit(float(total - 1)) / F.lit(float(n - 1)), 0).cast("long"))).alias("at")).distinct()
    return at.join(F.broadcast(wanted), "at", "left_semi").drop("at")  # n positions


def numbered(points: DataFrame, order: str) -> DataFrame:
    """points with `at`, the position from 0, by range partitions and their offsets."""
    spread = points.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    spread = cut(spread)
    sizes = spread.groupBy("__p").count()
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))  # a row for each partition
    inside = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    return inside.join(F.broadcast(before), "__p").withColumn("at", F.col("__before") + F.col("__n")).drop("__p", "__before", "__n")


def replay(points: DataFrame, rise: float = 1e-9) -> DataFrame:
    """(key, seq, ratio, before, flagged) over measured points (key, seq, ratio): did the ratio rise.

    Unmeasured points (null ratio) are taken out first, so a rise is seen
    against the last measured point.
    """
    order = Window.partitionBy("key").orderBy("seq")
    out = points.where("ratio is not null").withColumn("before", F.lag("ratio").over(order))
    return out.withColumn("flagged", F.coalesce(F.col("ratio") > F.col("before") + rise, F.lit(False)))


def replay_gated(points: DataFrame, volatility: DataFrame, frozen: float = 0.05, rise: float = 1e-9) -> DataFrame:
    """(key, seq, newly, flagged, gated, suppressed): flags that only moving members hold up.

    points is (key, seq, ratio, members), volatility (key, id, volatility). A
    flag stays when some newly cyclic member moves more than `frozen`; else it is
    suppressed as `denominator-shift` (nothing newly cyclic) or `all-frozen`.
    Members without a volatility count as frozen.
    """
    order = Window.partitionBy("key").orderBy("seq")
    p = points.where("ratio is not null").withColumn("before", F.lag("ratio").over(order)).withColumn("old", F.lag("members").over(order))
    p = p.withColumn("flagged", F.coalesce(F.col("ratio") > F.col("before") + rise, F.lit(False)))
    newly = F.array_except("members", F.coalesce("old", F.array().cast("array<string>")))
    p = p.withColumn("newly", F.when(F.col("old").isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(newly)))
    each = p.select("key", "seq", F.explode("newly").alias("id")).join(volatility, ["key", "id"]).groupBy("key", "seq").agg(F.max("volatility").alias("moves"))
    both = p.join(each, ["key", "seq"], "left")
    moving = F.coalesce(F.col("moves") > frozen, F.lit(False))
    kind = F.when(F.col("flagged") & ~moving, F.when(F.size("newly") == 0, "denominator-shift").otherwise("all-frozen"))
    return both.select("key", "seq", "newly", "flagged", (F.col("flagged") & moving).alias("gated"), kind.alias("suppressed"))


def volatility_of(touches: DataFrame, group: list[str]) -> DataFrame:
    """(group..., item, volatility): changes of an item over those of the most changed one."""
    n = touches.groupBy(*group, "item").agg(F.count("*").alias("n"))
    top = n.groupBy(*group).agg(F.max("n").alias("top")) if group else n.agg(F.max("n").alias("top"))
    both = n.join(F.broadcast(top)) if not group else n.join(top, group)
    return both.select(*group, "item", (F.col("n").cast("double") / F.col("top")).alias("volatility"))
