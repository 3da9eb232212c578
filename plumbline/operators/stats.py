"""Votes, agreement, correlation, rank AUC and composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut


def votes(ballots: DataFrame, quorum: int, none: str = "NONE") -> DataFrame:
    """(item, top, votes, trials, status): CLEARED if a named pattern has the quorum, else SURFACE.

    A failed trial (null match) is a vote for NONE. Ties go to the smaller name;
    votes are summed before anything is ranked.
    """
    n = ballots.groupBy("item", F.coalesce("match", F.lit(none)).alias("match")).agg(F.count("*").alias("n"))
    first = n.groupBy("item").agg(F.min(F.struct((-F.col("n")).alias("less"), "match")).alias("best"), F.sum("n").alias("trials"))
    cleared = (F.col("best.match") != none) & (-F.col("best.less") >= quorum)
    return first.select("item", F.col("best.match").alias("top"), (-F.col("best.less")).alias("votes"), "trials", F.when(cleared, "CLEARED").otherwise("SURFACE").alias("status"))


def agreement(ballots: DataFrame) -> DataFrame:
    """(item, majority, pairwise): share of the largest vote, and of agreeing pairs of trials (null below two)."""
    n = ballots.groupBy("item", "match").agg(F.count("*").alias("n"))
    sums = n.groupBy("item").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    whole = F.col("all").cast("double")
    return sums.select("item", (F.col("top") / whole).alias("majority"), F.when(F.col("all") >= 2, F.col("same") / (whole * (whole - 1))).alias("pairwise"))


def violations(reports: DataFrame, quorum: int) -> DataFrame:
    """(violation, n): reported by `quorum` trials or more."""
    return reports.select("violation", "trial").distinct().groupBy("violation").agg(F.count("*").alias("n")).where(F.col("n") >= quorum)


def pearson(points: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., n, r): correlation, null below three points or without variance. Sums are exact decimals."""
    dec = lambda c: c.cast("decimal(18,4)")
    a, b = dec(F.col(x)), dec(F.col(y))
    s = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(a).cast("double").alias("sx"), F.sum(b).cast("double").alias("sy"),
        F.sum(a * a).cast("double").alias("sxx"), F.sum(b * b).cast("double").alias("syy"), F.sum(a * b).cast("double").alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return s.select(*by, "n", F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), r).alias("r"))


def rank_auc(scores: DataFrame) -> DataFrame:
    """One row (positives, negatives, wins2, auc) over (score, positive): share of pairs in order, ties half.

    Scores are counted by value and the negatives below each value summed over
    range partitions, so neither pairs are formed nor one task holds all values.
    wins2 counts a win twice and a tie once.
    """
    by = scores.where("score is not null and positive is not null").groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    by = cut(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = by.groupBy("part").agg(F.sum("q").alias("q"))
    before = parts.select("part", (F.sum("q").over(Window.orderBy("part")) - F.col("q")).alias("before"))  # a row for each partition
    inside = F.sum("q").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    below = by.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part")
    wins = F.sum(F.col("p") * (2 * (F.col("inside") + F.col("before")) + F.col("q")))
    out = below.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("q"), F.lit(0)).alias("negatives"), F.coalesce(wins, F.lit(0)).alias("wins2"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.withColumn("auc", F.when(pairs > 0, F.col("wins2") / (2 * pairs)))


def modularity_score(density: Column, fan_in_ratio: Column, cycle_ratio: Column, largest_ratio: Column, variation: Column) -> dict[str, Column]:
    """mod, hier, cons and mmi (0 to 10) of a graph.

    mod: few edges for each module and no module that all others use. hier: few
    modules on cycles and no large one. cons: modules of like instability.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    # The weights of the parts.
    mod = clamp(1 - density / 5.0) * 0.6 + clamp(1 - fan_in_ratio) * 0.4
    hier = clamp(1 - cycle_ratio) * 0.7 + clamp(1 - largest_ratio) * 0.3
    cons = clamp(1 - variation)
    return {"mod": mod, "hier": hier, "cons": cons, "mmi": 10 * (0.45 * mod + 0.30 * hier + 0.25 * cons)}


def modularity_tier(score: Column) -> Column:
    """critical below 4, high below 6, moderate below 7.5, else low: the tier of the risk."""
    return F.when(score < 4, "critical").when(score < 6, "high").when(score < 7.5, "moderate").otherwise("low")


def modularity(snapshot: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row (mmi, tier, mod, hier, cons) from a graph's snapshot and degrees; isolated vertices don't vary."""
    n = F.greatest("n_modules", F.lit(1)).cast("double")
    spread = degrees.where("instability is not null").agg(F.count("*").alias("k"), F.stddev_pop("instability").alias("sd"), F.avg("instability").alias("m"))
    cv = F.when(F.col("k") > 1, F.col("sd") / (F.col("m") + 1e-9)).otherwise(0.0)
    parts = modularity_score(F.col("coupling_density"), F.col("max_fan_in_ratio"), F.col("cycle_ratio"), F.col("largest_cycle") / n, cv)
    both = snapshot.join(F.broadcast(spread))
    return both.select(F.round(parts["mmi"], 2).alias("mmi"), modularity_tier(parts["mmi"]).alias("tier"), *(F.round(parts[k], 3).alias(k) for k in ("mod", "hier", "cons")))


def variation(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., cv): population standard deviation over the mean; 0 where the mean is 0."""
    s = values.groupBy(*by).agg(F.stddev_pop(value).alias("sd"), F.avg(value).alias("m"))
    return s.select(*by, F.when(F.col("m") == 0, 0.0).otherwise(F.col("sd") / F.col("m")).alias("cv"))


def distinct_per_ensemble(answers: DataFrame, size: int = 5) -> DataFrame:
    """(condition, ensemble, shapes): distinct shapes in each full run of `size` answers in trial order."""
    order = Window.partitionBy("condition").orderBy("trial")
    placed = answers.withColumn("ensemble", F.floor((F.row_number().over(order) - 1) / size))
    full = placed.groupBy("condition", "ensemble").agg(F.count("*").alias("n"), F.count_distinct("shape").alias("shapes"))
    return full.where(F.col("n") == size).select("condition", "ensemble", "shapes")
