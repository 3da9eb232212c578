"""Hold-or-tighten budgets: observed metrics against recorded ceilings.

metrics is long: (state, metric, value, numerator, denominator); ceilings is
(metric, ceiling, numerator). A metric without a ceiling isn't watched, and one
that could not be measured has a null value and neither breaches nor improves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budget_of(metrics: DataFrame, watched: list[str], ratios: list[str]) -> DataFrame:
    """Ceilings from one state's metrics; ratios keep their numerator, counts need none."""
    m = metrics.where(F.col("metric").isin(*watched) & F.col("value").isNotNull())
    return m.select("metric", F.col("value").alias("ceiling"), F.when(F.col("metric").isin(*ratios), F.col("numerator")).alias("numerator"))


def breaches(metrics: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(state, metric, ceiling, observed, delta): observed above the ceiling."""
    both = metrics.join(ceilings.select("metric", "ceiling"), "metric").where("value > ceiling")
    return both.select("state", "metric", "ceiling", F.col("value").alias("observed"), (F.col("value") - F.col("ceiling")).alias("delta"))


def improvements(metrics: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(state, metric, ceiling, observed): observed below the ceiling."""
    both = metrics.join(ceilings.select("metric", "ceiling"), "metric").where("value < ceiling")
    return both.select("state", "metric", "ceiling", F.col("value").alias("observed"))


def tighten(metrics: DataFrame, ceilings: DataFrame, ratios: list[str]) -> DataFrame:
    """(metric, ceiling, numerator, decision): one guarded step for one state.

    Nothing measured (a denominator of 0) declines; what did not improve stands;
    a ratio is lowered only when its own numerator is strictly lower than the
    recorded one, so that growth of the denominator alone never tightens.
    """
    m = metrics.select("metric", "value", F.col("numerator").alias("now"), "denominator")
    both = ceilings.join(m, "metric", "left")
    ratio = F.col("metric").isin(*ratios)
    decision = (
        F.when(F.col("value").isNull(), "unmeasured")
        .when(F.coalesce(F.col("denominator"), F.lit(1)) == 0, "declined: nothing measured")
        .when(F.col("value") >= F.col("ceiling"), "stands")
        .when(ratio & (F.col("numerator").isNull() | F.col("now").isNull()), "declined: no numerator")
        .when(ratio & (F.col("now") > F.col("numerator")), "declined: numerator rose")
        .when(ratio & (F.col("now") == F.col("numerator")), "declined: numerator held")
        .otherwise("tightened")
    )
    moved = F.col("decision") == "tightened"
    out = both.withColumn("decision", decision)
    return out.select("metric", F.when(moved, F.col("value")).otherwise(F.col("ceiling")).alias("ceiling"), F.when(moved & ratio, F.col("now")).otherwise(F.col("numerator")).alias("numerator"), "decision")


def tighten_sequence(points: DataFrame) -> DataFrame:
    """(key, seq, value, numerator, ceiling, floor_numerator, tightened) for ratios over time.

    points is (key, seq, value, numerator), one series for each key. The first
    measured point sets the ceiling; each later one lowers it when both value
    and numerator are strictly lower. The fold runs over each series in order.
    A series is one row while it is folded, so it must be of the length of a
    history, not of a table.
    """
    ordered = points.where("value is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "numerator"))).alias("xs"))
    row = "struct<seq:bigint,value:double,numerator:bigint,ceiling:double,floor_numerator:bigint,tightened:boolean>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        first = F.size(acc) == 0
        lower = ~first & (x["value"] < last["ceiling"]) & (x["numerator"] < last["floor_numerator"])
        new = F.struct(
            x["seq"].cast("bigint").alias("seq"),
            x["value"].cast("double").alias("value"),
            x["numerator"].cast("bigint").alias("numerator"),
            F.when(first | lower, x["value"]).otherwise(last["ceiling"]).cast("double").alias("ceiling"),
            F.when(first | lower, x["numerator"]).otherwise(last["floor_numerator"]).cast("bigint").alias("floor_numerator"),
            F.coalesce(lower, F.lit(False)).alias("tightened"),
        )
        return F.concat(acc, F.array(new).cast(f"array<{row}>"))

    folded = ordered.select("key", F.explode(F.aggregate("xs", F.array().cast(f"array<{row}>"), step)).alias("r"))
    return folded.select("key", "r.*")


def state_of(n_breaches: int, accepted: bool, n_improved: int, may_tighten: bool) -> str:
    """held, crossed, accepted or tightened: a breach comes before any improvement."""
    if n_breaches:
        return "accepted" if accepted else "crossed"
    return "tightened" if n_improved and may_tighten else "held"
