"""Threshold calibration: banded sampling of scored pairs and a precision/recall curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalar import ratio, wilson

# Lower ends of the bands, their weights, and the thresholds of the curve.
BANDS = (0.0, 0.20, 0.35, 0.45, 0.60, 0.80)
WEIGHTS = (1, 2, 4, 4, 2, 1)
THRESHOLDS = tuple(round(0.20 + 0.05 * i, 2) for i in range(13))
LEAST_LABELS, LEAST_POSITIVES = 100, 20


class TooFewLabels(ValueError):
    """Fewer judged pairs, or positives among them, than a curve may rest on."""


def band(score: Column) -> Column:
    """Number of the half-open band; the last takes the rest."""
    out = F.lit(0)
    for i, low in enumerate(BANDS):
        out = F.when(score >= low, i).otherwise(out)
    return out


def band_sample(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n of the pairs (a, b, score), by band weight over the bands that have pairs.

    A band's quota is max(1, round(n * weight / weights of non-empty bands));
    inside a band the pairs with the smallest seeded MD5 are taken. Each band's
    candidates are first cut to the quota in every task's share of hash salts.
    """
    scored = pairs.withColumn("band", band(F.col("score")))
    there = [r["band"] for r in scored.select("band").distinct().collect()]  # six bands at most
    whole = sum(WEIGHTS[b] for b in there) or 1
    quota = {b: max(1, round(n * WEIGHTS[b] / whole)) for b in there}  # halves to even
    limit = F.lit(0)
    for b, q in quota.items():
        limit = F.when(F.col("band") == b, q).otherwise(limit)
    keyed = scored.withColumn("__h", F.md5(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string"), F.lit(str(seed)))))
    salted = keyed.withColumn("__salt", F.substring("__h", -2, 2))
    some = salted.withColumn("__r", F.row_number().over(Window.partitionBy("band", "__salt").orderBy("__h", "a", "b"))).where(F.col("__r") <= limit)
    ranked = some.withColumn("__r", F.row_number().over(Window.partitionBy("band").orderBy("__h", "a", "b"))).where(F.col("__r") <= limit)
    return ranked.drop("__h", "__salt", "__r")


def curve(labelled: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, strict: bool = True) -> DataFrame:
    """A row per threshold: tp, fp, fn, precision, recall, f1 and Wilson bounds, over (score, label).

    Labels other than same and different are left out. Below LEAST_LABELS
    judged pairs or LEAST_POSITIVES positives a strict curve is refused.
    """
    judged = labelled.where(F.col("label").isin("same", "different")).select("score", (F.col("label") == "same").alias("pos"))
    if strict:
        n = judged.agg(F.count("*").alias("n"), F.count_if("pos").alias("p")).first()
        if n["n"] < LEAST_LABELS or n["p"] < LEAST_POSITIVES:
            raise TooFewLabels(f"{n['n']} judged pairs, {n['p']} positive; {LEAST_LABELS} and {LEAST_POSITIVES} are needed")
    aggs = []
    for i, t in enumerate(thresholds):  # all thresholds in one pass
        hit = F.col("score") >= t
        aggs += [F.count_if(hit & F.col("pos")).alias(f"tp{i}"), F.count_if(hit & ~F.col("pos")).alias(f"fp{i}"), F.count_if(~hit & F.col("pos")).alias(f"fn{i}")]
    one = judged.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)))
    long = one.select(F.explode(rows).alias("r")).select("r.*")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    out = long.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).withColumn("precision_low", low).withColumn("precision_high", high)


def best(points: DataFrame, floor: float = 0.9) -> DataFrame:
    """One row: threshold of the best f1 (ties: the lowest) and lowest threshold with that precision."""
    return points.agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("best_f1_threshold"),
        F.min(F.when(F.col("precision") >= floor, F.col("threshold"))).alias("precise_threshold"),
    )
