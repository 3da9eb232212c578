"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words between ASCII blanks and line ends; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\n\\t\\r]+"), lambda w: w != "")


def shingles(tokens: Column, k: int) -> Column:
    """Distinct k-grams of an array as hashes; a shorter array is one gram, an empty one has none."""

    def build(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.concat_ws("\x01", F.slice(t, i, k))))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(grams))

    # As a lambda's variable the array is made once, not once for each gram.
    return F.get(F.transform(F.array(tokens), build), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays without repeats; 0 where either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def identifier_words(name: Column) -> Column:
    """Lower-case words of a snake_case or camelCase name, digits by themselves."""
    parts = F.split(F.coalesce(name, F.lit("")), r"[_\W]+")
    each = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"), F.lit(0)))
    return F.transform(F.flatten(each), lambda w: F.lower(w))


def singular(word: Column) -> Column:
    """Plain English singular: -ies to -y and -es dropped in words over four letters, -s in words over three."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 4), F.substr(word, F.lit(1), n - 2))
        .when(word.endswith("s") & (n > 3), F.substr(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def first_date(text: Column) -> Column:
    """First ISO date in a text, null where there is none or it isn't a day."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyy-MM-dd")).cast("date")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, rounded to 3 places; (0, 0) without trials."""
    p = hits.cast("double") / n
    z2 = z * z
    middle = p + z2 / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.round(F.least(F.greatest(x / scale, F.lit(0.0)), F.lit(1.0)), 3))
    return bound(middle - half), bound(middle + half)


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """top / bottom as a double; `empty` where the bottom is 0."""
    return F.when(bottom == 0, F.lit(empty)).otherwise(top.cast("double") / bottom.cast("double"))


def exposure_tier(volatility: Column, span: Column, criticality: Column, discoverability: Column, blast: Column) -> Column:
    """HIGH, MODERATE, LOW, or NEEDS_ASSESSMENT where a dimension is missing.

    Dimensions are low, medium or high. Critical together with a high span or
    blast radius is high, and so are three highs with criticality or
    volatility among them; one high or two mediums are moderate.
    """
    dims = (volatility, span, criticality, discoverability, blast)
    count = lambda level: sum((F.when(d == level, 1).otherwise(0) for d in dims), F.lit(0))
    missing = F.lit(False)
    for d in dims:
        missing = missing | d.isNull() | ~d.isin("low", "medium", "high")
    critical, high = criticality == "high", count("high")
    return (
        F.when(missing, "NEEDS_ASSESSMENT")
        .when(critical & ((span == "high") | (blast == "high")), "HIGH")
        .when((high >= 3) & (critical | (volatility == "high")), "HIGH")
        .when((high >= 1) | (count("medium") >= 2), "MODERATE")
        .otherwise("LOW")
    )


def half_up_cents(thousandths: Column) -> Column:
    """Integer division by ten, halves up."""
    return F.floor((thousandths + 5) / 10).cast("long")


def tree_distance(a: Column, b: Column) -> Column:
    """Hops between two dotted names over their longest common prefix."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    state = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    common = F.aggregate(same, state, lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return F.size(x) + F.size(y) - 2 * common
