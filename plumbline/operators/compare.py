"""Bounded differential comparison of two expressions over the same cases."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inputs tried for a parameter of each type.
SEEDS = {
    "float": (0.0, 0.5, 0.05, 0.005, -0.5, 1.5, 2.5, 12.5, 0.125, 0.135, 1.005, 2.675, 99.995),
    "int": (0, 1, 2, 3, 4, 5, -1, 10, 100),
    "str": ("", "a", "abc", "  ", "café", "x" * 40),
    "bool": (True, False),
    "list": ([], [1], [1, 2, 3]),
    "dict": ({}, {"k": "v"}),
}
COLUMN_TYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean", "list": "array<long>", "dict": "map<string,string>"}
MOST_CASES = 500


def seed_cases(spark, types: dict[str, str], most: int = MOST_CASES) -> DataFrame | None:
    """Cases (case, parameters...) in the order of the product of the seeds; None for an unknown type."""
    if any(t not in SEEDS for t in types.values()):
        return None
    rows = itertools.islice(itertools.product(*(SEEDS[t] for t in types.values())), most)
    ddl = ", ".join(f"{n} {COLUMN_TYPES[t]}" for n, t in types.items())
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case long, {ddl}")


def mismatches(cases: DataFrame, left: Column, right: Column, order: str = "case", limit: int = 5) -> DataFrame:
    """The first cases in which the two differ, null-safely: their columns, left_value and right_value."""
    both = cases.withColumn("left_value", left).withColumn("right_value", right)
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value"))).orderBy(order).limit(limit)


def compare(cases: DataFrame | None, left: Column, right: Column, order: str = "case", limit: int = 5) -> dict:
    """{verdict, cases_run, counterexamples}: REFUTED, NO_DIVERGENCE_FOUND, or UNPROVEN without cases.

    cases_run counts the cases up to the last counterexample when the limit ends the run.
    """
    if cases is None:
        return {"verdict": "UNPROVEN", "cases_run": 0, "counterexamples": []}
    bad = [r.asDict() for r in mismatches(cases, left, right, order, limit).collect()]  # `limit` rows
    ran = cases.where(F.col(order) <= bad[-1][order]).count() if len(bad) == limit else cases.count()
    verdict = "REFUTED" if bad else "NO_DIVERGENCE_FOUND" if ran else "UNPROVEN"
    return {"verdict": verdict, "cases_run": ran, "counterexamples": bad}


def observed(value: Column, error: Column) -> Column:
    """A tagged outcome: ("raise", name) where there is an error name, else ("return", value)."""
    return F.when(error.isNotNull(), F.struct(F.lit("raise").alias("tag"), error.alias("value"))).otherwise(F.struct(F.lit("return").alias("tag"), value.cast("string").alias("value")))
