"""Append-only decision ledger: open entries, closing, and the report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import first_date

REQUIRED = ("owner", "repayment_trigger", "review_date", "confidence", "repayment_feasibility")


class Refused(ValueError):
    """An entry or command that the rules do not allow."""


def check_entry(entry: dict) -> dict:
    """The entry, if it may be recorded: all required fields, evidence, and either all five
    exposure dimensions or an explicit needs-assessment."""
    missing = [k for k in REQUIRED if not entry.get(k)] + ([] if entry.get("evidence") else ["evidence"])
    exposure = entry.get("exposure") or {}
    dims = ("volatility", "coordination_span", "criticality", "discoverability", "blast_radius")
    if not all(exposure.get(d) in ("low", "medium", "high") for d in dims) and not entry.get("needs_assessment"):
        missing.append("exposure")
    if missing:
        raise Refused(f"not recorded, missing: {', '.join(missing)}")
    return entry


def open_entries(log: DataFrame) -> DataFrame:
    """Entries of (region, when, status, closes, ...) that are not closed, nor closed by a later row."""
    closings = log.where("status = 'closed' and closes is not null").select("region", F.col("closes").alias("when")).distinct()
    return log.where("status is null or status != 'closed'").join(closings, ["region", "when"], "left_anti")


def closing_rows(log: DataFrame, region: str, by: str, reason: str, now: str) -> DataFrame:
    """Rows that close every open entry of a region; none a second time."""
    rows = open_entries(log).where(F.col("region") == region)
    return rows.withColumn("closes", F.col("when")).withColumns({"when": F.lit(now), "status": F.lit("closed"), "closed_by": F.lit(by), "closed_reason": F.lit(reason)})


def due_date(review: str = "review_date", trigger: str = "repayment_trigger"):
    """The review date, else the first date in the trigger's text."""
    return F.coalesce(first_date(F.col(review)), first_date(F.col(trigger)))


def report(log: DataFrame, as_of: dt.date) -> DataFrame:
    """One row: entries, open, with owner, coverage (1 without open entries), overdue, last date, days held."""
    alive = open_entries(log)
    known = F.coalesce(F.col("owner"), F.lit("")) != ""
    due = due_date()
    day = F.lit(as_of)
    sums = alive.agg(
        F.count("*").alias("n_open"),
        F.count_if(known).alias("n_owned"),
        F.count_if(F.coalesce(due < day, F.lit(False))).alias("n_overdue"),
        F.max(first_date(F.col("when"))).alias("last_accepted"),
    )
    whole = log.agg(F.count("*").alias("n_entries"), F.count_if(F.col("status") == "closed").alias("n_closed"))
    both = whole.join(F.broadcast(sums))
    cover = F.when(F.col("n_open") == 0, 1.0).otherwise(F.round(F.col("n_owned") / F.col("n_open"), 3))
    return both.withColumn("coverage", cover).withColumn("held_days", F.date_diff(day, F.col("last_accepted")))


def by_region(log: DataFrame) -> DataFrame:
    return open_entries(log).groupBy("region").agg(F.count("*").alias("n_open"))


def by_tier(log: DataFrame) -> DataFrame:
    return open_entries(log).groupBy(F.coalesce("exposure_tier", F.lit("NEEDS_ASSESSMENT")).alias("tier")).agg(F.count("*").alias("n_open"))
