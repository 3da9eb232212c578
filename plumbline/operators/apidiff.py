"""Comparison of two public surfaces by rules for callers.

A surface is (symbol, kind, params array<struct<kind,name,has_default>>), kind
of a parameter being posonly, normal, kwonly, varargs or varkw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS = "array<struct<kind:string,name:string,has_default:boolean>>"


def diff_surfaces(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol, status, breaking, reasons): removed, added or changed symbols; equal ones are left out.

    Breaking for callers: a symbol or parameter gone, a parameter renamed that
    could be passed by name, made positional-only or keyword-only, its default
    lost, a new one without default, *args or **kwargs gone, another kind of symbol.
    """
    a = before.select("symbol", F.col("kind").alias("k1"), F.col("params").cast(PARAMS).alias("p1"))
    b = after.select("symbol", F.col("kind").alias("k2"), F.col("params").cast(PARAMS).alias("p2"))
    both = a.join(b, "symbol", "full_outer")
    status = F.when(F.col("k2").isNull(), "removed").when(F.col("k1").isNull(), "added").when(
        (F.col("k1") != F.col("k2")) | ~F.col("p1").eqNullSafe(F.col("p2")), "changed"
    )
    gone, new = F.col("k2").isNull(), F.col("k1").isNull()
    reasons = (
        F.when(gone, F.array(F.lit("symbol removed")))
        .when(new, F.array().cast("array<string>"))
        .when(F.col("k1") != F.col("k2"), F.array(F.concat(F.lit("kind "), "k1", F.lit(" to "), "k2")))
        .otherwise(parameter_reasons(F.col("p1"), F.col("p2")))
    )
    out = both.withColumn("status", status).where("status is not null").withColumn("reasons", F.array_sort(reasons))
    return out.select("symbol", "status", (F.size("reasons") > 0).alias("breaking"), "reasons")


def diff_with_defaults(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of `diff_surfaces` with `notes`, over surfaces that also hold defaults (array<string> beside the parameters).

    Notes tell what callers may want to know and no call fails for: a default
    that is another text now, and new parameters that may be left out. A symbol
    with other defaults alone is changed too.
    """
    side = lambda df, i: df.select("symbol", F.col("kind").alias(f"k{i}"), F.col("params").cast(PARAMS).alias(f"p{i}"), F.col("defaults").alias(f"d{i}"))
    both = side(before, 1).join(side(after, 2), "symbol").where("k1 = k2")
    noted = both.select("symbol", default_notes(F.col("p1"), F.col("d1"), F.col("p2"), F.col("d2")).alias("notes")).where(F.size("notes") > 0)
    none = F.array().cast("array<string>")
    out = diff_surfaces(before, after).join(noted, "symbol", "full_outer")
    return out.select("symbol", F.coalesce("status", F.lit("changed")).alias("status"), F.coalesce("breaking", F.lit(False)).alias("breaking"), F.coalesce("reasons", none).alias("reasons"), F.array_sort(F.coalesce("notes", none)).alias("notes"))


def default_notes(old: Column, old_defaults: Column, new: Column, new_defaults: Column) -> Column:
    """Changed defaults of parameters by name, and new optional parameters."""
    at = lambda xs, n: F.array_position(F.transform(xs, lambda q: q["name"]), n).cast("int") - 1

    def of_old(p: Column, i: Column) -> Column:
        was, now = F.get(old_defaults, i), F.get(new_defaults, at(new, p["name"]))
        return F.when((at(new, p["name"]) >= 0) & (was != now), F.concat(F.lit("default of "), p["name"], F.lit(": "), was, F.lit(" to "), now))

    def of_new(q: Column) -> Column:
        return F.when((at(old, q["name"]) < 0) & q["has_default"] & ~q["kind"].isin("varargs", "varkw"), F.concat(F.lit("new optional: "), q["name"]))

    return F.array_compact(F.concat(F.transform(old, of_old), F.transform(new, of_new)))


def diff_with_methods(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of `diff_surfaces` with the methods (kind method, symbol Class.name) of classes folded into their class.

    A class on both sides changes with its methods: a method gone or changed
    against its callers is breaking, a new one is not. Methods of removed or
    added classes say nothing of their own.
    """
    is_method = F.col("kind") == "method"
    owner = F.substring_index("symbol", ".", -1)
    cut_owner = F.col("symbol").substr(F.lit(1), F.length("symbol") - F.length(owner) - 1)
    both = before.where("kind = 'class'").select("symbol").intersect(after.where("kind = 'class'").select("symbol")).withColumnRenamed("symbol", "owner")
    m = diff_surfaces(before.where(is_method), after.where(is_method)).withColumn("owner", cut_owner).withColumn("name", owner).join(both, "owner", "left_semi")
    said = (
        F.when(F.col("status") == "removed", F.array(F.concat(F.lit("method removed: "), "name")))
        .when(F.col("status") == "added", F.array(F.concat(F.lit("method added: "), "name")))
        .otherwise(F.transform("reasons", lambda r: F.concat("name", F.lit(": "), r)))
    )
    inside = m.groupBy(F.col("owner").alias("symbol")).agg(F.max("breaking").alias("b2"), F.array_sort(F.flatten(F.collect_list(said))).alias("r2"))
    outer = diff_surfaces(before.where(~is_method), after.where(~is_method)).join(inside, "symbol", "full_outer")
    none = F.array().cast("array<string>")
    return outer.select(
        "symbol",
        F.coalesce("status", F.lit("changed")).alias("status"),
        (F.coalesce("breaking", F.lit(False)) | F.coalesce("b2", F.lit(False))).alias("breaking"),
        F.array_sort(F.concat(F.coalesce("reasons", none), F.coalesce("r2", none))).alias("reasons"),
    )


def verdict(findings: DataFrame) -> tuple[str, int]:
    """BREAKING and 1 if any finding is breaking, else COMPATIBLE and 0, the exit status."""
    return ("COMPATIBLE", 0) if findings.where("breaking").isEmpty() else ("BREAKING", 1)


def signature(params: Column, defaults: Column) -> Column:
    """Parameters as they are written: `(a, /, b, *, c=1, **rest)`; defaults is an array of texts beside them."""

    def one(p: Column, i: Column) -> Column:
        star = F.when(p["kind"] == "varargs", "*").when(p["kind"] == "varkw", "**").otherwise("")
        text = F.concat(star, p["name"], F.coalesce(F.concat(F.lit("="), F.get(defaults, i)), F.lit("")))
        last = (p["kind"] == "posonly") & ~F.coalesce(F.get(params, i + 1)["kind"] == "posonly", F.lit(False))
        before = F.get(params, i - 1)["kind"]
        bare = (p["kind"] == "kwonly") & ~F.coalesce(before.isin("kwonly", "varargs"), F.lit(False))
        return F.when(last, F.concat(text, F.lit(", /"))).when(bare, F.concat(F.lit("*, "), text)).otherwise(text)

    return F.concat(F.lit("("), F.concat_ws(", ", F.transform(params, one)), F.lit(")"))


def parameter_reasons(old: Column, new: Column) -> Column:
    """Why calls of the old parameters may fail with the new ones."""
    named = lambda p: p["kind"].isin("normal", "kwonly")
    by_name = lambda xs, n: F.get(F.filter(xs, lambda q: q["name"] == n), F.lit(0))
    fixed = F.filter(old, lambda p: p["kind"].isin("posonly", "normal"))
    places = F.filter(new, lambda p: p["kind"].isin("posonly", "normal"))

    def of_old(p: Column) -> Column:
        now = by_name(new, p["name"])
        star = p["kind"].isin("varargs", "varkw")
        return (
            F.when(star, F.when(~F.exists(new, lambda q: q["kind"] == p["kind"]), F.concat(F.lit("lost "), p["kind"])))
            .when(now.isNull(), F.when((p["kind"] == "posonly"), F.lit(None).cast("string")).otherwise(F.concat(F.lit("parameter gone: "), p["name"])))
            .when(named(p) & (now["kind"] == "posonly"), F.concat(F.lit("now positional-only: "), p["name"]))
            .when((p["kind"] != "kwonly") & (now["kind"] == "kwonly"), F.concat(F.lit("now keyword-only: "), p["name"]))
            .when(p["has_default"] & ~now["has_default"], F.concat(F.lit("default lost: "), p["name"]))
        )

    def moved(p: Column, i: Column) -> Column:
        there = F.get(places, i)
        elsewhere = by_name(places, p["name"])
        return F.when(there.isNull() & (p["kind"] == "posonly"), F.concat(F.lit("position gone: "), p["name"])).when(
            there.isNotNull() & elsewhere.isNotNull() & (there["name"] != p["name"]) & (p["kind"] != "kwonly"), F.concat(F.lit("moved: "), p["name"])
        )

    def of_new(q: Column) -> Column:
        was = by_name(old, q["name"])
        fresh = was.isNull() & ~q["has_default"] & ~q["kind"].isin("varargs", "varkw")
        return F.when(fresh & ((q["kind"] != "posonly") | (F.size(places) > F.size(fixed))), F.concat(F.lit("new required: "), q["name"]))

    found = F.concat(F.transform(old, of_old), F.transform(fixed, moved), F.transform(new, of_new))
    return F.array_distinct(F.filter(found, lambda r: r.isNotNull()))
