"""Rankings and tallies: clusters by spread, size and co-change; terms with shapes that don't fit each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalar import singular

# Names of containers, which are no terms of a domain.
GENERIC = (
    "kwargs", "args", "options", "opts", "self", "data", "params", "config", "result", "results", "response", "request", "headers", "extra", "extras",
    "context", "ctx", "env", "environ", "meta", "info", "state", "payload", "obj", "item", "items", "value", "values", "kw", "d", "cls", "session", "cookie",
    "morsel", "record", "row", "entry", "attrs", "props", "settings",
)


def cluster_scores(members: DataFrame) -> DataFrame:
    """(cluster, degree, locality, score) over members (cluster, module) of clusters of two or more.

    locality is 1 inside a module, 2 inside a top package, 3 across; score is both multiplied.
    """
    package = F.split("module", r"\.")[0]
    m = members.groupBy("cluster", "module").agg(F.count("*").alias("n")).withColumn("package", package)
    sums = m.groupBy("cluster").agg(F.sum("n").alias("degree"), F.count("*").alias("modules"), F.min("package").alias("low"), F.max("package").alias("high"))
    locality = F.when(F.col("modules") == 1, 1).when(F.col("low") == F.col("high"), 2).otherwise(3)
    return sums.where("degree >= 2").select("cluster", "degree", locality.alias("locality"), (locality * F.col("degree")).alias("score"))


def combined_priority(scores: DataFrame, cochanges: DataFrame) -> DataFrame:
    """(cluster, degree, locality, score, cochange, combined) of `cluster_scores` and (cluster, max_jaccard).

    Clusters without a co-change have 0. combined is rounded to 2 places, cochange to 3.
    """
    both = scores.join(cochanges.select("cluster", "max_jaccard"), "cluster", "left").na.fill(0.0, ["max_jaccard"])
    return both.select("cluster", "degree", "locality", "score", F.round("max_jaccard", 3).alias("cochange"), F.round(F.col("score") * F.col("max_jaccard"), 2).alias("combined"))


def tallies(rows: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """(by, n, flags...): rows of each condition, and how many have each flag; null flags count as not set."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in flags))


def term_violations(shapes: DataFrame, seams: DataFrame | None = None) -> DataFrame:
    """(term, modules, translated): names that two modules or more give shapes of which neither holds the other.

    shapes is (name, module, fields array). Generic names are left out, others
    compared in lower case and singular; a module's shapes of a term are one.
    translated: one of the modules is among seams (module). Distinct shapes in
    order of their size are a chain if each holds the one before, so neighbours
    alone are compared, never all pairs.
    """
    lower = F.lower("name")
    named = shapes.where(~lower.isin(*GENERIC)).select(singular(F.lower(F.trim("name"))).alias("term"), "module", F.explode_outer("fields").alias("field")).distinct()
    merged = named.groupBy("term", "module").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    forms = merged.where(F.size("fields") > 0).select("term", "fields").distinct()
    before = F.lag("fields").over(Window.partitionBy("term").orderBy(F.size("fields"), "fields"))
    broken = forms.withColumn("before", before).where(F.size(F.array_except("before", "fields")) > 0).select("term").distinct()
    where = merged.join(broken, "term", "left_semi")
    if seams is None:
        where = where.withColumn("seam", F.lit(False))
    else:
        where = where.join(seams.select("module").distinct().withColumn("seam", F.lit(True)), "module", "left").na.fill(False, ["seam"])
    return where.groupBy("term").agg(F.array_sort(F.collect_set("module")).alias("modules"), F.max("seam").alias("translated"))


def mean_median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, median) of the values that are not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"))


def intervals(points: DataFrame, rise: float = 1e-9) -> DataFrame:
    """(key, seq, change): flag where the ratio (key, seq, ratio) rose against the last measured point, consolidation where it fell, else hold."""
    p = points.where("ratio is not null").withColumn("before", F.lag("ratio").over(Window.partitionBy("key").orderBy("seq")))
    change = F.when(F.col("ratio") > F.col("before") + rise, "flag").when(F.col("ratio") < F.col("before") - rise, "consolidation").otherwise("hold")
    return p.where("before is not null").select("key", "seq", change.alias("change"))


def first_last(points: DataFrame) -> DataFrame:
    """(key, first_ratio, last_ratio) of the measured points (key, seq, ratio)."""
    p = points.where("ratio is not null")
    return p.groupBy("key").agg(F.min_by("ratio", "seq").alias("first_ratio"), F.max_by("ratio", "seq").alias("last_ratio"))


def most_spread(values: DataFrame, n: int = 10) -> DataFrame:
    """The n rows of `shared_values` in the most modules, then with the most occurrences, then by value: a report's top rows."""
    return values.orderBy(F.desc("n_modules"), F.desc("occurrences"), "lit_type", "lit_repr").limit(n)
