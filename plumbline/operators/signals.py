"""Shared values, dependency spread, name tokens and keyword queries over facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers that say nothing when shared, words that are no subject of a question, and the cues of its kind in their order.
TRIVIAL = (0, 1, 2, -1, 10, 100, 1000, 0.0, 1.0, 0.5)
STOP = (
    "which", "what", "where", "does", "do", "is", "the", "a", "an", "of", "for", "to", "in", "on", "sites", "site", "compute", "computes", "canonical",
    "shape", "exist", "exists", "already", "helper", "helpers", "reuse", "layer", "layers", "depend", "depends", "dependency", "module", "modules",
    "convention", "conventions", "constant", "value", "values", "govern", "governs", "entity", "shapes", "and", "diverge", "diverges", "how", "there", "any",
    "it", "its", "has", "have", "are", "with", "this", "that", "use", "used", "uses", "shared", "constants", "or", "across",
)
CUES = (
    ("convention", r"\bconvention|\bconstant|\bvalue"),
    ("entity", r"\bentity|\bshape|\bcanonical"),
    ("module", r"\blayer|\bdepend|\bimport|\brole"),
    ("helper", r"\bhelper|\breuse|\bexist|\balready"),
)


def significant(kind: Column, text: Column) -> Column:
    """Strings of four characters or more that aren't blank; numbers beyond 2 that aren't trivial."""
    number = text.try_cast("double")
    return F.when(kind == "str", (F.length(text) >= 4) & (F.trim(text) != "")).when(
        kind.isin("int", "float"), (F.abs(number) > 2) & ~number.isin(*[float(x) for x in TRIVIAL])
    ).otherwise(F.lit(False))


def shared_values(literals: DataFrame, least: int = 2) -> DataFrame:
    """(lit_type, lit_repr, n_modules, occurrences) of values in `least` modules or more.

    The type is part of the value. Keys are counted whole and cut only for display.
    """
    each = literals.groupBy("lit_type", "lit_repr", "module").agg(F.count("*").alias("n"))
    return each.groupBy("lit_type", "lit_repr").agg(F.count("*").alias("n_modules"), F.sum("n").alias("occurrences")).where(F.col("n_modules") >= least)


def dependency_spread(imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(top, n_modules, single_use) of outside dependencies (module, top), without those in known (top)."""
    outside = imports.select("module", "top").where("top is not null").distinct()
    if known is not None:
        outside = outside.join(known.select("top").distinct(), "top", "left_anti")
    return outside.groupBy("top").agg(F.count("*").alias("n_modules")).withColumn("single_use", F.col("n_modules") == 1)


def every_site_keys(access: DataFrame) -> DataFrame:
    """(name, key, n_sites, everywhere): keys read from a named mapping, by module (name, module, key).

    Kept are names with two modules or more, or two (module, key) pairs or more.
    """
    a = access.select("name", "module", "key").distinct()
    sites = a.groupBy("name").agg(F.count_distinct("module").alias("sites"), F.count("*").alias("pairs")).where("sites >= 2 or pairs >= 2")
    keys = a.groupBy("name", "key").agg(F.count("*").alias("n_sites"))
    return keys.join(sites, "name").select("name", "key", "n_sites", (F.col("n_sites") == F.col("sites")).alias("everywhere"))


def incompatible_shapes(shapes: DataFrame) -> DataFrame:
    """(term, a, b): modules that give one term shapes (term, module, fields) of which neither holds the other."""
    a = shapes.select("term", F.col("module").alias("a"), F.col("fields").alias("fa"))
    b = shapes.select("term", F.col("module").alias("b"), F.col("fields").alias("fb"))
    apart = (F.size(F.array_except("fa", "fb")) > 0) & (F.size(F.array_except("fb", "fa")) > 0)
    return a.join(b, "term").where("a < b").where(apart).select("term", "a", "b")


def route(question: Column) -> Column:
    """Kind of a question by its first fitting cue: convention, entity, module, helper, else concept."""
    kind = F.lit("concept")
    for name, cue in reversed(CUES):
        kind = F.when(F.lower(question).rlike(cue), name).otherwise(kind)
    return kind


def subject_words(question: str) -> list[str]:
    """Words of a question that are no stop words, letters and digits apart; repeats stay."""
    asked = [w for w in re.split(r"[^a-z0-9]+", question.lower()) if w and w not in STOP]
    return [part for w in asked for part in re.findall(r"[a-z]+|[0-9]+", w)]


def keyword_hits(facts: DataFrame, question: str) -> DataFrame:
    """(name, score) of facts (name, tokens, doc) by question words: one for each token that is a word
    and one for each word inside the lower-case doc; words that repeat count again; zero scores go."""
    asked = subject_words(question)
    if not asked:
        return facts.select("name", F.lit(0).alias("score")).limit(0)
    doc = F.lower(F.coalesce("doc", F.lit("")))
    score = sum((F.coalesce(F.array_contains("tokens", w).cast("int"), F.lit(0)) for w in asked), F.lit(0))
    score = score + sum((doc.contains(w).cast("int") for w in asked), F.lit(0))
    return facts.select("name", score.alias("score")).where("score > 0")


def under_used_parameters(sites: DataFrame, shapes: DataFrame, least_keys: int = 3, most: float = 0.34) -> DataFrame:
    """Parameters (site, param, used, passed_whole) that take a whole entity (param, keys) and use little of it."""
    full = shapes.where(F.size("keys") >= least_keys)
    both = sites.join(full, "param").withColumn("n_used", F.size(F.array_intersect("used", "keys"))).withColumn("n_full", F.size("keys"))
    share = F.col("n_used").cast("double") / F.col("n_full")
    return both.withColumn("fraction", share).where((F.col("fraction") <= most) | (F.col("passed_whole") & (F.col("n_used") <= 1))).select(
        "site", "param", "n_used", "n_full", "fraction"
    )
