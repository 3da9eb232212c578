"""Lookups over decisions, debts and facts: what stands for a concept, what is recorded against what is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import signals


def standing(ratified: DataFrame, candidates: DataFrame, concept: str, scope: str | None = None, stale: bool = False) -> DataFrame:
    """One row (concept, status, binding, id): RATIFIED, CANDIDATE or NONE.

    ratified is (at, id, text, scope, superseded_by), candidates (id, text). The
    live decision with the smallest `at` whose text holds the concept binds, if
    its own scope, where it has one, holds the scope asked for. Else the first
    candidate by id says something, unless the model is stale. Case is of no account.
    """
    holds = F.contains(F.lower("text"), F.lit(concept.lower()))
    live = ratified.where(F.col("superseded_by").isNull() & holds)
    if scope:
        live = live.where(F.coalesce("scope", F.lit("")).isin("") | F.contains(F.lower("scope"), F.lit(scope.lower())))
    first = live.agg(F.min(F.struct("at", F.col("id").cast("string").alias("id")))["id"].alias("decided"))
    other = candidates.where(holds & ~F.lit(stale)).agg(F.min("id").cast("string").alias("proposed"))
    status = F.when(F.col("decided").isNotNull(), "RATIFIED").when(F.col("proposed").isNotNull(), "CANDIDATE").otherwise("NONE")
    return first.join(other).select(F.lit(concept).alias("concept"), status.alias("status"), F.col("decided").isNotNull().alias("binding"), F.coalesce("decided", "proposed").alias("id"))


def debts_near(entries: DataFrame, path: str | None) -> DataFrame:
    """Entries (region, ...) whose region is part of the path or the path part of it, by lower case; all without a path.

    A null region is empty, so it is part of every path.
    """
    if not path:
        return entries
    region = F.lower(F.coalesce("region", F.lit("")))
    return entries.where(F.contains(region, F.lit(path.lower())) | F.contains(F.lit(path.lower()), region))


def differences(recorded: DataFrame, measured: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key..., field, recorded, measured) where a re-measured point differs from its record.

    A point on one side only differs in `present`; one that failed on one side
    only (error) differs in `error` and is compared no further. Fields that the
    record leaves null are not compared. Keys are unique on each side.
    """
    text = lambda c: F.col(c).cast("string")
    side = lambda df, s: df.select(*key, *(F.col(f).alias(f"{f}_{s}") for f in fields), F.col("error").alias(f"error_{s}"), F.lit(True).alias(f"here_{s}"))
    both = side(recorded, "r").join(side(measured, "m"), key, "full_outer")
    row = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.alias("recorded"), b.alias("measured"))
    absent = F.col("here_r").isNull() | F.col("here_m").isNull()
    failed = F.col("error_r").isNotNull() != F.col("error_m").isNotNull()
    here = [F.coalesce(F.col(f"here_{s}"), F.lit(False)).cast("string") for s in "rm"]
    each = F.array(*(F.when(F.col(f"{f}_r").isNotNull() & ~F.col(f"{f}_r").eqNullSafe(F.col(f"{f}_m")), row(f, text(f"{f}_r"), text(f"{f}_m"))) for f in fields))
    found = F.when(absent, F.array(row("present", *here))).when(failed, F.array(row("error", text("error_r"), text("error_m")))).otherwise(F.array_compact(each))
    return both.select(*key, F.explode(found).alias("d")).select(*key, "d.*")


def undeclared(declared: DataFrame, returned: DataFrame, key: str = "site") -> DataFrame:
    """(key, missing, extra): names (key, names) that one side has and the other lacks, sorted; equal sets are left out."""
    none = F.array().cast("array<string>")
    both = declared.select(key, F.col("names").alias("a")).join(returned.select(key, F.col("names").alias("b")), key, "full_outer")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    out = both.select(key, F.array_sort(F.array_except(a, b)).alias("missing"), F.array_sort(F.array_except(b, a)).alias("extra"))
    return out.where((F.size("missing") > 0) | (F.size("extra") > 0))


def bare_names(metrics: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """Rows with the package's name and its dot taken from the front of their id, where it is there."""
    head = f"{prefix}."
    return metrics.withColumn(column, F.when(F.col(column).startswith(head), F.substr(column, F.lit(len(head) + 1))).otherwise(F.col(column)))


def entity_matches(entities: DataFrame, question: str) -> DataFrame:
    """Entities (name, tokens, ...) that share a name token with the question's words or are such a word."""
    asked = signals.subject_words(question)
    return entities.where(F.arrays_overlap("tokens", F.array(*map(F.lit, asked)).cast("array<string>")) | F.lower("name").isin(*asked)) if asked else entities.limit(0)


def module_matches(modules: DataFrame, question: str) -> DataFrame:
    """Modules (module, tokens, ...) with a name token, or a part of the name, among the question's words."""
    asked = signals.subject_words(question)
    inside = F.lit(False)
    for word in asked:
        inside = inside | F.array_contains("tokens", word) | F.contains(F.lower("module"), F.lit(word))
    return modules.where(inside)


def convention_matches(conventions: DataFrame, question: str) -> DataFrame:
    """Conventions (value, modules array, ...) whose value or modules hold a word of the question; all, if it has no words."""
    asked = signals.subject_words(question)
    text = F.lower(F.concat_ws(" ", "value", F.concat_ws(" ", "modules")))
    inside = F.lit(not asked)
    for word in asked:
        inside = inside | F.contains(text, F.lit(word))
    return conventions.where(inside)


def helper_matches(helpers: DataFrame, functions: DataFrame, question: str) -> DataFrame:
    """(what, name): helpers (concept, tokens, site) by a concept token or the concept itself, and functions (qualname, tokens) by a token."""
    asked = signals.subject_words(question)
    words = F.array(*map(F.lit, asked)).cast("array<string>")
    hit = F.arrays_overlap("tokens", words)
    h = helpers.where(hit | F.array_contains(words, F.col("concept"))).select(F.lit("helper").alias("what"), F.col("site").alias("name"))
    return h.unionByName(functions.where(hit).select(F.lit("function").alias("what"), F.col("qualname").alias("name")))


def covered_votes(answers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Answers (item, answer) with match: the answer if the catalogue (name) has it, else NONE."""
    known = catalogue.select(F.col("name").alias("answer")).distinct().withColumn("known", F.lit(True))
    return answers.join(known, "answer", "left").select("item", F.when(F.col("known"), F.col("answer")).otherwise("NONE").alias("match"))
