"""Composite governance plans: the gate, change advice, keyword answers and what a run's status is."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graph, lookup, signals, similarity, stats

# Statuses of a run.
HELD, CROSSED, REFUSED, ADVISORY, NOT_MEASURED = range(5)


@dataclass(frozen=True)
class Options:
    """Settings of a run; unknown names are refused."""

    similarity: float = similarity.SIMILARITY
    quorum: int = 4
    trials: int = 5
    ignore: tuple[str, ...] = ()

    @classmethod
    def of(cls, values: dict) -> Options:
        known = {f.name: f.type for f in fields(cls)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        typed = {"similarity": float, "quorum": int, "trials": int, "ignore": tuple}
        return cls(**{k: typed[k](v) for k, v in values.items()})


def without_ignored(files: DataFrame, globs: tuple[str, ...], column: str = "path") -> DataFrame:
    """Rows whose path, or a segment or leading part of it, fits none of the globs."""
    out = files
    for g in globs:
        pattern = fnmatch.translate(g.rstrip("/")).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
        whole = F.col(column).rlike(f"^(?:{pattern})$")
        part = F.exists(F.split(column, "/"), _fits(pattern))
        out = out.where(~(whole | part | F.col(column).startswith(g.rstrip("/") + "/")))
    return out


def _fits(pattern: str):
    return lambda segment: segment.rlike(f"^(?:{pattern})$")


def gate(edges: DataFrame, layer_of: DataFrame, ranks: DataFrame, ballots: DataFrame | None, catalogue: DataFrame, quorum: int = 4) -> dict[str, DataFrame]:
    """Layer violations always; with ballots (item, match) also what the catalogue (name) clears.

    A vote for a name that the catalogue does not have is a vote for none.
    """
    out = {"layering": graph.layer_violations(edges, layer_of, ranks)}
    if ballots is not None:
        known = catalogue.select(F.col("name").alias("match")).distinct().withColumn("known", F.lit(True))
        named = ballots.join(known, "match", "left").select("item", F.when(F.col("known"), F.col("match")).alias("match"))
        out["clusters"] = stats.votes(named, quorum)
    return out


def gate_status(n_violations: int, declared: bool, judge_errors: int, n_decided: int) -> int:
    if judge_errors and not n_decided:
        return NOT_MEASURED
    if n_violations:
        return CROSSED if declared else ADVISORY
    return HELD


def advise(base: DataFrame, change: DataFrame, families: DataFrame, ratified: DataFrame, least: float = similarity.SIMILARITY) -> DataFrame:
    """(class, added, collides_with, similarity, ratification): what a change repeats.

    base and change are (id, s, n); families is (id, cluster) over the base;
    ratified is (id, reuse_site, superseded_by). A collision with a site of a live
    decision, or with a member of its family, is RATIFIED_CONFLICT, else CANDIDATE_COLLISION.
    """
    hits = similarity.change_collisions(base, change, least)
    changed = change.select(F.col("id").alias("member"))
    members = families.select(F.col("id").alias("member"), "cluster").join(changed, "member", "left_anti")
    family = hits.join(families.select(F.col("id").alias("base"), "cluster"), "base", "left").join(members, "cluster", "left")
    sites = family.select("added", "base", "jaccard", F.explode(F.array_distinct(F.array_compact(F.array("base", "member")))).alias("site"))
    live = ratified.where("superseded_by is null").groupBy(F.col("reuse_site").alias("site")).agg(F.min("id").alias("ratification"))
    each = sites.join(live, "site", "left")
    found = each.groupBy("added").agg(F.array_sort(F.collect_set("site")).alias("collides_with"), F.max("jaccard").alias("similarity"), F.min("ratification").alias("ratification"))
    kind = F.when(F.col("ratification").isNotNull(), "RATIFIED_CONFLICT").otherwise("CANDIDATE_COLLISION")
    return found.select(kind.alias("class"), "added", "collides_with", "similarity", "ratification")


def instruction(kind, added, sites) -> F.Column:
    """What to do about a finding, in a sentence."""
    first = F.get(sites, F.lit(0))
    return F.when(kind == "RATIFIED_CONFLICT", F.concat(F.lit("Use "), first, F.lit(" instead of adding "), added, F.lit(": the decision is in force."))).otherwise(
        F.concat(added, F.lit(" resembles "), F.concat_ws(", ", sites), F.lit("; reuse one of them or say why not."))
    )


def advice_status(n_conflicts: int, n_findings: int, readable: bool, fail: bool = True) -> int:
    if not readable:
        return NOT_MEASURED
    if n_conflicts and fail:
        return CROSSED
    return ADVISORY if n_findings else HELD


def answer(facts: DataFrame, question: str, limit: int = 12) -> DataFrame:
    """Hits (name, score) of facts (kind, name, tokens, doc) of the kind that the question asks for, best first.

    A question about conventions without other words lists all conventions; any other empty question finds nothing.
    """
    spark = facts.sparkSession
    kind = spark.range(1).select(signals.route(F.lit(question)).alias("k")).first()["k"]
    own = facts.where(F.col("kind") == kind) if kind != "concept" else facts
    hits = signals.keyword_hits(own, question)
    if kind == "convention" and hits.isEmpty():
        hits = own.select("name", F.lit(0).alias("score"))
    return hits.orderBy(F.desc("score"), "name").limit(limit)


def answer_by_kind(model: dict[str, DataFrame], question: str, ratified: DataFrame | None = None) -> DataFrame:
    """(label, kind, name): what a model holds for a question, by the matcher of its kind, and live decisions.

    model has `functions` (qualname, tokens, doc), `entities` (name, tokens),
    `modules` (module, tokens), `conventions` (value, modules) and `helpers`
    (concept, tokens, site); the question's cues choose the kind, and with no cue
    the functions and helpers are asked by keywords. ratified is (name, superseded_by).
    """
    spark = next(iter(model.values())).sparkSession
    kind = spark.range(1).select(signals.route(F.lit(question)).alias("k")).first()["k"]
    if kind == "entity":
        found = lookup.entity_matches(model["entities"], question).select("name")
    elif kind == "module":
        found = lookup.module_matches(model["modules"], question).select(F.col("module").alias("name"))
    elif kind == "convention":
        found = lookup.convention_matches(model["conventions"], question).select(F.col("value").alias("name"))
    elif kind == "helper":
        found = lookup.helper_matches(model["helpers"], model["functions"], question).select("name")
    else:
        found = signals.keyword_hits(model["functions"].select(F.col("qualname").alias("name"), "tokens", "doc"), question).orderBy(F.desc("score"), "name").select("name")
    out = found.select(F.lit("OBSERVED").alias("label"), F.lit(kind).alias("kind"), "name")
    if ratified is None:
        return out
    return out.unionByName(ratified.where("superseded_by is null").select(F.lit("RATIFIED").alias("label"), F.lit(kind).alias("kind"), "name"))


def context_lines(observed: DataFrame, candidates: DataFrame, ratified: DataFrame, most: int = 25) -> DataFrame:
    """(label, line): live ratified decisions, observed facts, and at most `most` candidates with the rest counted.

    Inputs have a column line; ratified also superseded_by.
    """
    r = ratified.where("superseded_by is null").select(F.lit("RATIFIED").alias("label"), "line")
    o = observed.select(F.lit("OBSERVED").alias("label"), "line")
    c = candidates.select(F.lit("CANDIDATE").alias("label"), "line").orderBy("line").limit(most)
    rest = candidates.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit("CANDIDATE").alias("label"), F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"))
    return r.unionByName(o).unionByName(c).unionByName(rest)
