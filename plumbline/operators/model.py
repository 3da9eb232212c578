"""Candidates, content hashes, and versioned human decisions over derived facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Refused(ValueError):
    """A decision that the rules do not allow."""


def candidate_id(kind, *identity):
    """kind:first 16 hex digits of the SHA-256 of what identifies a candidate; paths and times are no part."""
    return F.concat(kind, F.lit(":"), F.left(F.sha2(F.concat_ws("\x01", kind, *identity), 256), F.lit(16)))


def model_hash(facts: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One row (model_hash, n): a digest of a fact table that does not depend on row order.

    Rows are digested, the sorted digests of each of 256 buckets digested again,
    and those in order once more; repeated rows count. A bucket is cut by the first
    two hex digits, so the work is spread evenly.
    """
    row = F.sha2(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns)), 256)
    rows = facts.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    lines = rows.withColumn("bucket", F.left("h", F.lit(2))).groupBy("bucket").agg(
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("*", "h", F.col("n").cast("string"))))), 256).alias("d"), F.sum("n").alias("n")
    )
    return lines.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat("bucket", "d")))), 256).alias("model_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def live(ratified: DataFrame) -> DataFrame:
    """Decisions that no later one has replaced."""
    return ratified.where("superseded_by is null")


def ratify(ratified: DataFrame, new: DataFrame, known_hash: str | None = None, given_hash: str | None = None) -> DataFrame:
    """All decisions after adding new ones: each replaces the live one of its candidate.

    new is (id, candidate_id, kind, contract, scope, approved_by, approved_at).
    A decision needs a scope and an approver, and must be made on the current
    model (equal hashes). The replaced row gets superseded_by and superseded_at,
    the new one the next revision.
    """
    if known_hash != given_hash:
        raise Refused("the model has changed since the decision was prepared")
    if not new.where("coalesce(scope, '') = '' or coalesce(approved_by, '') = ''").isEmpty():
        raise Refused("a decision needs a scope and an approver")
    if not new.groupBy("candidate_id").count().where("count > 1").isEmpty():
        raise Refused("two decisions on one candidate")
    last = ratified.groupBy("candidate_id").agg(F.max("revision").alias("last"))
    numbered = new.join(last, "candidate_id", "left").withColumn("revision", F.coalesce("last", F.lit(0)) + 1).drop("last")
    numbered = numbered.withColumns({"superseded_by": F.lit(None).cast("string"), "superseded_at": F.lit(None).cast("date")})
    by = new.select("candidate_id", F.col("id").alias("__by"), F.col("approved_at").alias("__at"))
    old = ratified.join(by, "candidate_id", "left")
    replaced = F.col("superseded_by").isNull() & F.col("__by").isNotNull()
    old = old.withColumn("superseded_at", F.when(replaced, F.col("__at")).otherwise(F.col("superseded_at"))).withColumn(
        "superseded_by", F.when(replaced, F.col("__by")).otherwise(F.col("superseded_by"))
    )
    return old.drop("__by", "__at").unionByName(numbered.select(*ratified.columns))


def revisions(decisions: DataFrame) -> DataFrame:
    """(candidate_id, id, revision, superseded_by) from a bare log of decisions in order of approval."""
    order = Window.partitionBy("candidate_id").orderBy("approved_at", "id")
    return decisions.select("candidate_id", "id", F.row_number().over(order).cast("long").alias("revision"), F.lead("id").over(order).alias("superseded_by"))


def rank_helpers(helpers: DataFrame) -> DataFrame:
    """(concept, qualname, score, rank): helpers (qualname, module, name, tokens) by concept.

    A helper's concept is its most frequent name token, ties to the earlier
    one. Score: 4 for a name that is the concept, 3 for a module tail that is,
    2 for it being the only token.
    """
    counted = helpers.withColumn("t", F.array_distinct("tokens"))
    n = F.transform("t", lambda w: F.size(F.filter("tokens", lambda x: x == w)))
    best = F.array_max(n)
    with_concept = counted.withColumn("concept", F.get("t", (F.array_position(n, best) - 1).cast("int"))).where("concept is not null")
    tail = F.element_at(F.split("module", r"\."), -1)
    score = (
        F.when(F.col("name") == F.col("concept"), 4).otherwise(0) + F.when(tail == F.col("concept"), 3).otherwise(0) + F.when(F.size("tokens") == 1, 2).otherwise(0)
    )
    order = Window.partitionBy("concept").orderBy(F.desc("score"), F.size("tokens"), "qualname")
    return with_concept.withColumn("score", score).withColumn("rank", F.row_number().over(order)).select("concept", "qualname", "score", "rank")


def cluster_helpers(members: DataFrame) -> DataFrame:
    """(cluster, concept, site, n_sites) over members (cluster, qualname, tokens): the member to reuse.

    The concept is the name token of most members, ties to the smaller one. A
    member scores 4 if its name is the concept, 3 if the last part of its module
    is, 2 if it is the only token; then fewer tokens, then the smaller name win.
    """
    tokens = members.select("cluster", F.explode("tokens").alias("token")).groupBy("cluster", "token").agg(F.count("*").alias("n"))
    concept = tokens.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "token"))["token"].alias("concept"))
    both = members.join(concept, "cluster", "left").withColumn("concept", F.coalesce("concept", F.lit("")))
    parts = F.split("qualname", r"\.")
    score = (
        F.when(F.element_at(parts, -1) == F.col("concept"), 4).otherwise(0)
        + F.when(F.try_element_at(parts, F.lit(-2)) == F.col("concept"), 3).otherwise(0)
        + F.when((F.size("tokens") == 1) & F.array_contains("tokens", F.col("concept")), 2).otherwise(0)
    )
    first = F.min(F.struct((-score).alias("score"), F.size("tokens").alias("size"), "qualname"))["qualname"]
    return both.groupBy("cluster").agg(F.min("concept").alias("concept"), first.alias("site"), F.count("*").alias("n_sites"))


def derive(helpers: DataFrame, keys: DataFrame, values: DataFrame) -> DataFrame:
    """(id, kind, confidence, name, suggestion, n_sites): what a person may ratify.

    helpers is what `cluster_helpers` gives, keys `signals.every_site_keys`,
    values `signals.shared_values`. A helper is of medium confidence, a shape
    too if a key is read at every site, else low; values are low. Members, keys
    and modules of a candidate stay in the tables that they come from.
    """
    h = helpers.select(F.lit("reuse_helper").alias("kind"), F.lit("medium").alias("confidence"), F.col("concept").alias("name"), F.col("site").alias("suggestion"), "n_sites")
    k = keys.groupBy("name").agg(F.max("everywhere").alias("common"), F.max(F.when(F.col("everywhere"), F.col("n_sites"))).alias("all"), F.max("n_sites").alias("some"), F.min(F.when(F.col("everywhere"), F.col("key"))).alias("first"))
    k = k.select(F.lit("entity_shape").alias("kind"), F.when(F.col("common"), "medium").otherwise("low").alias("confidence"), "name", F.coalesce("first", F.lit("")).alias("suggestion"), F.coalesce("all", "some").alias("n_sites"))
    v = values.select(F.lit("shared_value").alias("kind"), F.lit("low").alias("confidence"), F.col("lit_type").alias("name"), F.col("lit_repr").alias("suggestion"), F.col("n_modules").alias("n_sites"))
    out = h.unionByName(k).unionByName(v)
    return out.select(candidate_id(F.col("kind"), F.col("name"), F.col("suggestion"), F.col("n_sites").cast("string")).alias("id"), *out.columns)
