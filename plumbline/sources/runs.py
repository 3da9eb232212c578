"""Scored runs that can be stopped and taken up again, and that don't change what they once said.

A run is a folder of batches. A batch counts only once its manifest is
written, after its rows; what a killed job leaves without a manifest is not
read. The manifest holds the scorer, the number of rows and a digest of them,
and both are checked whenever the run is read. Scoring goes on with the keys
that no batch has. Inputs that changed under their key are refused, and so is
a scorer that gives other values for what is already scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import written
from plumbline.sources.files import Refused

MANIFEST = "number long, batch string, scorer string, n_rows long, digest long"
ROW = ["key", "input_sha256", "value"]


class Damaged(RuntimeError):
    """A batch whose rows are not those that its manifest tells of."""


def _sums() -> list:
    # An order-free digest: rows of a batch have distinct keys, so none cancels another.
    return [F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*ROW)), F.lit(0).cast("long")).alias("digest")]


def manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifests of a run's batches (MANIFEST), or None for a run without any."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{path}/manifest/*")
        return None if found.isEmpty() else found
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def completed(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, input_sha256, value, scorer) of all whole batches, the latest value of a key; None without any.

    Stops if a batch's rows and its manifest disagree.
    """
    told = manifests(spark, path)
    if told is None:
        return None
    names = [r["batch"] for r in told.select("batch").collect()]  # a name for each time the run was taken up
    rows = spark.read.parquet(*(f"{path}/batch-{n}" for n in names))
    read = rows.groupBy("batch").agg(*_sums())
    wrong = told.select("batch", F.col("n_rows").alias("n1"), F.col("digest").alias("d1")).join(read, "batch", "left").where(~F.col("n1").eqNullSafe(F.coalesce("n_rows", F.lit(0))) | ~F.col("d1").eqNullSafe(F.coalesce("digest", F.lit(0))))
    bad = [r["batch"] for r in wrong.select("batch").collect()]
    if bad:
        raise Damaged(f"batches that are not as their manifests say: {', '.join(sorted(bad))}")
    numbered = rows.join(F.broadcast(told.select("batch", "number", "scorer")), "batch")
    last = numbered.groupBy("key").agg(F.max_by(F.struct("input_sha256", "value", "scorer"), "number").alias("r"))
    return last.select("key", "r.*")


def _add(rows: DataFrame, path: str, scorer: str, number: int) -> None:
    batch = uuid.uuid4().hex
    rows.select(*ROW, F.lit(batch).alias("batch")).write.parquet(f"{path}/batch-{batch}")
    read = rows.sparkSession.read.parquet(f"{path}/batch-{batch}")
    told = read.agg(*_sums()).select(F.lit(number).cast("long").alias("number"), F.lit(batch).alias("batch"), F.lit(scorer).alias("scorer"), "n_rows", "digest")
    told.coalesce(1).write.json(f"{path}/manifest/{batch}")


def take_up(inputs: DataFrame, path: str, scorer: str, score: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Score what of inputs (key, text) the run at `path` lacks, and return the whole run as `completed` gives it.

    score makes (key, value) of (key, text), values as strings; `scorer` names
    the version of it. Null texts count as empty; keys must not repeat. With
    another scorer the old values are made again first: equal ones stay as they
    are, and any other is refused, or with `force` replaced by a later batch.
    """
    spark = inputs.sparkSession
    given = inputs.select(F.col("key").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumn("input_sha256", F.sha2("text", 256))
    if not given.groupBy("key").count().where("count > 1 or key is null").isEmpty():
        raise Refused("a key is missing or repeats")
    done = completed(spark, path)
    number = 0
    todo = given
    if done is not None:
        done = written(done)
        number = manifests(spark, path).count()
        old = done.select("key", F.col("input_sha256").alias("old_sha256"), F.col("value").alias("old_value"), "scorer")
        known = given.join(old, "key")
        if not known.where("input_sha256 != old_sha256").isEmpty():
            raise Refused("inputs changed since they were scored")
        other = known.where(F.col("scorer") != scorer)
        if not other.isEmpty():
            again = written(score(other.select("key", "text")).join(other.select("key", "input_sha256", "old_value"), "key"))
            changed = again.where(~F.col("value").eqNullSafe(F.col("old_value")))
            n = changed.count()
            if n and not force:
                raise Refused(f"another scorer: {n} values would change")
            if n:
                _add(changed, path, scorer, number)
                number += 1
        todo = given.join(done.select("key"), "key", "left_anti")
    todo = written(todo)
    if not todo.isEmpty():
        _add(score(todo.select("key", "text")).join(todo.select("key", "input_sha256"), "key"), path, scorer, number)
    out = completed(spark, path)
    return out if out is not None else todo.select("key", "input_sha256", F.lit(None).cast("string").alias("value"), F.lit(scorer).alias("scorer"))
