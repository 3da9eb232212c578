"""Writers: budgets, ledgers, measurements, findings, samples, managed blocks, shared registries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.files import Refused


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_budget(ceilings: DataFrame, path: str, author: str, reason: str = "", force: bool = False) -> None:
    """Ceilings with who set them. An existing budget is only replaced by force, and then with a reason."""
    if not author:
        raise Refused("a budget needs an author")
    if _exists(ceilings.sparkSession, path):
        if not force:
            raise Refused(f"{path} holds a budget already")
        if not reason:
            raise Refused("replacing a budget needs a reason")
    ceilings.select("metric", "ceiling", "numerator").withColumns({"author": F.lit(author), "reason": F.lit(reason)}).write.mode("overwrite" if force else "errorifexists").json(path)


def load_budget(spark: SparkSession, path: str) -> DataFrame:
    """(metric, ceiling, numerator); a missing or empty budget is refused, numerators may be absent."""
    if not _exists(spark, path):
        raise Refused(f"no budget at {path}")
    rows = spark.read.schema("metric string, ceiling double, numerator long").option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise Refused(f"{path} holds no ceilings")
    return rows


def append_ledger(entries: DataFrame, path: str) -> None:
    """Entries as further JSON lines; nothing that is there is changed."""
    entries.write.mode("append").json(path)


def write_measurement(counts: DataFrame, path: str, producer: str, version: str) -> None:
    """Imported counts (signal, raw) with who made them; they are candidates, not observations."""
    counts.select("signal", "raw").withColumns({"schema": F.lit("measurement/1"), "epistemic": F.lit("candidate"), "producer": F.lit(producer), "version": F.lit(version)}).write.mode("overwrite").json(path)


def read_measurement(spark: SparkSession, path: str) -> DataFrame:
    """(signal, raw); another schema or a count without its raw value is refused."""
    rows = spark.read.schema("schema string, signal string, raw long, producer string, version string").json(path)
    if not rows.where("schema is null or schema != 'measurement/1'").isEmpty():
        raise Refused("not a measurement of this schema")
    if not rows.where("raw is null").isEmpty():
        raise Refused("a count has no raw value")
    return rows.select("signal", "raw")


def write_sample(pairs: DataFrame, path: str) -> None:
    """Pairs to be labelled, a JSON line each, label still null."""
    pairs.select("a", "b", "score", F.lit(None).cast("string").alias("label")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sarif(findings: DataFrame, tool: str = "plumbline") -> DataFrame:
    """One row (sarif): findings (class, file, line, message) as a SARIF 2.1.0 document.

    A conflict with a ratified decision is an error, all else a note.
    """
    level = F.when(F.col("class") == "RATIFIED_CONFLICT", "error").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("class").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    all_results = findings.select(F.struct("file", "line", "message", result.alias("r")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.col("results"))
    return all_results.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def write_by(df: DataFrame, path: str, key: str) -> None:
    """A folder for each value of the key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def anonymised(points: DataFrame, kept: list[str], date_col: str = "day", key: str = "library", stamp: str = "analyser") -> DataFrame:
    """Points for a shared registry: only `kept` columns and the month, keys as ordinals, repeats once.

    A series of fewer than two points, or without the analyser that made it, is refused.
    """
    if not points.groupBy(key).count().where("count < 2").isEmpty():
        raise Refused("a series has fewer than two points")
    if not points.where(F.coalesce(F.col(stamp), F.lit("")) == "").isEmpty():
        raise Refused("a point does not say what made it")
    name = F.left(F.sha2(F.col(key), 256), F.lit(8))
    return points.select(name.alias("series"), F.date_format(date_col, "yyyy-MM").alias("month"), stamp, *kept).dropDuplicates()


BEGIN, END = "<!-- plumbline:begin -->", "<!-- plumbline:end -->"


def managed_block(document: str, body: str) -> str:
    """The document with the text between its markers replaced, or the block added at its end.

    All other characters stay. Unbalanced or repeated markers are refused.
    """
    starts, ends = document.count(BEGIN), document.count(END)
    if (starts, ends) == (0, 0):
        gap = "" if not document or document.endswith("\n") else "\n"
        return f"{document}{gap}{BEGIN}\n{body}\n{END}\n"
    if (starts, ends) != (1, 1) or document.index(BEGIN) > document.index(END):
        raise Refused("the document's markers are unbalanced or repeated")
    head, rest = document.split(BEGIN)
    return f"{head}{BEGIN}\n{body}\n{END}{rest.split(END)[1]}"


def block_hash(document: str) -> str | None:
    """The model hash that a managed block names, to be compared with the current one."""
    if BEGIN not in document:
        return None
    for line in document.split(BEGIN)[1].split(END)[0].splitlines():
        if line.startswith("model: "):
            return line.removeprefix("model: ").strip()
    return None


def comparison_text(result: dict) -> str:
    """A comparison as Markdown."""
    lines = [f"## {result['verdict']}", "", f"Cases run: {result['cases_run']}", ""]
    for case in result["counterexamples"]:
        lines.append("- " + json.dumps(case, default=str, sort_keys=True))
    return "\n".join(lines) + "\n"
