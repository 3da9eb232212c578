"""Answers with fenced files: the files, the places they change, and whether helpers are used or made anew."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship

# A file in an answer (its name on the line before a fence), and the signs of an own conversion.
FILE_BLOCK = r"(?sm)^([\w./-]+\.py)\s*\n+```(?:python)?\n(.*?)```"
OWN_CONVERSION = r"Decimal|\*\s*100|quantize|round\s*\("


def file_blocks(answers: DataFrame) -> DataFrame:
    """answers (..., text) with `files`, a map from path to content; leading dots and slashes of a path go, of equal paths the last stays."""
    part = lambda g: F.regexp_extract_all("text", F.lit(FILE_BLOCK), F.lit(g))
    paths = F.transform(part(1), lambda p: F.regexp_replace(p, r"^[./]+", ""))
    pairs = F.arrays_zip(paths.alias("path"), part(2).alias("body"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["path"] == x["path"]))
    return answers.withColumn("files", F.coalesce(F.map_from_entries(last), F.map_from_entries(F.array().cast("array<struct<path: string, body: string>>"))))


def site_coverage(blocks: DataFrame, sites: list[str], mark: str) -> DataFrame:
    """blocks (..., files) with files_returned, sites_covered, missed_sites and oracle: which of the sites' own files carry the mark."""
    body = lambda s: F.try_element_at("files", F.lit(s))
    missed = F.filter(F.array(*(F.when(~F.coalesce(F.contains(body(s), F.lit(mark)), F.lit(False)), s) for s in sites)), lambda s: s.isNotNull())
    out = blocks.withColumn("files_returned", F.size("files")).withColumn("missed_sites", missed)
    covered = F.lit(len(sites)) - F.size("missed_sites")
    return out.withColumn("sites_covered", covered).withColumn("oracle", F.size("missed_sites") == 0)


def _called(code: Column, name: str) -> Column:
    return code.rlike(rf"(?<!\w){re.escape(name)}\s*\(")


def own_retry(text: str) -> bool:
    """Whether a function other than `retry` holds a loop and a try."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return False
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and f.name != "retry":
            inside = {type(n) for n in ast.walk(f)}
            if inside & {ast.For, ast.While} and ast.Try in inside:
                return True
    return False


def helper_use(answers: DataFrame, cents: str = "to_cents", retry: str = "retry", home: str = "billing") -> DataFrame:
    """answers (..., text) with reuse_cents, reuse_retry, reinvent_cents, reinvent_retry.

    A helper is used where its module is named, it is imported, or its name is
    called; a conversion is made anew by its own arithmetic without a call of
    the helper, a retry by a function with a loop and a try. What is made
    anew isn't used. Null texts use and make nothing.
    """
    ship(answers.sparkSession)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(own_retry=[own_retry(t) if isinstance(t, str) else False for t in pdf["text"]])

    code = F.coalesce("text", F.lit(""))
    calls_cents = _called(code, cents)
    calls_retry = _called(code, retry) & ~F.contains(code, F.lit(f"def {retry}"))
    has = lambda s: F.contains(code, F.lit(s))
    made_cents = code.rlike(OWN_CONVERSION) & ~calls_cents
    made_retry = F.col("own_retry") & ~calls_retry
    out = answers.mapInPandas(run, ", ".join([*names, "own_retry boolean"]))
    return out.select(
        *answers.columns,
        ((has(f"{home}.money") | has("import to_cents") | calls_cents) & ~made_cents).alias("reuse_cents"),
        ((has(f"{home}.retry") | has("import retry") | calls_retry) & ~made_retry).alias("reuse_retry"),
        made_cents.alias("reinvent_cents"),
        made_retry.alias("reinvent_retry"),
    )
