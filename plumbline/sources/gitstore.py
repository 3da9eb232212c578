"""A repository as tables: commits with parents, the files of commits by content, changes with renames.

Commits come from a data source. What git knows about a commit or a blob is
asked for in the tasks that hold their rows, one git process for each task, so
a long history is dealt like any table; the repository lies in a folder that
all workers see. Files of many commits share their contents: a content is read
and parsed once, and facts go back to commits by its name.
"""

from __future__ import annotations

import re
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.session import cut, ship, written
from plumbline.sources import facts as source_facts
from plumbline.sources import rewrite
from plumbline.sources.files import SKIPPED, Refused

#: Stands for the module of a file while its content is parsed for all its places.
ANY_MODULE = "m"
# Fixed value: a line that imports.
IMPORT_LINE = r"^\s*(?:import\s+([A-Za-z_][\w.]*)|from\s+([A-Za-z_][\w.]*)\s+import)"


class GitCommits(DataSource):
    """Every commit that a ref reaches: spark.read.format("gitcommits").option("repo", path)[.option("ref", "HEAD")].

    seq numbers them from 0, parents before children; parents in git's order.
    A failing git stops the read.
    """

    @classmethod
    def name(cls) -> str:
        return "gitcommits"

    def schema(self) -> str:
        return "seq long, sha string, committed_at string, parents array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(dict(self.options))


class _CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        ref = self.options.get("ref", "HEAD")
        if ref.startswith("-"):
            raise Refused(f"not a ref: {ref}")
        command = ["git", "-C", self.options["repo"], "log", "--topo-order", "--reverse", "--format=%H %cI %P", ref, "--"]
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True) as git:
            for seq, line in enumerate(git.stdout):
                sha, at, *parents = line.split()
                yield seq, sha, at, parents
            if git.wait():
                raise RuntimeError(f"git log failed: {git.stderr.read().strip()[:200]}")


def commits(spark: SparkSession, repo: str, ref: str = "HEAD") -> DataFrame:
    """(seq, sha, committed_at, parents) of every commit that `ref` reaches."""
    spark.dataSource.register(GitCommits)
    return spark.read.format("gitcommits").option("repo", repo).option("ref", ref).load()


def _git(repo: str, *args: str, given: str | None = None) -> str:
    done = subprocess.run(["git", "-C", repo, *args], input=given, capture_output=True, text=True, errors="replace", check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.strip()[:200]}")
    return done.stdout


def _each(df: DataFrame, work, schema: str) -> DataFrame:
    """work(pandas column) -> rows, over df's one column, a batch at a time."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                yield pd.DataFrame(list(work(pdf.iloc[start : start + 64, 0])), columns=names)

    return df.mapInPandas(run, schema)


def listing(shas: DataFrame, repo: str, subdir: str = "", suffix: str = ".py") -> DataFrame:
    """(sha, path, blob) of the files of each commit in `shas` (sha), paths below `subdir`; a missing folder has none."""
    below = subdir.strip("/")
    if below.startswith("..") or "/../" in f"/{below}/":
        raise Refused(f"not a folder of the repository: {subdir}")

    def work(column: pd.Series) -> Iterator[tuple]:
        for sha in column:
            out = _git(repo, "ls-tree", "-r", "-z", "--full-tree", sha, *(["--", below + "/"] if below else []))
            for entry in out.split("\0"):
                head, _, path = entry.partition("\t")
                path = path[len(below) + 1 :] if below else path
                if head.split(" ")[1:2] == ["blob"] and path.endswith(suffix) and not any(s in path.split("/") for s in SKIPPED):
                    yield sha, path, head.split(" ")[2]

    return _each(shas.select("sha"), work, "sha string, path string, blob string")


def texts(blobs: DataFrame, repo: str) -> DataFrame:
    """(blob, text) of the distinct contents in `blobs` (blob); bytes that aren't UTF-8 are replaced."""

    def work(column: pd.Series) -> Iterator[tuple]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for blob in column:
                git.stdin.write(f"{blob}\n".encode())
                git.stdin.flush()
                head = git.stdout.readline().split()
                if len(head) != 3:
                    raise RuntimeError(f"no such content: {blob}")
                text = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                yield blob, text.decode("utf-8", "replace")
            git.stdin.close()

    return _each(blobs.select("blob").distinct(), work, "blob string, text string")


def changes(shas: DataFrame, repo: str, least: int = 50) -> DataFrame:
    """(sha, status, path, old_path) of commits with one parent or none: A, M, D, T and R with its old path.

    A rename is a removal and an addition that are alike by `least` percent or
    more, as git finds them. Merges have no rows.
    """

    def work(column: pd.Series) -> Iterator[tuple]:
        out = _git(repo, "diff-tree", "--stdin", "--root", "-r", "-z", f"-M{least}%", "--name-status", given="".join(f"{s}\n" for s in column))
        parts = iter(out.split("\0"))
        sha = None
        for part in parts:
            if re.fullmatch(r"\s*[0-9a-f]{40,64}\s*", part):
                sha = part.strip()
            elif part:
                old = next(parts) if part[0] in "RC" else None
                yield sha, part[0], next(parts), old

    return _each(shas.select("sha"), work, "sha string, status string, path string, old_path string")


def module_of(path: F.Column) -> F.Column:
    """Dotted module of a path below the root; the root's own `__init__` is empty."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def facts_by_content(files: DataFrame, contents: DataFrame, segments: bool = False) -> DataFrame:
    """Facts (state, path, module, kind, name, data) of files (state, path, blob), each of `contents` (blob, text) parsed once.

    The same as `facts.extract` over every file: names that hold the module
    get each place's own, and private modules have no surface.
    """
    any_place = contents.select(F.col("blob").alias("state"), F.lit("").alias("path"), F.lit(ANY_MODULE).alias("module"), "text")
    parsed = source_facts.extract(any_place, segments).select(F.col("state").alias("blob"), "kind", "name", "data")
    placed = files.withColumn("module", module_of(F.col("path"))).join(parsed, "blob")
    own = F.col("kind").isin("module", "unreadable")
    name = F.when(own, F.col("module")).when(F.col("kind") == "surface", F.concat("module", F.substring("name", len(ANY_MODULE) + 1, 1 << 30))).otherwise(F.col("name"))
    shown = (F.col("kind") != "surface") | ~F.exists(F.split("module", r"\."), lambda p: p.startswith("_"))
    return placed.where(shown).select("state", "path", "module", "kind", name.alias("name"), "data")


def stripped_by_content(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files (..., blob, stripped), contents (blob, text)) of files (..., text) after `rewrite.without_type_checking`.

    Each distinct text is stripped once, and is one row of contents.
    """
    keyed = files.withColumn("blob", F.md5(F.coalesce("text", F.lit(""))))
    contents = written(rewrite.without_type_checking(keyed.groupBy("blob").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))))
    return keyed.drop("text").join(contents.select("blob", "stripped"), "blob"), contents.select("blob", "text")


def history_facts(shas: DataFrame, repo: str, subdir: str = "") -> DataFrame:
    """Facts of the Python files of many commits (sha), as `facts.extract` gives them; state is the commit."""
    files = cut(listing(shas, repo, subdir)).withColumnRenamed("sha", "state")
    return facts_by_content(files, texts(files, repo))


def imported_tops(contents: DataFrame) -> DataFrame:
    """(blob, top): first names of the imports that a content's lines show, comments and strings included, standard library left out."""
    line = F.explode(F.split("text", r"\r\n|\r|\n"))
    named = contents.select("blob", line.alias("line")).where(F.col("line").rlike(IMPORT_LINE))
    name = F.concat(F.regexp_extract("line", IMPORT_LINE, 1), F.regexp_extract("line", IMPORT_LINE, 2))
    tops = named.select("blob", F.split(name, r"\.")[0].alias("top")).where("top != ''").distinct()
    return tops.where(~F.col("top").isin(*sorted(sys.stdlib_module_names)))


def imports_over_history(shas: DataFrame, repo: str, package: str, folders: list[str]) -> DataFrame:
    """(sha, n_thirdparty): outside packages that each commit's import lines name, in the first of `folders` that shows any there.

    Commits without such lines have 0.
    """
    files = cut(listing(shas, repo))
    place = F.lit(None).cast("int")
    for k, folder in reversed(list(enumerate(folders))):
        place = F.when(F.col("path").startswith(folder.strip("/") + "/") | (F.col("path") == folder), k).otherwise(place)
    here = files.withColumn("folder", place).where("folder is not null")
    contents = cut(texts(here, repo))
    any_line = contents.where(F.exists(F.split("text", r"\r\n|\r|\n"), lambda x: x.rlike(r"^\s*(import|from)\s"))).select("blob")
    first = here.join(any_line, "blob", "left_semi").groupBy("sha").agg(F.min("folder").alias("folder"))
    tops = here.join(first, ["sha", "folder"]).join(imported_tops(contents).where(F.col("top") != package), "blob")
    counts = tops.groupBy("sha").agg(F.count_distinct("top").alias("n_thirdparty"))
    return shas.select("sha").join(counts, "sha", "left").na.fill(0)
