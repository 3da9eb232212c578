"""Readers: source trees, JSON documents and logs, diffs, trial folders, imported counts, git history."""

from __future__ import annotations

import io
import re
import subprocess
import tarfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from plumbline.functions.scalar import first_date
from plumbline.session import ship, written


class Refused(ValueError):
    """An input that must not be measured as if it were fine."""


SKIPPED = ("__pycache__", ".git")


def source_files(spark: SparkSession, root: str, state: str = "head") -> DataFrame:
    """(state, path, module, text) of the Python files below a folder, generated folders left out.

    module is the dotted path below root, `__init__` dropped. A root without
    any Python file is refused: nothing was measured.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root).select("path", "content")
    unlisted = [(p,) for p in unlisted_files(spark, root)]
    if unlisted:
        ship(spark)
        files = files.unionByName(spark.createDataFrame(unlisted, "path string").repartition(max(1, len(unlisted) // 256), "path").mapInPandas(_contents, "path string, content binary"))
    base = F.lit(root.rstrip("/").rsplit("://", 1)[-1])
    plain = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", "")
    below = F.regexp_replace(F.substr(plain, F.length(base) + 2, F.length(plain)), r"\.py$", "")
    module = F.regexp_replace(F.regexp_replace(below, "/", "."), r"(^|\.)__init__$", "")
    out = files.select(F.lit(state).alias("state"), plain.alias("path"), module.alias("module"), F.decode("content", "utf-8").alias("text"))
    for name in SKIPPED:
        out = out.where(~F.col("path").contains(f"/{name}/"))
    if out.select("path").isEmpty():
        raise Refused(f"no Python file below {root}")
    return out


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _holds_python(fs, path) -> bool:
    """Is there a Python file at or below a folder, generated folders left out; the walk ends at the first."""
    below = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if status.isFile() and name.endswith(".py"):
            return True
        if status.isDirectory() and name not in SKIPPED:
            below.append(status.getPath())
    return any(_holds_python(fs, p) for p in below)


def resolve_root(spark: SparkSession, root: str) -> str:
    """The root, if it can be measured. Refused: a missing path, a file, a tree without Python files, and a
    folder without Python files of its own whose only source folder is named instead."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        raise Refused(f"no such path: {root}")
    if not fs.getFileStatus(path).isDirectory():
        raise Refused(f"not a folder: {root}")
    if not _holds_python(fs, path):
        raise Refused(f"no Python file below {root}")
    listed = list(fs.listStatus(path))
    if not any(s.isFile() and s.getPath().getName().endswith(".py") for s in listed):
        inner = [s.getPath() for s in listed if s.isDirectory() and s.getPath().getName() not in SKIPPED and _holds_python(fs, s.getPath())]
        if len(inner) == 1:
            raise Refused(f"{root} has no Python file of its own; did you mean {root.rstrip('/')}/{inner[0].getName()}?")
    return root


def count_python_files(spark: SparkSession, root: str) -> int:
    """Number of Python files below a folder; contents are not read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root).select("path", "length")
    for name in SKIPPED:
        paths = paths.where(~F.col("path").contains(f"/{name}/"))
    return paths.where("length > 0").count() + len(unlisted_files(spark, root))


def changed_files(spark: SparkSession, root: str, staged: bool = False, span: str | None = None, patch: str | None = None, text: str | None = None) -> list[str]:
    """Python files of a change: from a unified diff (text, or a file's path), or from git: staged, a span of commits, else against HEAD.

    Paths of a diff are as written, those of git absolute. A change that can't be read is refused.
    """
    if text is not None or patch is not None:
        lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string") if text is not None else spark.read.text(patch)
        return sorted(r[0] for r in added_paths(lines).distinct().collect())  # the names in one change
    asked = ["--cached"] if staged else [span or "HEAD"]
    if span and span.startswith("-"):
        raise Refused(f"not a span of commits: {span}")
    found = []
    for command in (["rev-parse", "--show-toplevel"], ["diff", "--name-only", *asked, "--"]):
        done = subprocess.run(["git", "-C", root, *command], capture_output=True, text=True)
        if done.returncode:
            raise Refused(f"the change of {root} can't be read: {done.stderr.strip()[:200]}")
        found.append(done.stdout)
    top = found[0].strip()
    return sorted(f"{top}/{p}" for p in found[1].split("\n") if p.strip().endswith(".py"))


def unlisted_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of the Python files that Spark's reader passes over: those without bytes, and those whose name, or a
    folder's on the way, starts with an underscore or a dot (`__init__.py`). From the folder's listing; no file is opened."""
    fs, path = _file_system(spark, root)
    base = fs.makeQualified(path).toString().rstrip("/")
    listing = fs.listFiles(path, True)
    found = []
    while listing.hasNext():
        status = listing.next()
        at = status.getPath().toString()
        parts = at[len(base) :].strip("/").split("/")
        if at.endswith(".py") and not set(parts) & set(SKIPPED) and (status.getLen() == 0 or any(p[:1] in "_." for p in parts)):
            found.append(at)
    return found


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content) of paths, read in the task."""
    from pyarrow import fs as arrow_fs

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            system, below = arrow_fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe=":/"))
            with system.open_input_stream(below) as stream:
                rows.append((path, stream.read()))
        yield pd.DataFrame(rows, columns=["path", "content"])


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): a JSON-lines log; blank lines are skipped, other bad lines kept as text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"struct<{schema}, _bad string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("r._bad is null and r is not null and value like '{%'").select("r.*").drop("_bad")
    return good, parsed.where("not (r._bad is null and r is not null and value like '{%')").select("value")


def read_numbered_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of JSON-lines files, both with file and line; malformed keeps the text.

    Every line that is not blank must hold one object. Lines are numbered from 1
    in each file. A file may be read in many parts: a line's number is its place
    in its part and the lines of the parts before, which are counted once.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.text(path).select("value", meta("file_path").alias("file"), meta("file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = written(lines)
    parts = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    named = lines.join(parts, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value").where(F.trim("value") != "")
    parsed = named.withColumn("r", F.from_json("value", f"struct<{schema}, _bad string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("r._bad").isNull() & F.col("r").isNotNull() & F.ltrim("value").startswith("{")
    return parsed.where(whole).select("file", "line", "r.*").drop("_bad"), parsed.where(~whole).select("file", "line", "value")


def malformed_note(malformed: DataFrame, shown: int = 5) -> DataFrame:
    """(file, n, lines): lines of each file that were left out, and the numbers of the first `shown`."""
    first = malformed.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    return first.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.col("line")))), ", ").alias("lines"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs (a, b, score, label) from JSON lines; a malformed line stops the read."""
    return spark.read.schema("a string, b string, score double, label string").option("mode", "FAILFAST").json(path)


def added_paths(lines: DataFrame) -> DataFrame:
    """Paths of the Python files that a unified diff (value) adds to."""
    path = F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.*\.py)\s*$", 1)
    return lines.select(path.alias("path")).where("path != ''").distinct()


def trials(spark: SparkSession, root: str) -> DataFrame:
    """(probe, run, condition, trial, kind, text) of <probe>/<run>/<condition>/trial-NN.<kind> files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "trial-*").load(root)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/trial-(\d+)\.([^/]+)$", i)
    return files.select(part(1).alias("probe"), part(2).alias("run"), part(3).alias("condition"), part(4).cast("int").alias("trial"), part(5).alias("kind"), F.decode("content", "utf-8").alias("text"))


def fenced_blocks(text) -> F.Column:
    """Bodies of all fenced code blocks of a text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))


# The verdicts.
VERDICTS = ("CONSOLIDATE", "SANCTIONED", "UNSURE")


def verdict(text, known: tuple[str, ...] = VERDICTS) -> F.Column:
    """The verdict in a text's JSON, from its first brace to its last; anything else is UNPARSEABLE, never dropped."""
    found = F.upper(F.trim(F.get_json_object(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), "$.verdict")))
    return F.when(found.isin(*known), found).otherwise("UNPARSEABLE")


def import_counts(spark: SparkSession, path: str, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """(signal, raw, sites) from another tool's findings file.

    Refused: a file without a findings list (scores only), another schema
    version, and a stated count that is not the number of findings.
    """
    schema = "baseline_version int, drift_version string, finding_count int, findings array<struct<signal:string,file:string,start_line:int,title:string,fingerprint:string>>"
    row = spark.read.schema(schema).option("multiLine", True).json(path)
    head = row.select("baseline_version", "finding_count", F.size("findings").alias("n"), F.col("findings").isNull().alias("none")).first()
    if head is None or head["none"]:
        raise Refused("no list of findings; scores alone can't be compared")
    if head["baseline_version"] not in versions:
        raise Refused(f"schema version {head['baseline_version']} is not known")
    if head["finding_count"] != head["n"]:
        raise Refused(f"{head['finding_count']} findings are stated, {head['n']} are there")
    each = row.select(F.explode("findings").alias("f")).select("f.*")
    sites = each.groupBy("signal").agg(F.array_sort(F.collect_set(_site())).alias("sites"))  # of one file
    return count_findings(each).join(sites, "signal").select("signal", "raw", "sites")


def _site() -> F.Column:
    return F.concat_ws(":", "file", F.col("start_line").cast("string"))


def count_findings(findings: DataFrame) -> DataFrame:
    """(signal, raw, n_sites) of findings (signal, file, start_line): all of them, and their distinct places."""
    return findings.groupBy("signal").agg(F.count("*").alias("raw"), F.count_distinct(_site()).alias("n_sites"))


def dated(rows: DataFrame, column: str) -> DataFrame:
    """rows with `day`, the first date in a text column."""
    return rows.withColumn("day", first_date(F.col(column)))


class GitLog(DataSource):
    """Commits of a local repository: spark.read.format("gitlog").option("repo", path)[.option("files", "true")].

    Without files: first-parent commits, oldest first (seq, sha, committed_at).
    With files: one row for each path that a commit without several parents
    touches (sha, path), of the last `most` (4,000) commits. A failing git
    stops the read instead of giving no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "sha string, path string" if self.options.get("files") == "true" else "seq long, sha string, committed_at string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        files = self.options.get("files") == "true"
        most = self.options.get("most", "4000")
        what = ["--all", f"-n{most}", "--no-merges", "--format=commit %H", "--name-only"] if files else ["--first-parent", "--reverse", "--format=%H %cI"]
        done = subprocess.run(["git", "-C", self.options["repo"], "log", *what], capture_output=True, text=True, check=False)
        if done.returncode:
            raise RuntimeError(f"git log failed: {done.stderr.strip()[:200]}")
        sha = ""
        for seq, line in enumerate(done.stdout.splitlines()):
            if not files:
                yield (seq, *line.split(" ", 1))
            elif m := re.fullmatch(r"commit ([0-9a-f]{7,64})", line):
                sha = m[1]
            elif line:
                yield sha, line


class GitTree(DataSource):
    """Python files of a repository at some commits: spark.read.format("gittree").option("repo", path)
    .option("shas", "a,b").option("subdir", "src").

    One partition for each commit, read from an archive in memory: nothing is
    checked out and HEAD stays where it is. A member that would leave the
    folder stops the read. An unknown commit, or one without the folder, gives
    one row with the error and no text, so that it isn't taken for an empty tree.
    """

    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return "state string, path string, module string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options.get("shas", "").split(",") if s]

    def read(self, partition) -> Iterator[tuple]:
        sha, below = partition.value, self.options.get("subdir", "").strip("/")
        if below.startswith("..") or "/../" in f"/{below}/" or not re.fullmatch(r"[0-9a-fA-F]{4,64}", sha):
            raise Refused(f"not a commit and folder of the repository: {sha} {below}")
        done = subprocess.run(["git", "-C", self.options["repo"], "archive", "--format=tar", sha, *([below] if below else [])], capture_output=True, check=False)
        if done.returncode:
            yield sha, None, None, None, done.stderr.decode(errors="replace").strip()[:200]
            return
        with tarfile.open(fileobj=io.BytesIO(done.stdout)) as archive:
            for member in archive:
                parts = member.name.split("/")
                if member.name.startswith("/") or ".." in parts:
                    raise Refused(f"{member.name} leaves the folder")
                if not member.isfile() or not member.name.endswith(".py") or any(s in parts for s in SKIPPED):
                    continue
                path = member.name[len(below) + 1 :] if below else member.name
                module = re.sub(r"(^|\.)__init__$", "", path.removesuffix(".py").replace("/", "."))
                yield sha, path, module, archive.extractfile(member).read().decode(errors="replace"), None
