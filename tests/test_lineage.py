"""History by content, ancestry and renames, against git itself and loops."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from plumbline.operators import lineage
from plumbline.sources import facts, gitstore


def run_git(path, *a):
    return subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def branched(tmp_path_factory):
    """Side branches, merges, a branch off a branch and an unmerged tip."""
    repo = tmp_path_factory.mktemp("branched")
    git = lambda *a: run_git(repo, *a)
    git("init", "-q", "-b", "main")
    rng, n = random.Random(2), 0

    def commit(name):
        nonlocal n
        n += 1
        (repo / name).write_text(f"import os\nimport pkg{n % 4}\nx = {n // 3}\n")
        git("add", ".")
        git("commit", "-qm", f"c{n}")

    for k in range(5):
        commit(f"m{k}.py")
    for b in range(4):
        git("checkout", "-qb", f"b{b}", f"HEAD~{rng.randint(0, 2)}")
        for k in range(3):
            commit(f"b{b}_{k}.py")
        if b == 2:
            git("merge", "-qm", "side", "b1", "--no-edit")
        git("checkout", "-q", "main")
        commit(f"more{b}.py")
        if b != 3:
            git("merge", "-qm", "join", f"b{b}", "--no-edit")
    return repo


def test_ancestors_equal_rev_list(spark, branched):
    commits = gitstore.commits(spark, str(branched), "main").unionByName(gitstore.commits(spark, str(branched), "b3")).dropDuplicates(["sha"])
    refs = ["main", "b0", "b1", "b2", "b3", "main~2"]
    tips = {run_git(branched, "rev-parse", r).strip(): r for r in refs}
    got = lineage.ancestors(commits, spark.createDataFrame([(t,) for t in [*tips, "unknown"]], "tip string")).collect()
    for tip, ref in tips.items():
        assert sorted(r["sha"] for r in got if r["tip"] == tip) == sorted(run_git(branched, "rev-list", ref).split())
    assert not [r for r in got if r["tip"] == "unknown"]


def test_bounded_volatility_reads_the_ancestry_alone(spark, branched):
    commits = gitstore.commits(spark, str(branched), "main")
    touches = gitstore.changes(commits, str(branched)).select("sha", F.col("path").alias("item"))
    tip = run_git(branched, "rev-parse", "b1").strip()
    got = {r["item"]: r["volatility"] for r in lineage.bounded_volatility(commits, touches, spark.createDataFrame([(tip,)], "tip string")).collect()}
    names = [x for x in run_git(branched, "log", tip, "--no-merges", "--format=", "--name-only").split("\n") if x]
    top = max(map(names.count, names))
    assert got == {x: names.count(x) / top for x in names}


def test_facts_by_content_equal_those_of_every_file(spark, branched, monkeypatch):
    commits = gitstore.commits(spark, str(branched), "main")
    (branched / "pkg").mkdir(exist_ok=True)
    (branched / "pkg" / "__init__.py").write_text("def shown(a, b=1):\n    return a\n")
    (branched / "pkg" / "_own.py").write_text("def shown(a, b=1):\n    return a\n")  # the same content, private
    (branched / "pkg" / "bad.py").write_text("def (\n")
    run_git(branched, "add", ".")
    run_git(branched, "commit", "-qm", "package")
    commits = gitstore.commits(spark, str(branched), "main").select("sha")
    files = gitstore.listing(commits, str(branched)).withColumnRenamed("sha", "state")
    contents = gitstore.texts(files, str(branched))
    every = files.join(contents, "blob").select("state", "path", gitstore.module_of(F.col("path")).alias("module"), "text")
    expected = sorted(map(tuple, facts.extract(every).collect()), key=repr)
    parsed = []
    extract = facts.extract
    monkeypatch.setattr(facts, "extract", lambda df, *a: parsed.append(df.count()) or extract(df, *a))
    got = sorted(map(tuple, gitstore.history_facts(commits, str(branched)).select("state", "path", "module", "kind", "name", "data").collect()), key=repr)
    assert got == expected
    blobs = {line.split()[2] for sha in run_git(branched, "rev-list", "main").split() for line in run_git(branched, "ls-tree", "-r", sha).splitlines()}
    assert parsed == [len(blobs)]


def test_imports_over_history_equal_a_full_reading(spark, branched):
    commits = gitstore.commits(spark, str(branched), "main").select("sha")
    got = {r["sha"]: r["n_thirdparty"] for r in gitstore.imports_over_history(commits, str(branched), "pkg0", ["src", "m0.py", "m1.py"]).collect()}
    for sha in run_git(branched, "rev-list", "main").split():
        text = ""
        for name in ("m0.py", "m1.py"):
            if name in run_git(branched, "ls-tree", "-r", "--name-only", sha).split():
                text = run_git(branched, "show", f"{sha}:{name}")
                break
        tops = {line.split()[1] for line in text.splitlines() if line.startswith("import ")}
        assert got[sha] == len({t for t in tops if t != "pkg0" and t not in sys.stdlib_module_names})


def follow(rows):
    """The files at the end with their commits, by going through the history in order."""
    at, seen, count = {}, {}, 0
    for seq in sorted({r[0] for r in rows}):
        now = [r for r in rows if r[0] == seq]
        old = dict(at)
        used = set()
        for _, s, path, _ in sorted(now, key=lambda r: r[2]):
            if s == "D" and path in old:
                seen[old[path]].add(seq)
                at.pop(path, None)
        for _, s, _, src in now:
            if s == "R":
                at.pop(src, None)
        for _, s, path, src in sorted(now, key=lambda r: r[2]):
            if s in "AC" or (s == "R" and (src not in old or old[src] in used)):
                count += 1
                at[path] = count
            elif s == "R":
                at[path] = old[src]
                used.add(old[src])
            elif s == "M" and path not in at:
                count += 1
                at[path] = count
            if s != "D":
                seen.setdefault(at[path], set()).add(seq)
    return sorted((p, s) for p, i in at.items() for s in seen[i])


def test_renames_chains_swaps_and_reused_names(spark):
    rows = [
        (0, "A", "a", None), (1, "A", "b", None), (2, "R", "c", "a"), (3, "M", "c", None), (4, "R", "b2", "b"), (4, "R", "c2", "c"),
        (5, "A", "a", None), (6, "R", "b2", "c2"), (6, "R", "c2", "b2"), (7, "M", "b2", None), (8, "D", "a", None), (9, "A", "a", None), (10, "M", "z", None), (11, "R", "y", "z"),
    ]
    table = spark.createDataFrame(rows, "seq long, status string, path string, old_path string")
    got = sorted(map(tuple, lineage.followed(table).collect()))
    assert got == follow(rows)
    assert [s for p, s in got if p == "b2"] == [0, 2, 3, 4, 6, 7]


@pytest.mark.parametrize("seed", range(2))
def test_random_histories(spark, seed):
    rng, rows, live, n = random.Random(seed), [], [], 0
    for seq in range(120):
        what = rng.random()
        if what < 0.25 or not live:
            path = f"p{rng.randint(0, 15)}"
            if path in live:
                rows.append((seq, "M", path, None))
            else:
                rows.append((seq, "A", path, None))
                live.append(path)
        elif what < 0.5:
            old, new = rng.choice(live), f"p{rng.randint(0, 15)}"
            if new not in live:
                rows.append((seq, "R", new, old))
                live[live.index(old)] = new
        elif what < 0.6:
            path = live.pop(rng.randrange(len(live)))
            rows.append((seq, "D", path, None))
        else:
            rows.append((seq, "M", rng.choice(live), None))
    table = spark.createDataFrame(rows, "seq long, status string, path string, old_path string")
    assert sorted(map(tuple, lineage.followed(table).collect())) == follow(rows)


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    links = spark.range(5000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("next"))
    rounds = []
    keep = lineage.written
    monkeypatch.setattr(lineage, "written", lambda df: rounds.append(1) or keep(df))
    assert lineage.ends_of(links).where("end != 0 or steps != id").count() == 0
    assert len(rounds) <= 15


def test_followed_equals_git_follow(spark, tmp_path):
    git = lambda *a: run_git(tmp_path, *a)
    git("init", "-q")
    body = "".join(f"line {k} of the file\n" for k in range(30))
    (tmp_path / "one.py").write_text(body)
    (tmp_path / "two.py").write_text("other\n" * 20)
    for k, step in enumerate([None, ("one.py", "sub.py"), None, ("sub.py", "last.py")]):
        if step:
            git("mv", *step)
        name = step[1] if step else ["one.py", "", "sub.py"][k]
        (tmp_path / name).write_text((tmp_path / name).read_text() + f"more {k}\n")
        git("add", ".")
        git("commit", "-qm", f"c{k}")
    commits = gitstore.commits(spark, str(tmp_path))
    changes = gitstore.changes(commits, str(tmp_path)).join(commits.select("sha", "seq"), "sha")
    got = lineage.followed(changes).join(commits.select("sha", "seq"), "seq").where("path = 'last.py'")
    assert sorted(r["sha"] for r in got.collect()) == sorted(git("log", "--follow", "--format=%H", "--", "last.py").split())
