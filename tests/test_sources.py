"""Source trees: roots, segments, import tables, seams, change sets, signatures; rules of the lookups on small rows."""

import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.operators import apidiff, graph, lookup, model, priority
from plumbline.plans import measure
from plumbline.sources import facts, files

UTIL = '''"""Rates."""
import os
import requests.auth
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import numpy
else:
    import yaml


class Rate:
    def __init__(self, kind, /, scale=1):
        self.kind = kind

    def of(self, a, *, b=None):
        return a

    def _hidden(self):
        pass


class RateAdapter(Rate):
    class Inner:
        pass


def to_rate(x: "é", y=(1, 2), *rest, **more):
    """É."""
    total = [x + y for y in rest if y > 0]
    return Rate(total, scale=len(more))
'''
ORDERS = "from .util import Rate, to_rate\nfrom shop.util import Rate as R\nimport util\nimport shop.util\n\n\ndef go():\n    return to_rate(1)\n"


@pytest.fixture(scope="module")
def extracted(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("a tree") / "shop"
    (root / "__pycache__").mkdir(parents=True)
    (root / "__init__.py").write_text("import flask\n")
    (root / "empty.py").write_text("")
    (root / "__pycache__" / "x.py").write_text("import junk\n")
    (root / "util.py").write_text(UTIL)
    (root / "orders.py").write_text(ORDERS)
    return root, facts.extract(files.source_files(spark, str(root)), segments=True)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_roots(spark, extracted, tmp_path):
    root, _ = extracted
    assert files.resolve_root(spark, str(root)) == str(root)
    assert files.count_python_files(spark, str(root)) == 4
    with pytest.raises(files.Refused, match="did you mean .*/shop"):
        files.resolve_root(spark, str(root.parent))
    with pytest.raises(files.Refused, match="not a folder"):
        files.resolve_root(spark, str(root / "util.py"))
    with pytest.raises(files.Refused, match="no such path"):
        files.resolve_root(spark, str(root / "none"))
    with pytest.raises(files.Refused, match="no Python file"):
        files.resolve_root(spark, str(tmp_path))


def test_segments_are_the_source(extracted):
    import ast

    _, f = extracted
    got = {r["name"]: r["text"] for r in facts.view(f, "segment").collect() if r["module"] == "util"}
    tree = ast.parse(UTIL)
    expected = {n.name: ast.get_source_segment(UTIL, n) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}
    assert got == expected


def test_import_tables(extracted):
    _, f = extracted
    assert rows(facts.third_party(f, "shop").drop("state")) == [("__init__", "flask"), ("orders", "util"), ("util", "requests"), ("util", "yaml")]
    assert rows(facts.bare_edges(f).drop("state")) == [("orders", "util")]
    assert rows(facts.bare_coupling(f).drop("state")) == [(1, 1)]
    # ".util" twice, "shop.util" twice, and each imported name below it once more
    assert rows(facts.import_strength(f, "shop").drop("state")) == [("shop.orders", "shop.util", 7)]
    assert rows(facts.import_edges(f, "shop").drop("state")) == [("shop.orders", "shop.util")]
    symbols = facts.imported_symbols(f, "shop").drop("state").fillna("-")
    assert rows(symbols) == [("shop.orders", "shop.util", s) for s in ("-", "Rate", "to_rate")]
    assert rows(facts.class_homes(f).drop("state")) == [("Rate", "util"), ("RateAdapter", "util")]
    assert rows(facts.translation_seams(f).drop("state")) == [("util",)]
    assert rows(facts.changed_functions(f, ["shop/util.py"]).select("qualname")) == [("util.to_rate",)]
    assert measure.architecture(f, "shop").first()["n_edges"] == 1


def test_signatures(extracted):
    _, f = extracted
    s = facts.view(f, "surface").where("module = 'util'")
    got = dict(s.select("name", apidiff.signature(F.col("params"), F.col("defaults"))).collect())
    assert got == {
        "util.Rate": "(kind, /, scale=1)",
        "util.Rate.of": "(a, *, b=None)",
        "util.RateAdapter": "()",
        "util.to_rate": "(x, y=(1, 2), *rest, **more)",
    }


def test_methods_count_in_their_class(spark):
    p = "array<struct<kind:string,name:string,has_default:boolean>>"
    table = lambda *rows: spark.createDataFrame([(s, k, [("normal", n, False) for n in names]) for s, k, names in rows], f"symbol string, kind string, params {p}")
    before = table(("m.A", "class", []), ("m.A.go", "method", ["x"]), ("m.A.kept", "method", []), ("m.B", "class", []), ("m.B.run", "method", []), ("m.f", "function", []))
    after = table(("m.A", "class", []), ("m.A.kept", "method", ["y"]), ("m.A.new", "method", []), ("m.f", "function", []), ("m.C", "class", []), ("m.C.run", "method", []))
    got = {r["symbol"]: (r["status"], r["breaking"], r["reasons"]) for r in apidiff.diff_with_methods(before, after).collect()}
    assert got == {
        "m.A": ("changed", True, ["kept: new required: y", "method added: new", "method removed: go"]),
        "m.B": ("removed", True, ["symbol removed"]),
        "m.C": ("added", False, []),
    }
    assert apidiff.verdict(apidiff.diff_with_methods(before, after)) == ("BREAKING", 1)
    assert apidiff.verdict(apidiff.diff_with_methods(before, before)) == ("COMPATIBLE", 0)


def test_change_sets(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for name in ("a.py", "b.py", "c.txt"):
        (tmp_path / name).write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    for name in ("a.py", "b.py", "c.txt"):
        (tmp_path / name).write_text("x = 2\n")
    git("add", "a.py")
    names = lambda **k: [p.rsplit("/", 1)[-1] for p in files.changed_files(spark, str(tmp_path), **k)]
    assert names(staged=True) == ["a.py"]
    assert names() == ["a.py", "b.py"]
    assert names(span="HEAD..HEAD") == []
    assert names(text="--- a/q.py\n+++ b/p/q.py\n+++ b/r.md\n") == ["q.py"]
    with pytest.raises(files.Refused):
        files.changed_files(spark, str(tmp_path), span="none..HEAD")
    with pytest.raises(files.Refused):
        files.changed_files(spark, str(tmp_path), span="--output=x")


def test_suffixes_prefer_the_longest(spark):
    paths = spark.createDataFrame([("r/src/shop/util.py",), ("shop/util.py",), ("myshop/util.py",), (None,), ("util.py",)], "path string")
    modules = spark.createDataFrame([("shop/util.py", "shop.util"), ("util.py", "b"), ("util.py", "a")], "suffix string, module string")
    assert rows(graph.suffix_match(paths, modules)) == [("myshop/util.py", "a"), ("r/src/shop/util.py", "shop.util"), ("shop/util.py", "shop.util"), ("util.py", "a")]


def test_standing_binds_only_live_decisions(spark):
    ratified = spark.createDataFrame([(1, "r1", "Use money.Round", "billing", "r2"), (2, "r2", "Use cash.Round", "billing", None), (3, "r3", "round up", None, None)], "at int, id string, text string, scope string, superseded_by string")
    candidates = spark.createDataFrame([("c1", "rate helper"), (None, None)], "id string, text string")
    at = lambda *a, **k: tuple(lookup.standing(ratified, candidates, *a, **k).first()[1:])
    assert at("ROUND") == ("RATIFIED", True, "r2")
    assert at("round", "sales") == ("RATIFIED", True, "r3")
    assert at("money") == ("NONE", False, None)
    assert at("rate") == ("CANDIDATE", False, "c1")
    assert at("rate", stale=True) == ("NONE", False, None)


def test_differences_of_points(spark):
    schema = "sha string, n int, r double, error string"
    want = spark.createDataFrame([("a", 1, 0.5, None), ("b", 2, None, None), ("c", 3, 0.1, None), ("d", 4, 0.1, None)], schema)
    got = spark.createDataFrame([("a", 1, 0.25, None), ("b", 2, 0.7, None), ("c", None, None, "gone"), ("e", 1, 1.0, None)], schema)
    assert rows(lookup.differences(want, got, ["sha"], ["n", "r"]).fillna("-")) == [
        ("a", "r", "0.5", "0.25"), ("c", "error", "-", "gone"), ("d", "present", "true", "false"), ("e", "present", "false", "true"),
    ]


def test_terms(spark):
    shapes = [("Orders", "a", ["id", "sum"]), ("order", "b", ["id", "total"]), ("order", "c", []), ("user", "a", ["id"]), ("users", "b", ["id", "n"]), ("data", "a", ["x"]), ("data", "b", ["y"]), ("order", "a", None)]
    table = spark.createDataFrame(shapes, "name string, module string, fields array<string>")
    seams = spark.createDataFrame([("b",)], "module string")
    assert [tuple(r) for r in priority.term_violations(table, seams).collect()] == [("order", ["a", "b", "c"], True)]
    assert priority.term_violations(table.limit(0)).collect() == []


def test_cluster_helpers(spark):
    members = [(1, "m.round.to_cents", ["to", "cents"]), (1, "m.cash.round", ["round"]), (1, "m.x.round_up", ["round", "up"]), (2, "z", [])]
    got = rows(model.cluster_helpers(spark.createDataFrame(members, "cluster int, qualname string, tokens array<string>")))
    assert got == [(1, "round", "m.cash.round", 3), (2, "", "z", 1)]


def test_names_and_locality(spark):
    ids = spark.createDataFrame([("shop.a",), ("shopper.a",), (None,)], "id string")
    assert [r[0] for r in lookup.bare_names(ids, "shop").collect()] == ["a", "shopper.a", None]
    m = spark.createDataFrame([(1, "a.x"), (1, "a.x"), (2, "a.x"), (2, "a.y"), (3, "a.x"), (3, "b"), (4, "c")], "cluster int, module string")
    assert rows(priority.cluster_scores(m)) == [(1, 2, 1, 2), (2, 2, 2, 4), (3, 2, 3, 6)]


def test_changed_defaults_are_told_and_break_nothing(spark):
    p = lambda name, has: ("normal", name, has)
    schema = f"symbol string, kind string, params {apidiff.PARAMS}, defaults array<string>"
    old = [("m.f", "function", [p("a", False), p("b", True)], [None, "1"]), ("m.g", "function", [p("a", True)], ["1"]), ("m.h", "function", [p("a", False)], [None])]
    new = [("m.f", "function", [p("a", False), p("b", True)], [None, "2"]), ("m.g", "function", [p("a", True)], ["1"]), ("m.h", "function", [p("a", False), p("c", True)], [None, "3"])]
    found = apidiff.diff_with_defaults(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert sorted(map(tuple, found.collect())) == [
        ("m.f", "changed", False, [], ["default of b: 1 to 2"]),
        ("m.h", "changed", False, [], ["new optional: c"]),
    ]
    assert apidiff.verdict(found) == ("COMPATIBLE", 0)
