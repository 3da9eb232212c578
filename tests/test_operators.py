"""Operators on small fixtures whose results are known."""

import datetime as dt
import json
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.operators import apidiff, budget, calibrate, cochange, compare, graph, history, ledger, model, similarity, stats
from plumbline.operators.components import connected_components
from plumbline.plans import measure, queries
from plumbline.sources import facts, files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)]
    df = spark.createDataFrame(chain, "src long, dst long")
    assert rows(connected_components(df)) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    assert connected_components(df.limit(0)).count() == 0


def test_similarity_join_is_exact(spark):
    import random

    rng = random.Random(2)
    sets = {i: {rng.randint(0, 30) for _ in range(rng.randint(1, 12))} for i in range(60)}
    sets[61] = set(sets[3])
    df = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in sets.items()], "id long, s array<long>, n int")
    for least in (0.2, 0.45, 0.8, 1.0):
        expected = []
        for a in sets:
            for b in sets:
                inter, uni = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if a < b and inter / uni >= least:
                    expected.append((a, b, inter, uni, inter / uni))
        assert rows(similarity.similar_pairs(df, least)) == sorted(expected)


def test_short_and_empty_items(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a b c")], "doc_id long, text string")
    sets = similarity.document_sets(df, gram=5, least=2)
    assert rows(sets.select("id", "n")) == [(3, 1), (4, 1)]
    one = similarity.snapshot(sets.limit(0), similarity.similar_pairs(sets.limit(0))).first()
    assert tuple(one) == (0, 0, 0, 0.0)


def test_documents_count_every_copy(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([*((i, text) for i in range(1000)), (1000, text + " x"), (1001, " ".join(f"v{i}" for i in range(12))), (1002, "short")], "doc_id long, text string")
    sets = similarity.document_sets(df)
    pairs = similarity.similar_pairs(sets)
    assert tuple(similarity.document_snapshot(sets, pairs).first()) == (1002, 1, 1001, 1001 / 1002)
    assert rows(similarity.class_pairs(sets, pairs)) == [(0, 0, 499500, 16, 16, 1.0), (0, 1000, 1000, 16, 17, 16 / 17)]
    assert rows(similarity.document_clusters(sets, pairs)) == [(0, 0, 1000), (1000, 0, 1)]
    assert rows(similarity.document_members(df)) == sorted([(i, 0) for i in range(1000)] + [(1000, 1000), (1001, 1001)])
    alone = similarity.document_sets(df.where("doc_id < 1000"))
    assert tuple(similarity.document_snapshot(alone, similarity.similar_pairs(alone)).first()) == (1000, 1, 1000, 1.0)


def test_collisions_of_a_text_on_both_sides(spark, tmp_path):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "wv")
    docs = [(1, one, "src3"), (2, one, "src1"), (3, one + " x", "src1"), (4, two, "src1"), (5, two, "src3"), (6, two + " x", "src1"), (7, two, "src3")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = rows(queries.change_collisions_by_side(spark, str(tmp_path)))
    assert found == [(1, 2, 1, 1, 1.0), (1, 3, 1, 1, 16 / 17), (5, 4, 2, 1, 1.0), (5, 6, 2, 1, 16 / 17)]


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "g")]
    df = spark.createDataFrame([("s", *e) for e in edges], "state string, src string, dst string")
    expected = [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f"), ("g", "g")]
    assert rows(graph.strong_components(df)) == expected
    assert rows(graph.strong_components_by(df, "state")) == [("s", *e) for e in expected]


def test_prefix_and_distance(spark):
    modules = spark.createDataFrame([("p",), ("p.a",), ("p.a.b",)], "module string")
    targets = spark.createDataFrame([("p.a.b.c",), ("p.x",), ("q",), ("p.a",)], "target string")
    assert rows(graph.resolve_prefix(targets, modules)) == [("p.a", "p.a"), ("p.a.b.c", "p.a.b"), ("p.x", "p")]
    df = spark.createDataFrame([("a.b.c", "a.b.d"), ("a", "a"), ("a", "b.c")], "x string, y string")
    assert [r[0] for r in df.select(scalar.tree_distance(F.col("x"), F.col("y"))).collect()] == [2, 0, 3]


def test_tighten_step(spark):
    metrics = [
        ("s", "count", 3.0, None, None), ("s", "same", 5.0, None, None), ("s", "up", 9.0, None, None), ("s", "r_ok", 0.2, 2, 10),
        ("s", "r_rose", 0.2, 5, 25), ("s", "r_held", 0.2, 4, 20), ("s", "r_old", 0.2, 2, 10), ("s", "r_none", 0.0, 0, 0), ("s", "null", None, None, None),
    ]
    ceilings = [("count", 4.0, None), ("same", 5.0, None), ("up", 8.0, None), ("r_ok", 0.4, 4), ("r_rose", 0.4, 4), ("r_held", 0.4, 4), ("r_old", 0.4, None), ("r_none", 0.4, 4), ("null", 1.0, None)]
    m = spark.createDataFrame(metrics, "state string, metric string, value double, numerator long, denominator long")
    c = spark.createDataFrame(ceilings, "metric string, ceiling double, numerator long")
    got = {r["metric"]: tuple(r)[1:] for r in budget.tighten(m, c, ["r_ok", "r_rose", "r_held", "r_old", "r_none"]).collect()}
    assert got == {
        "count": (3.0, None, "tightened"), "same": (5.0, None, "stands"), "up": (8.0, None, "stands"), "r_ok": (0.2, 2, "tightened"),
        "r_rose": (0.4, 4, "declined: numerator rose"), "r_held": (0.4, 4, "declined: numerator held"), "r_old": (0.4, None, "declined: no numerator"),
        "r_none": (0.4, 4, "declined: nothing measured"), "null": (1.0, None, "unmeasured"),
    }
    assert [r["metric"] for r in budget.breaches(m, c).collect()] == ["up"]
    assert budget.state_of(1, False, 3, True) == "crossed"
    assert budget.state_of(0, False, 3, True) == "tightened"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 9)), min_size=1, max_size=12))
def test_tighten_sequence_never_loosens(spark, series):
    points = [("k", i, a / b, a) for i, (a, b) in enumerate(series)]
    df = spark.createDataFrame(points, "key string, seq long, value double, numerator long")
    got = sorted(budget.tighten_sequence(df).collect(), key=lambda r: r["seq"])
    ceiling, floor = points[0][2], points[0][3]
    for r, (_, _, v, n) in zip(got, points, strict=True):
        if v < ceiling and n < floor:
            ceiling, floor = v, n
        assert (r["ceiling"], r["floor_numerator"]) == (ceiling, floor)


def test_ledger_refusals():
    entry = {"owner": "a", "repayment_trigger": "t", "review_date": "2026-01-01", "confidence": "high", "repayment_feasibility": "easy", "evidence": ["x"]}
    assert ledger.check_entry({**entry, "needs_assessment": True})
    with pytest.raises(ledger.Refused):
        ledger.check_entry(entry)
    with pytest.raises(ledger.Refused):
        ledger.check_entry({**entry, "needs_assessment": True, "owner": ""})


def test_ledger_closing_is_idempotent(spark):
    log = spark.createDataFrame([("r", "1", "open", None), ("r", "2", "open", None), ("q", "3", "open", None)], "region string, when string, status string, closes string")
    closing = ledger.closing_rows(log, "r", "me", "done", "9")
    assert closing.count() == 2
    after = log.unionByName(closing.select(*log.columns))
    assert rows(ledger.open_entries(after).select("when")) == [("3",)]
    assert ledger.closing_rows(after, "r", "me", "done", "10").count() == 0
    empty = ledger.report(spark.createDataFrame([], "region string, when string, status string, closes string, owner string, repayment_trigger string, review_date string"), dt.date(2026, 1, 1)).first()
    assert empty["coverage"] == 1.0


def test_even_sample(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "seq long")
    for n in (2, 3, 7, 8, 100, 101, 500):
        expected = sorted({round(i * 100 / (n - 1)) for i in range(n)}) if n < 101 else list(range(101))
        assert [r[0] for r in sorted(history.even_sample(df, n).collect())] == expected
    assert history.even_sample(df, 1).first()[0] == 100
    assert history.even_sample(df.limit(0), 5).count() == 0


def test_votes_and_agreement(spark):
    ballots = [("five", "x")] * 5 + [("three", "x")] * 3 + [("three", "y")] * 2 + [("failed", None)] * 5 + [("four", "x")] * 4 + [("four", None)]
    df = spark.createDataFrame(ballots, "item string, match string")
    got = {r["item"]: (r["top"], r["votes"], r["status"]) for r in stats.votes(df, 4).collect()}
    assert got == {"five": ("x", 5, "CLEARED"), "three": ("x", 3, "SURFACE"), "failed": ("NONE", 5, "SURFACE"), "four": ("x", 4, "CLEARED")}
    agreed = {r["item"]: (r["majority"], r["pairwise"]) for r in stats.agreement(df).collect()}
    assert agreed["four"] == (0.8, 0.6)


def test_rank_auc(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True), (None, True)], "score double, positive boolean")
    assert tuple(stats.rank_auc(df).first()) == (2, 2, 7, 7 / 8)
    assert stats.rank_auc(df.limit(0)).first()["auc"] is None


def test_calibration(spark):
    labelled = [(0.50 + (i % 10) * 0.03, "same") for i in range(60)] + [(0.10 + (i % 12) * 0.03, "different") for i in range(60)] + [(0.9, "unsure"), (0.9, None)]
    df = spark.createDataFrame(labelled, "score double, label string")
    points = {round(r["threshold"], 2): r for r in calibrate.curve(df).collect()}
    assert (points[0.5]["precision"], points[0.5]["recall"]) == (1.0, 1.0)
    assert points[0.2]["fn"] == 0
    found = calibrate.best(calibrate.curve(df)).first()
    assert found["best_f1_threshold"] == 0.45
    with pytest.raises(calibrate.TooFewLabels):
        calibrate.curve(df.limit(99))
    none = spark.range(1).select(*scalar.wilson(F.lit(0), F.lit(0)), *scalar.wilson(F.lit(8), F.lit(10))).first()
    assert tuple(none)[:2] == (0.0, 0.0)
    assert tuple(none)[2:] == (0.49, 0.943)


def test_comparison(spark):
    cases = compare.seed_cases(spark, {"x": "int", "y": "bool"})
    assert cases.count() == 18
    assert compare.compare(cases, F.col("x") * 2, F.col("x") + F.col("x"))["verdict"] == "NO_DIVERGENCE_FOUND"
    bad = compare.compare(cases, F.col("x"), F.abs("x"))
    assert bad["verdict"] == "REFUTED"
    assert [c["x"] for c in bad["counterexamples"]] == [-1, -1]
    assert compare.seed_cases(spark, {"x": "bytes"}) is None
    assert compare.compare(None, F.lit(1), F.lit(1))["verdict"] == "UNPROVEN"
    five = compare.compare(cases, F.lit(1), F.lit(2))
    assert five["cases_run"] == 5


def test_positional_rules(spark):
    p = lambda kind, name, default=False: {"kind": kind, "name": name, "has_default": default}
    schema = f"symbol string, kind string, params {apidiff.PARAMS}"
    before = spark.createDataFrame([("f", "function", [p("normal", "a"), p("normal", "b")]), ("g", "function", [p("posonly", "a")]), ("h", "function", [p("normal", "a")])], schema)
    after = spark.createDataFrame([("f", "function", [p("normal", "b"), p("normal", "a")]), ("g", "function", [p("posonly", "renamed")]), ("h", "function", [p("posonly", "a")])], schema)
    got = {r["symbol"]: (r["breaking"], r["reasons"]) for r in apidiff.diff_surfaces(before, after).collect()}
    assert got["f"] == (True, ["moved: a", "moved: b"])
    assert got["g"] == (False, [])
    assert got["h"] == (True, ["now positional-only: a"])


def test_ratify(spark):
    schema = "id string, candidate_id string, kind string, contract string, scope string, approved_by string, approved_at date, revision int, superseded_by string, superseded_at date"
    new = "id string, candidate_id string, kind string, contract string, scope string, approved_by string, approved_at date"
    day = dt.date(2026, 1, 1)
    first = model.ratify(spark.createDataFrame([], schema), spark.createDataFrame([("d1", "c", "k", "{}", "all", "ana", day)], new))
    second = model.ratify(first, spark.createDataFrame([("d2", "c", "k", "{}", "all", "bo", day)], new))
    assert rows(second.select("id", "revision", "superseded_by")) == [("d1", 1, "d2"), ("d2", 2, None)]
    assert rows(model.live(second).select("id")) == [("d2",)]
    with pytest.raises(model.Refused):
        model.ratify(first, spark.createDataFrame([("d3", "c", "k", "{}", "", "bo", day)], new))
    with pytest.raises(model.Refused):
        model.ratify(first, first.limit(0).select("id", "candidate_id", "kind", "contract", "scope", "approved_by", "approved_at"), "a", "b")


def test_model_hash_ignores_order(spark):
    df = spark.createDataFrame([(i, f"n{i % 7}") for i in range(50)], "a long, b string")
    one, two = (model.model_hash(x, ["a", "b"]).first() for x in (df, df.orderBy(F.desc("a")).repartition(3)))
    assert one == two
    assert model.model_hash(df.union(df.limit(1)), ["a", "b"]).first() != one


def test_names(spark):
    df = spark.createDataFrame([("parseHTTPResponse_v2",), ("__init__",), (None,), ("categories",)], "n string")
    assert [r[0] for r in df.select(scalar.identifier_words(F.col("n"))).collect()] == [["parse", "http", "response", "v", "2"], ["init"], [], ["categories"]]
    words = spark.createDataFrame([(w,) for w in ("categories", "boxes", "users", "bus", "ties", "is")], "w string")
    assert [r[0] for r in words.select(scalar.singular(F.col("w"))).collect()] == ["category", "box", "user", "bus", "tie", "is"]
    dates = spark.createDataFrame([("by 2026-02-30",), ("on 2026-03-01 or 2027-01-01",), (None,)], "t string")
    assert [r[0] for r in dates.select(scalar.first_date(F.col("t"))).collect()] == [None, dt.date(2026, 3, 1), None]


# --- source trees ------------------------------------------------------------------------

TREE = {
    "shop/__init__.py": "",
    "shop/orders.py": '''
from shop import prices
from .util import rate
STATE = "PENDING"

def total(order):
    out = 0
    for line in order["lines"]:
        out = out + line.price * rate(line.kind) - line.discount
    return round(out, 2)
''',
    "shop/prices.py": '''
import shop.orders
import requests
STATE = "PENDING"

def amount(invoice):
    out = 0
    for line in invoice["items"]:
        out = out + line.price * rate(line.kind) - line.discount
    return round(out, 2)

def tiny():
    return 1
''',
    "shop/util.py": '''
from typing import TYPE_CHECKING
from dataclasses import dataclass
if TYPE_CHECKING:
    import numpy
LIMIT = 5000

@dataclass
class Rate:
    kind: str
    value: float

def rate(kind, *, scale=1):
    """Rate of a kind."""
    return scale
''',
    "shop/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "shop/__pycache__").mkdir()
    (root / "shop/__pycache__/x.py").write_text("x = 1")
    return root


def test_source_tree(spark, tree):
    found = files.source_files(spark, str(tree / "shop"))
    assert rows(found.select("module")) == [("",), ("broken",), ("orders",), ("prices",), ("util",)]
    extracted = facts.extract(found)
    functions = {r["qualname"]: r for r in facts.functions(extracted).collect()}
    assert set(functions) == {"orders.total", "prices.amount"}
    assert functions["orders.total"]["calls"] == ["rate", "round"]
    assert rows(facts.import_edges(extracted, "shop").select("src", "dst")) == [
        ("shop.orders", "shop"), ("shop.orders", "shop.prices"), ("shop.orders", "shop.util"), ("shop.prices", "shop.orders"),
    ]
    assert facts.view(extracted, "unreadable").count() == 1
    assert rows(facts.view(extracted, "import").where("not runtime").select("target")) == [("numpy",)]
    rate = facts.view(extracted, "class").first()
    assert (rate["shape"], rate["fields"], rate["is_abstract"]) == ("dataclass", ["kind", "value"], False)
    assert rows(facts.view(extracted, "key").select("name", "key", "n")) == [("invoice", "items", 1), ("order", "lines", 1)]
    surface = {r["name"]: r["params"] for r in facts.view(extracted, "surface").collect()}
    assert [tuple(p) for p in surface["util.rate"]] == [("normal", "kind", False), ("kwonly", "scale", True)]
    metrics = {r["metric"]: (r["value"], r["numerator"], r["denominator"]) for r in measure.metrics(extracted, "shop").collect()}
    assert metrics["redundant_clusters"][0] == 1
    assert metrics["duplication_ratio"] == (1.0, 2, 2)
    assert metrics["cycle_ratio"] == (0.4, 2, 5)
    assert metrics["connascence_shared"][0] == 1
    ceilings = budget.budget_of(measure.metrics(extracted, "shop"), measure.WATCHED, measure.RATIOS)
    assert measure.check(measure.metrics(extracted, "shop"), ceilings).first()["status"] == "held"


def test_body_tokens():
    import ast

    def of(src):
        return facts.body_tokens(ast.parse(src).body[0])

    assert of("def f(x):\n    return g(x).y(1)") == ["Return", "CALL", "CALLEE_y", "CALL", "CALLEE_g", "NAME", "Load", "CONST_int"]
    assert of("def f(x):\n    x[0](1)") == ["Expr", "CALL", "Call", "Subscript", "NAME", "Load", "CONST_int", "Load", "CONST_int"]


def test_empty_tree_is_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(files.Refused):
        files.source_files(spark, str(tmp_path))


def test_logs_and_counts(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"region": "a"}\n\nnot json\n[1]\n{"region": "b"}\n')
    good, bad = files.read_log(spark, str(tmp_path / "log.jsonl"), "region string")
    assert rows(good) == [("a",), ("b",)]
    assert bad.count() == 2
    finding = {"signal": "dup", "file": "a.py", "start_line": 3, "title": "t", "fingerprint": "f"}
    body = {"baseline_version": 1, "drift_version": "2", "finding_count": 2, "findings": [finding, {**finding, "start_line": 9}]}
    path = tmp_path / "drift.json"
    path.write_text(json.dumps(body))
    assert rows(files.import_counts(spark, str(path))) == [("dup", 2, ["a.py:3", "a.py:9"])]
    for change in ({"finding_count": 3}, {"baseline_version": 7}, {"findings": None}):
        path.write_text(json.dumps({**body, **change}))
        with pytest.raises(files.Refused):
            files.import_counts(spark, str(path))


def test_diff_and_verdicts(spark):
    lines = spark.createDataFrame([("+++ b/a/b.py",), ("+++ c.py",), ("+++ b/x.txt",), ("+x",)], "value string")
    assert rows(files.added_paths(lines)) == [("a/b.py",), ("c.py",)]
    said = spark.createDataFrame([('so {"verdict": " Sanctioned", "why": {"a": 1}} ok',), ('{"verdict": "maybe"}',), ("none",), (None,)], "t string")
    assert [r[0] for r in said.select(files.verdict(F.col("t"))).collect()] == ["SANCTIONED", "UNPARSEABLE", "UNPARSEABLE", "UNPARSEABLE"]


def test_git_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(3):
        (tmp_path / f"f{i % 2}.py").write_text(str(i))
        git("add", ".")
        git("commit", "-qm", f"c{i}")
    spark.dataSource.register(files.GitLog)
    log = spark.read.format("gitlog").option("repo", str(tmp_path)).load()
    assert [r["seq"] for r in log.orderBy("seq").collect()] == [0, 1, 2]
    touched = spark.read.format("gitlog").option("repo", str(tmp_path)).option("files", "true").load()
    assert rows(touched.groupBy("path").count()) == [("f0.py", 2), ("f1.py", 1)]


def test_history_of_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    (tmp_path / "README").write_text("x")
    git("add", ".")
    git("commit", "-qm", "nothing yet")
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("from pkg import b\n")
    (tmp_path / "pkg/b.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "two modules")
    (tmp_path / "pkg/b.py").write_text("import pkg.a\n")
    git("commit", "-qam", "a cycle")
    head = git("rev-parse", "HEAD")
    out = measure.measure_history(spark, str(tmp_path), "pkg", 3, "pkg")
    cycles = sorted((r["seq"], r["value"], r["error"] is not None) for r in out.where("metric = 'cycle_ratio' or error is not null").collect())
    assert cycles == [(0, None, True), (1, 0.0, False), (2, 1.0, False)]
    assert git("rev-parse", "HEAD") == head


def test_fixed_values(spark):
    """Typed once more here, so that an altered constant shows."""
    from plumbline.operators import calibrate, signals, stats

    one = spark.range(1)
    scores = [0.0, 0.19, 0.2, 0.34, 0.35, 0.44, 0.45, 0.59, 0.6, 0.79, 0.8, 1.0]
    got = spark.createDataFrame([(x,) for x in scores], "s double").select("s", calibrate.band(F.col("s"))).collect()
    assert [r[1] for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert calibrate.WEIGHTS == (1, 2, 4, 4, 2, 1) and calibrate.THRESHOLDS[0] == 0.2 and calibrate.THRESHOLDS[-1] == 0.8
    kinds = {"which constants are shared": "convention", "what shape has an order": "entity", "which layer imports this": "module", "does a helper exist": "helper", "rounding of money": "concept"}
    for text, kind in kinds.items():
        assert one.select(signals.route(F.lit(text))).first()[0] == kind
    assert signals.subject_words("Which helper rounds money2cents, and which money?") == ["rounds", "money", "2", "cents", "money"]
    numbers = [("1000", False), ("2", False), ("0.5", False), ("-3", True), ("3", True), ("999", True)]
    got = spark.createDataFrame(numbers, "t string, e boolean").select("e", signals.significant(F.lit("int"), F.col("t"))).collect()
    assert all(r[0] == r[1] for r in got)
    cases = compare.seed_cases(spark, {"x": "float"})
    assert [r["x"] for r in cases.orderBy("case").collect()] == [0.0, 0.5, 0.05, 0.005, -0.5, 1.5, 2.5, 12.5, 0.125, 0.135, 1.005, 2.675, 99.995]
    assert compare.seed_cases(spark, {"x": "int", "y": "list", "z": "dict", "s": "str"}).count() == 9 * 3 * 2 * 6
    assert [one.select(stats.modularity_tier(F.lit(x))).first()[0] for x in (3.9, 4.0, 6.0, 7.5)] == ["critical", "high", "moderate", "low"]


def test_body_tokens_of_contexts_and_calls():
    import ast

    text = "def f(a):\n    def g(b: int): return b.c\n    x = h(a, k=1)\n    return m.n(x)(2)\n"
    assert facts.body_tokens(ast.parse(text).body[0]) == (
        "FunctionDef arguments ARG NAME Load Return ATTR_c NAME Load Load "
        "Assign NAME Store CALL CALLEE_h NAME Load keyword CONST_int "
        "Return CALL Call CALL CALLEE_n NAME Load NAME Load CONST_int"
    ).split()


def test_member_pairs_that_never_met_are_counted_not_listed(spark):
    n = 100_000  # 5 thousand million pairs
    members = spark.range(n).selectExpr("0 AS cluster", "id AS item").union(spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3), (2, 5), (None, 1), (None, 2)], "cluster int, item long"))
    touches = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (2, None), (3, 1), (3, 5), (4, 200_000), (None, 1), (None, 3)], "basket int, item long")
    got = sorted(map(tuple, cochange.cluster_cochange(members, touches).collect()))
    assert [g[:3] for g in got] == [(0, n * (n - 1) // 2, 2 / 3), (1, 3, 2 / 3)]
    assert got[0][3] == pytest.approx((2 / 3 + 1 / 3) / (n * (n - 1) / 2))
    assert got[1][3] == pytest.approx(2 / 9)


def test_collisions_do_not_form_pairs_over_a_common_feature(spark):
    n = 60_000  # 3,600 million pairs share the feature 0
    side = lambda base: spark.range(n).select((F.col("id") + base).alias("id"), F.array(F.lit(0), F.col("id") * 9 + base + 1, F.col("id") * 9 + base + 2).cast("array<bigint>").alias("s"), F.lit(3).alias("n"))
    same = lambda k: spark.createDataFrame([(k, [0, -1, -2], 3)], "id long, s array<bigint>, n int")
    found = similarity.change_collisions(side(10_000_000).union(same(1)), side(20_000_000).union(same(2)))
    assert rows(found) == [(2, 1, 1.0)]


def test_whole_sets_are_never_written(spark, monkeypatch):
    kept = []
    put = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: kept.append(df.columns) or put(df))
    monkeypatch.setattr(similarity, "cut", None)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words), "x"), (2, " ".join(words), "y"), (3, " ".join(words[:-1]), "z"), (4, "few words", "x")], "doc_id long, text string, source string")
    sets = similarity.document_sets(docs, also="source")
    assert rows(sets.select("id", "copies", "n", "source")) == [(1, 2, 36, "x"), (3, 1, 35, "z")]
    assert rows(similarity.similar_pairs(sets)) == [(1, 3, 35, 36, 35 / 36)]
    assert kept
    assert not any("s" in columns for columns in kept)


def test_grams_are_distinct_runs():
    a, b = [1, 2, 3, 1, 2, 3, 1], [2, 3, 1]
    assert len(similarity.grams(a, 3)) == 3
    assert set(similarity.grams(b, 3)) <= set(similarity.grams(a, 3))
    assert len(similarity.grams([1, 2], 3)) == 1
    assert len(similarity.grams([], 3)) == 0
    assert set(similarity.grams([1, 2], 2)).isdisjoint(similarity.grams([2, 1], 2))
