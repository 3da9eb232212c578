"""Returned mappings, stripped guards, numbered logs, the whole composite and answers by kind."""

import json

import pandas as pd
import pytest

from plumbline.plans import govern, measure
from plumbline.sources import facts, files, gitstore, rewrite

RETURNS = {
    "a literal": ("def build(a):\n    return {'x': 1, 'y': {'z': 2}}", ["x", "y"]),
    "dict()": ("def build(a):\n    return dict(x=1, **a)", ["x"]),
    "a name": ("def build(a):\n    o = {'x': 1}\n    o['y'] = 2\n    o.update({'z': 3}, dict(w=1))\n    return o", ["w", "x", "y", "z"]),
    "other mappings": ("def build(a):\n    e = {'url': 1}\n    e['m'] = 2\n    o = dict(x=a)\n    return o", ["x"]),
    "several returns": ("async def build(a):\n    if a:\n        return {'x': 1}\n    o = {}\n    o['y'] = 1\n    return o", ["x", "y"]),
    "keys that are no text": ("def build(a):\n    o = {1: 2, a: 3, **a, 'x': 1}\n    o[a] = 1\n    o[2] = 1\n    return o", ["x"]),
    "nothing": ("def build(a):\n    return", []),
    "another function": ("def other(a):\n    return {'x': 1}", []),
    "no syntax": ("def build(a:\n", []),
    "nested": ("class A:\n    def build(self):\n        return {'x': 1}", ["x"]),
}


@pytest.mark.parametrize("name", RETURNS)
def test_returned_keys(name):
    text, keys = RETURNS[name]
    assert rewrite.returned_keys(text, "build") == keys


def test_aliases_are_followed_on_request():
    text = "def build(a):\n    o = {'x': 1}\n    p = o\n    q = p\n    q['y'] = 1\n    p = q\n    return q"
    assert rewrite.returned_keys(text, "build") == ["y"]
    assert rewrite.returned_keys(text, "build", aliases=True) == ["x", "y"]


GUARDS = {
    "plain": ("import a\nif TYPE_CHECKING:\n    import b\n    import c\nx = 1\n", "import a\npass\n\n\nx = 1\n"),
    "attribute and else": ("if typing.TYPE_CHECKING:\n    import b\nelse:\n    import c\ny = 'é'", "pass\n\n\n\ny = 'é'"),
    "line breaks kept": ("if TYPE_CHECKING:\r\n    import b\r\nx = 1\r\n", "pass\r\n\r\nx = 1\r\n"),
    "one line": ("if TYPE_CHECKING: import b\nx = 1", "pass\nx = 1"),
    "inside a class, tabs": ("class A:\n\tif TYPE_CHECKING:\n\t\timport b\n\n", "class A:\n\tpass\n\n\n"),
    "nested guards": ("if TYPE_CHECKING:\n    import b\n    if TYPE_CHECKING:\n        import c\nx = 1\n", "pass\n\n\n\nx = 1\n"),
    "other conditions": ("if not TYPE_CHECKING:\n    import b\nif A and TYPE_CHECKING:\n    import c\n", None),
    "no syntax": ("if TYPE_CHECKING:\nimport", None),
    "without a last line break": ("x = 1\nif TYPE_CHECKING:\n    import b", "x = 1\npass\n"),
}


@pytest.mark.parametrize("name", GUARDS)
def test_strip(name):
    text, expected = GUARDS[name]
    out, touched = rewrite.strip_type_checking(text)
    assert (out, touched) == ((text, False) if expected is None else (expected, True))
    assert rewrite.strip_type_checking(out) == (out, False)


def test_a_guard_among_branches_keeps_the_text_whole():
    text = "if x:\n    y = 1\nelif TYPE_CHECKING:\n    import b\nelse:\n    z = 1\nw = 2\n"
    assert rewrite.strip_type_checking(text) == ("if x:\n    y = 1\npass\n\n\n\nw = 2\n", True)


def test_a_result_that_no_longer_parses_is_refused(monkeypatch):
    class Whole:  # a place that covers the head of a block alone
        lineno = end_lineno = 1

    monkeypatch.setattr(rewrite, "_guards", lambda tree: [Whole])
    with pytest.raises(rewrite.Unparsable):
        rewrite.strip_type_checking("if TYPE_CHECKING:\n    import b\n")


def test_strip_over_rows(spark):
    df = spark.createDataFrame([("s", "a.py", GUARDS["plain"][0]), ("s", "b.py", None)], "state string, path string, text string")
    got = {r["path"]: (r["text"], r["stripped"]) for r in rewrite.without_type_checking(df).collect()}
    assert got == {"a.py": (GUARDS["plain"][1], True), "b.py": ("", False)}


def test_lines_of_a_file_in_many_parts(spark, tmp_path):
    lines, bad = [], []
    for k in range(1, 3001):
        if k % 700 == 0:
            lines.append(["not json", "[1, 2]", '"text"', '{"region": '][k // 700 % 4])
            bad.append(k)
        elif k % 11 == 0:
            lines.append("")
        else:
            lines.append(json.dumps({"region": f"r{k}", "n": k}))
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"region": "x", "n": 1}\n[]\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows, malformed = files.read_numbered_log(spark, str(tmp_path), "region string, n long")
        got = [(r["line"], r["n"]) for r in rows.collect() if r["file"].endswith("a.jsonl")]
        assert len(got) > 2500 and all(a == b for a, b in got)
        assert sorted(r["line"] for r in malformed.collect() if r["file"].endswith("a.jsonl")) == bad
        note = {r["file"][-7:]: (r["n"], r["lines"]) for r in files.malformed_note(malformed, 3).collect()}
        assert note == {"a.jsonl": (4, "700, 1400, 2100"), "b.jsonl": (1, "2")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_measure_all(spark):
    rows = [("s", f"{m}.py", m, t) for m, t in (("a", "import pkg.b\nimport requests\nimport os\n"), ("b", "import requests\nimport numpy\n"), ("c", "x = 1\n"))]
    found = facts.extract(spark.createDataFrame(rows, "state string, path string, module string, text string"))
    touched = [("s", k, f"pkg.{m}") for k in range(4) for m in ("a", "b", "c")] + [("s", 9, "pkg.a")]
    touches = spark.createDataFrame(touched, "state string, basket long, item string")
    got = {r["metric"]: r["value"] for r in measure.measure_all(found, "pkg", touches).collect()}
    assert (got["third_party_imports"], got["single_use_third_party"], got["max_fan_in"]) == (2, 1, 1)
    assert got["hyperliminal_pairs"] == 2  # a-c and b-c; a-b have an edge
    assert got["contagion_mean"] == 13 / 5
    unread = {r["metric"]: (r["value"], r["error"]) for r in measure.measure_all(found, "pkg", None, "git is missing").collect()}
    assert unread["hyperliminal_pairs"] == (0.0, "git is missing") and unread["n_edges"] == (1.0, None)


def test_answers_by_kind(spark):
    make = spark.createDataFrame
    model = {
        "functions": make([("m.parse_date", ["parse", "date"], "reads a date"), ("m.other", ["other"], "")], "qualname string, tokens array<string>, doc string"),
        "entities": make([("Order", ["order"]), ("User", ["user"])], "name string, tokens array<string>"),
        "modules": make([("billing.tax", ["billing", "tax"])], "module string, tokens array<string>"),
        "conventions": make([("PENDING", ["a", "b"])], "value string, modules array<string>"),
        "helpers": make([("date", ["date"], "m.parse_date")], "concept string, tokens array<string>, site string"),
    }
    names = lambda q: sorted(r["name"] for r in govern.answer_by_kind(model, q).collect())
    kinds = lambda q: {r["kind"] for r in govern.answer_by_kind(model, q).collect()}
    assert names("parse a date") == ["m.parse_date"] and kinds("parse a date") == {"concept"}
    live = make([("use money", None), ("old", "r2")], "name string, superseded_by string")
    rows = govern.answer_by_kind(model, "parse a date", live).collect()
    assert sorted((r["label"], r["name"]) for r in rows) == [("OBSERVED", "m.parse_date"), ("RATIFIED", "use money")]


def test_many_small_files_share_frames():
    pdf = pd.DataFrame([(str(k), "p", f"m{k}", "import a\n") for k in range(3_000)], columns=["state", "path", "module", "text"])
    made = list(facts.frames(iter([pdf, pdf])))
    assert len(made) == 1
    assert len(made[0]) == 12_000
    long = pdf.head(3).assign(text="x = '" + "y" * facts.FRAME_CHARS + "'\n")
    assert [len(m) for m in facts.frames(iter([long]))] == [2, 2, 2]


def test_each_content_is_stripped_once(spark):
    rows = [(str(k % 3), f"o{k}.py", None if k % 5 == 4 else "if TYPE_CHECKING:\n    import b\n" if k % 2 else "import a\n") for k in range(60)]
    made = spark.createDataFrame(rows, "state string, path string, text string")
    placed, contents = gitstore.stripped_by_content(made)
    assert sorted(r["text"] for r in contents.collect()) == ["", "import a\n", "pass\n\n"]
    got = {r["path"]: r["stripped"] for r in placed.collect()}
    plain = {r["path"]: r["stripped"] for r in rewrite.without_type_checking(made).collect()}
    assert got == plain
    assert len(got) == 60
