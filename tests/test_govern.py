"""Sinks, governance plans and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import govern
from plumbline.sources import files, sinks
from plumbline.streaming import ledger as stream_ledger


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_budget_files(spark, tmp_path):
    path = str(tmp_path / "b")
    c = spark.createDataFrame([("m", 1.5, 3), ("n", 2.0, None)], "metric string, ceiling double, numerator long")
    with pytest.raises(files.Refused):
        sinks.load_budget(spark, path)
    with pytest.raises(files.Refused):
        sinks.save_budget(c, path, "")
    sinks.save_budget(c, path, "ana")
    assert rows(sinks.load_budget(spark, path)) == rows(c)
    for more in ({}, {"force": True}):
        with pytest.raises(files.Refused):
            sinks.save_budget(c, path, "ana", **more)
    sinks.save_budget(c, path, "ana", "new baseline", True)


def test_measurements(spark, tmp_path):
    counts = spark.createDataFrame([("dup", 3)], "signal string, raw long")
    sinks.write_measurement(counts, str(tmp_path / "m"), "tool", "1")
    assert rows(sinks.read_measurement(spark, str(tmp_path / "m"))) == [("dup", 3)]
    (tmp_path / "bad.json").write_text('{"schema": "measurement/1", "signal": "x"}\n')
    with pytest.raises(files.Refused):
        sinks.read_measurement(spark, str(tmp_path / "bad.json"))


def test_sarif_and_sample(spark, tmp_path):
    f = spark.createDataFrame([("CANDIDATE_COLLISION", "b.py", 0, "two"), ("RATIFIED_CONFLICT", "a.py", 4, "one")], "class string, file string, line int, message string")
    doc = json.loads(sinks.sarif(f).first()["sarif"])
    assert [(r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in doc["runs"][0]["results"]] == [("error", 4), ("note", 1)]
    sinks.write_sample(spark.createDataFrame([("a", "b", 0.5)], "a string, b string, score double"), str(tmp_path / "s"))
    assert rows(files.read_labels(spark, str(tmp_path / "s"))) == [("a", "b", 0.5, None)]


def test_managed_block():
    once = sinks.managed_block("head\n", "model: abc")
    assert sinks.block_hash(once) == "abc"
    assert sinks.managed_block(once + "tail", "model: d").endswith("tail")
    with pytest.raises(files.Refused):
        sinks.managed_block(sinks.BEGIN, "x")
    assert sinks.block_hash("none") is None


def test_anonymised(spark):
    df = spark.createDataFrame([("lib", "2026-01-03", "v1", 0.5), ("lib", "2026-01-09", "v1", 0.5)], "library string, day string, analyser string, ratio double")
    out = sinks.anonymised(df.withColumn("day", F.to_date("day")), ["ratio"])
    assert out.count() == 1
    assert "lib" not in str(out.first())
    with pytest.raises(files.Refused):
        sinks.anonymised(df.limit(1), ["ratio"])


def test_gate(spark):
    edges = spark.createDataFrame([("util", "handler"), ("handler", "util")], "src string, dst string")
    layers = spark.createDataFrame([("util", "low"), ("handler", "top")], "id string, layer string")
    ranks = spark.createDataFrame([("top", 0), ("low", 1)], "layer string, rank int")
    ballots = spark.createDataFrame([("c", "known")] * 4 + [("c", "other")] + [("d", "other")] * 5, "item string, match string")
    out = govern.gate(edges, layers, ranks, ballots, spark.createDataFrame([("known",)], "name string"))
    assert rows(out["layering"].select("src", "dst")) == [("util", "handler")]
    assert rows(out["clusters"].select("item", "status")) == [("c", "CLEARED"), ("d", "SURFACE")]
    assert govern.gate_status(1, True, 0, 1) == govern.CROSSED
    assert govern.gate_status(0, True, 2, 0) == govern.NOT_MEASURED


def test_advise(spark):
    sets = "id string, s array<long>, n int"
    base = spark.createDataFrame([("old.a", [1, 2, 3, 4], 4), ("old.b", [1, 2, 3, 5], 4), ("old.c", [9], 1)], sets)
    change = spark.createDataFrame([("new.x", [1, 2, 3, 4], 4), ("new.y", [9], 1), ("new.z", [7], 1)], sets)
    families = spark.createDataFrame([("old.a", 1), ("old.b", 1)], "id string, cluster long")
    ratified = spark.createDataFrame([("r1", "old.b", None), ("r0", "old.c", "r9")], "id string, reuse_site string, superseded_by string")
    got = {r["added"]: (r["class"], r["ratification"]) for r in govern.advise(base, change, families, ratified).collect()}
    assert got == {"new.x": ("RATIFIED_CONFLICT", "r1"), "new.y": ("CANDIDATE_COLLISION", None)}
    assert govern.advice_status(1, 2, True) == govern.CROSSED
    assert govern.advice_status(0, 2, True) == govern.ADVISORY
    assert govern.advice_status(0, 0, False) == govern.NOT_MEASURED


def test_answers(spark):
    facts = spark.createDataFrame(
        [("helper", "parse_date", ["parse", "date"], "Parses a date"), ("convention", "errors", ["errors"], "raise"), ("entity", "Order", ["order"], "")],
        "kind string, name string, tokens array<string>, doc string",
    )
    assert [tuple(r) for r in govern.answer(facts, "which helper can parse a date").collect()] == [("parse_date", 4)]
    assert [r["name"] for r in govern.answer(facts, "what conventions").collect()] == ["errors"]
    assert govern.answer(facts, "what is it").count() == 0


def test_options_and_globs(spark):
    assert govern.Options.of({"quorum": "3", "ignore": ["a"]}).quorum == 3
    with pytest.raises(ValueError, match="unknown"):
        govern.Options.of({"nope": 1})
    df = spark.createDataFrame([("a/gen/x.py",), ("a/b.py",), ("docs/c.py",), ("a/b_pb2.py",)], "path string")
    assert rows(govern.without_ignored(df, ("gen", "docs/", "*_pb2.py"))) == [("a/b.py",)]


def test_context_lines(spark):
    line = lambda *xs: spark.createDataFrame([(x,) for x in xs], "line string")
    ratified = spark.createDataFrame([("keep", None), ("gone", "r2")], "line string, superseded_by string")
    out = govern.context_lines(line("o"), line("c1", "c2", "c3"), ratified, most=2)
    assert rows(out) == [("CANDIDATE", "and 1 more"), ("CANDIDATE", "c1"), ("CANDIDATE", "c2"), ("OBSERVED", "o"), ("RATIFIED", "keep")]


def test_streamed_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"region": "a", "when": "1", "status": "open"}, {"region": "a", "when": "2", "status": "open"}, {"region": "a", "when": "3", "status": "closed", "closes": "1"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = stream_ledger.entries(spark, str(tmp_path / "in"))
    stream_ledger.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    q = stream_ledger.open_counts(stream).writeStream.outputMode("complete").format("memory").queryName("opened").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.sql("SELECT * FROM opened")) == [("a", 1)]
