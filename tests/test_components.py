"""Strong components of one graph and of many at once, against a search; rounds on long lines."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph


def by_search(edges):
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in links[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    far = {v: reach(v) for v in links}
    return {v: min(w for w in far[v] if v in far[w]) for v in links}


SHAPES = {
    "ring": [(k, (k + 1) % 9) for k in range(9)],
    "rings on a line": [(3 * k + j, 3 * k + (j + 1) % 3) for k in range(6) for j in range(3)] + [(3 * k, 3 * k + 4) for k in range(5)],
    "line back to its start": [(k, k + 1) for k in range(12)] + [(12, 0), (4, 20), (20, 21), (21, 6), (8, 30), (31, 8), (5, 5)],
    "two ways": [(0, 1), (1, 0), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (9, 8), (8, 10)],
    "tree": [(k, (k - 1) // 2) for k in range(1, 31)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes_without_the_single_task(spark, name):
    df = spark.createDataFrame(SHAPES[name], "src long, dst long")
    assert {r["id"]: r["scc"] for r in graph.strong_components(df, few=0).collect()} == by_search(SHAPES[name])


def test_random_graphs_at_once(spark):
    rng = random.Random(4)
    rows = [(f"g{g}", f"v{rng.randrange(25):02}", f"v{rng.randrange(25):02}") for g in range(6) for _ in range(10 + 6 * g)]
    expected = {(g, v): s for g in {r[0] for r in rows} for v, s in by_search([r[1:] for r in rows if r[0] == g]).items()}
    df = spark.createDataFrame(rows, "state string, src string, dst string")
    for few in (0, graph.FEW):
        assert {(r["state"], r["id"]): r["scc"] for r in graph.strong_components_by(df, "state", few).collect()} == expected


def test_nothing(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "src long, dst long")
    assert graph.strong_components(df).collect() == []


def test_rounds_on_a_line_and_a_ring_of_ten_thousand(spark, monkeypatch):
    rounds = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or keep(df))
    line = spark.range(10_000).select(F.lit("a").alias("state"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.range(10_000).select(F.lit("b").alias("state"), F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    sizes = graph.strong_components_by(line.union(ring), "state", 0).groupBy("state", "scc").count().groupBy("state").agg(F.count("*").alias("n"), F.max("count").alias("m"))
    assert sorted(map(tuple, sizes.collect())) == [("a", 10_001, 1), ("b", 1, 10_000)]
    assert len(rounds) < 35
