"""Connected components over an edge table: joins and aggregations, and one task once few edges are left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

#: Edges (two numbers each) that one task takes in to end the rounds.
FEW = 10_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = FEW) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Each round every node takes the smallest of its neighbours and itself, and
    follows these choices to their end, by jumps of doubled length. The edges
    are then drawn between the ends and those inside a component are dropped:
    every round joins fewer rows and at least halves the nodes. Once at most
    `few` edges are left, one task joins them. Rounds are written to the
    shared folder; nothing but counters reaches the driver. Only nodes that
    have an edge appear; null ends and self-loops make no edge. An empty edge
    table gives an empty result. Hub nodes: the minimum is pre-aggregated per
    task before the shuffle, and the label side of each join holds a node once,
    so an adaptive skew join can split a hub's edges.
    """
    u, v = F.col("u"), F.col("v")

    def clean(pairs: DataFrame) -> DataFrame:
        return pairs.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()

    def after(labels: DataFrame | None, moved: DataFrame) -> DataFrame:
        if labels is None:
            return moved
        ends = moved.select(F.col("n").alias("l"), F.col("l").alias("j"))
        return labels.join(ends, "l", "left").select("n", F.coalesce("j", "l").alias("l"))

    rest, labels = written(clean(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))), None
    while rest.count() > few:
        both = rest.select(u.alias("n"), v.alias("m")).union(rest.select(v.alias("n"), u.alias("m")))
        moved = written(both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("l")))
        jumped = True
        while jumped:
            ends = moved.select(F.col("n").alias("l"), F.col("l").alias("j"))
            far = written(moved.join(ends, "l").select("n", "l", "j"))
            jumped = not far.where("l <> j").isEmpty()
            moved = far.select("n", F.col("j").alias("l"))
        to = lambda side, df: df.join(moved.select(F.col("n").alias(side), F.col("l").alias(f"{side}l")), side)
        rest = written(clean(to("v", to("u", rest)).select(F.col("ul").alias("u"), F.col("vl").alias("v"))))
        labels = written(after(labels, moved))
    return written(after(labels, _in_one_task(rest))).select(F.col("n").alias("node"), F.col("l").alias("component"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(n, l) of few edges (u, v): the smallest node of each node's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(list(map(find, nodes)), kind)], names=["n", "l"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.repartition(1).mapInArrow(run, f"n {kind}, l {kind}")
