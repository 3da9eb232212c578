"""Directed graph measures over edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import ratio
from plumbline.operators.stats import modularity_score, modularity_tier
from plumbline.session import cut, ship, written


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_out, fan_in, instability) of every vertex; self-edges and repeats don't count.

    instability is fan_out over both, null for an isolated vertex.
    """
    e = edges.select("src", "dst").where("src != dst").distinct()
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    both = vertices.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["fan_out", "fan_in"])
    total = F.col("fan_out") + F.col("fan_in")
    return both.withColumn("instability", F.when(total > 0, F.col("fan_out").cast("double") / total))


def roles(deg: DataFrame) -> DataFrame:
    """(id, role): isolated, foundation (only used), entry (only uses) or intermediate."""
    role = (
        F.when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), "isolated")
        .when(F.col("fan_out") == 0, "foundation")
        .when(F.col("fan_in") == 0, "entry")
        .otherwise("intermediate")
    )
    return deg.select("id", role.alias("role"))


#: Graphs with at most so many edges left are finished in one task.
FEW = 10_000


def strong_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(id, scc): strongly connected components; scc is the smallest member.

    Rake and compress: vertices without way in or out leave, and lines of
    vertices with one way in and one way out become single edges, by doubling; a
    closed line is a component. So trees and lines shrink to nothing in rounds
    that follow the logarithm of their size. What a line stood for is settled
    backwards: its vertices belong to the component of its ends if that is one.
    The rest, once it no longer shrinks, ends in one task if it has `few` edges
    or less, or else gives components by labels (`_coloured`) and shrinks on.
    All steps are joins and aggregations; only counts reach the driver. Vertices
    are those with an edge (self-edges included).
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    e = written(e)
    every = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    live, found, lines = written(e.where("src != dst")), [], []
    while not live.isEmpty():
        live, done, line = _shrunk(live)
        if done is None and line is None:
            if live.count() <= few:
                found.append(_in_one_task(live))
                break
            done = written(_coloured(live))
            gone = done.select("id")
            live = written(_without(live, gone))
        found += [done] if done is not None else []
        lines += [line] if line is not None else []
    labels = found[0] if found else every.select("id", F.col("id").alias("rep")).limit(0)
    for part in found[1:]:
        labels = labels.union(part)
    for line in reversed(lines):  # the ends of a line left after it, or are vertices of later lines
        known = written(labels)
        ends = line.join(known.select(F.col("id").alias("u"), F.col("rep").alias("ru")), "u", "left").join(known.select(F.col("id").alias("w"), F.col("rep").alias("rw")), "w", "left")
        first, last = F.coalesce("ru", "u"), F.coalesce("rw", "w")
        labels = known.union(ends.select("id", F.when(first == last, first).otherwise(F.col("id"))))
    known = written(every.join(labels, "id", "left").select("id", F.coalesce("rep", "id").alias("rep")))
    least = known.groupBy("rep").agg(F.min("id").alias("scc"))
    return known.join(least, "rep").select("id", "scc")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges (src, dst) that touch none of `gone` (id)."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def _shrunk(live: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(edges left, (id, rep) of closed lines, (id, u, w) of lines from u to w), the latter null where there are none.

    Vertices without way in or out leave without a word: they are their own component.
    """
    ways = lambda a, b: live.groupBy(F.col(a).alias("id")).agg(F.count("*").alias(f"n_{b}"), F.min(b).alias(b))
    seen = written(ways("src", "dst").join(ways("dst", "src"), "id", "full_outer"))
    ends = seen.where("n_dst is null or n_src is null").select("id")
    passed = written(seen.where("n_dst = 1 and n_src = 1").select("id", F.col("src").alias("before"), F.col("dst").alias("after")))
    if passed.isEmpty():
        if ends.isEmpty():
            return live, None, None
        return written(_without(live, ends)), None, None
    inner = passed.select(F.col("id").alias("after"), F.lit(True).alias("goes_on"))
    links = passed.join(inner, "after", "left").select("id", F.when(F.col("goes_on"), F.col("after")).alias("next"))
    at, rings = _line_ends(links)
    heads = passed.join(passed.select(F.col("id").alias("before")), "before", "left_anti").join(at, "id").select("end", F.col("before").alias("u"))
    line = heads.join(passed.select(F.col("id").alias("end"), F.col("after").alias("w")), "end")
    line = written(line)
    rest = _without(live, passed.select("id")).union(line.where("u != w").select("u", "w")).distinct()
    rest = written(_without(rest, ends))
    members = written(at.join(line, "end").select("id", "u", "w"))
    return rest, None if rings.isEmpty() else rings, members


def _line_ends(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, end) of open lines, (id, rep) of rings) from links (id, next), next null at an end.

    Doubling; what is still open after log2(n) rounds is on a ring, and has seen all of it.
    """
    at = written(links.select("id", F.coalesce("next", "id").alias("end"), F.col("id").alias("low"), F.col("next").isNotNull().alias("open")))
    n, reach = at.count(), 1
    while reach <= n and not at.where("open").isEmpty():
        further = at.select(F.col("id").alias("end"), F.col("end").alias("far"), F.col("low").alias("far_low"), F.col("open").alias("still"))
        at = written(at.join(further, "end").select("id", F.col("far").alias("end"), F.least("low", "far_low").alias("low"), (F.col("open") & F.col("still")).alias("open")))
        reach *= 2
    return at.where("not open").select("id", "end"), at.where("open").select("id", F.col("low").alias("rep"))


def _coloured(live: DataFrame) -> DataFrame:
    """(id, rep): some components of a graph, at least one.

    A vertex takes the smallest vertex that reaches it, and inside its colour
    the smallest that it reaches. Where both are the colour, it is on a ring with it.
    """
    forward = _labels(live)
    same = live.join(forward.select(F.col("id").alias("src"), F.col("low").alias("c")), "src").join(forward.select(F.col("id").alias("dst"), F.col("low").alias("c2")), "dst")
    inside = written(same.where("c = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    back = _labels(inside)
    alone = forward.join(back.select("id"), "id", "left_anti").where("id = low").select("id", F.col("id").alias("rep"))
    both = forward.join(back.select("id", F.col("low").alias("b")), "id").where("low = b").select("id", F.col("low").alias("rep"))
    return both.union(alone)


def _labels(edges: DataFrame) -> DataFrame:
    """(id, low): the smallest vertex that reaches each one, itself included.

    What reaches a vertex's label reaches the vertex, so each round also takes the label's label.
    """
    low = written(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct().withColumn("low", F.col("id")))
    while True:
        seen = edges.join(low.select(F.col("id").alias("src"), F.col("low").alias("m")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("m").alias("m"))
        near = low.join(seen, "id", "left").select("id", "low", F.least("low", "m").alias("near"))
        far = near.join(low.select(F.col("id").alias("near"), F.col("low").alias("far")), "near")
        step = written(far.select("id", F.least("near", "far").alias("new"), (F.least("near", "far") < F.col("low")).alias("moved")))
        low = step.select("id", F.col("new").alias("low"))
        if step.where("moved").isEmpty():
            return low


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(id, rep) of few edges (src, dst)."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: dict = {}
        for pdf in batches:
            for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
                links.setdefault(a, []).append(b)
                links.setdefault(b, [])
        yield pd.DataFrame([(n, min(part)) for part in _tarjan(sorted(links), links) for n in part], columns=["id", "rep"])

    ship(edges.sparkSession)
    return edges.repartition(1).mapInPandas(run, f"id {kind}, rep {kind}")


def _tarjan(nodes: Iterable[str], links: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components with an explicit stack."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held, on, found = [], set(), []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(links.get(root, ())))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            at, following = work[-1]
            for to in following:
                if to not in index:
                    index[to] = low[to] = len(index)
                    held.append(to)
                    on.add(to)
                    work.append((to, iter(links.get(to, ()))))
                    break
                if to in on:
                    low[at] = min(low[at], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    part = []
                    while True:
                        part.append(held.pop())
                        on.discard(part[-1])
                        if part[-1] == at:
                            break
                    found.append(part)
    return found


def strong_components_by(edges: DataFrame, group: str, few: int = FEW) -> DataFrame:
    """(group, id, scc) of many graphs at once (as strings): one graph whose vertices hold their group."""
    key = lambda c: F.concat_ws("\x01", F.col(group).cast("string"), F.col(c).cast("string"))
    e = edges.where(F.col(group).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(key("src").alias("src"), key("dst").alias("dst"))
    parts = lambda c: F.split(c, "\x01", 2)
    return strong_components(e, few).select(parts("id")[0].alias(group), parts("id")[1].alias("id"), parts("scc")[1].alias("scc"))


def graph_snapshots(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """`graph_snapshot` and the composite of modularity for every graph of (group, id), (group, src, dst), in one plan."""
    e = written(edges.select(group, "src", "dst").where("src != dst").distinct())
    ends = lambda c, other: e.groupBy(group, F.col(c).alias("id")).agg(F.count("*").alias(other))
    deg = vertices.select(group, "id").distinct().join(ends("src", "fan_out"), [group, "id"], "left").join(ends("dst", "fan_in"), [group, "id"], "left").na.fill(0, ["fan_out", "fan_in"])
    total = F.col("fan_in") + F.col("fan_out")
    unstable = F.when(total > 0, F.col("fan_out").cast("double") / total)
    n = F.count("*").alias("n_modules")
    row = deg.groupBy(group).agg(
        n, F.sum("fan_out").alias("n_edges"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"),
        F.count(unstable).alias("k"), F.stddev_pop(unstable).alias("sd"), F.avg(unstable).alias("m"),
    )
    sizes = strong_components_by(e, group).groupBy(group, "scc").agg(F.count("*").alias("size")).where("size > 1")
    cycles = sizes.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n_cycles"), F.sum("size").alias("cyclic_modules"), F.max("size").alias("largest_cycle"))
    row = row.join(cycles, F.col(group).cast("string") == F.col("__g"), "left").drop("__g").na.fill(0, ["n_cycles", "cyclic_modules", "largest_cycle"])
    for name, top in (("coupling_density", "n_edges"), ("cycle_ratio", "cyclic_modules"), ("max_fan_in_ratio", "max_fan_in")):
        row = row.withColumn(name, ratio(F.col(top), F.col("n_modules")))
    cv = F.when(F.col("k") > 1, F.col("sd") / (F.col("m") + 1e-9)).otherwise(0.0)
    parts = modularity_score(F.col("coupling_density"), F.col("max_fan_in_ratio"), F.col("cycle_ratio"), F.col("largest_cycle") / F.col("n_modules"), cv)
    score = [F.round(parts["mmi"], 2).alias("mmi"), modularity_tier(parts["mmi"]).alias("tier"), *(F.round(parts[c], 3).alias(c) for c in ("mod", "hier", "cons"))]
    return row.select("*", *score).drop("k", "sd", "m")


def graph_snapshot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and ratios over a graph: size, density, cycles, fan-in, instability."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    deg = degrees(vertices, e)
    sizes = strong_components(e).groupBy("scc").count().where("count > 1")
    cycles = sizes.agg(F.count("*").alias("n_cycles"), F.coalesce(F.sum("count"), F.lit(0)).alias("cyclic_modules"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_cycle"))
    row = deg.agg(
        F.count("*").alias("n_modules"),
        F.coalesce(F.sum("fan_out"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"),
        F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"),
    )
    return (
        row.join(F.broadcast(cycles))
        .withColumn("coupling_density", ratio(F.col("n_edges"), F.col("n_modules")))
        .withColumn("cycle_ratio", ratio(F.col("cyclic_modules"), F.col("n_modules")))
        .withColumn("max_fan_in_ratio", ratio(F.col("max_fan_in"), F.col("n_modules")))
    )


def main_sequence(deg: DataFrame, abstractness: DataFrame) -> DataFrame:
    """One row of means over modules (id, instability) and (id, abstractness).

    mean_instability over modules with an edge, mean_abstractness over modules
    with a class, mean_distance abs(a + i - 1) and zone_of_pain (both below 0.3)
    over modules with both; a mean of nothing is 0.
    """
    a, i = F.col("abstractness"), F.col("instability")
    both = deg.select("id", "instability").join(abstractness.select("id", "abstractness"), "id", "full_outer")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return both.agg(
        mean(i).alias("mean_instability"), mean(a).alias("mean_abstractness"), mean(F.abs(a + i - 1)).alias("mean_distance"),
        F.count(a + i).alias("distance_modules"), F.count_if((a < 0.3) & (i < 0.3)).alias("zone_of_pain"),
    )


def layer_violations(edges: DataFrame, layer_of: DataFrame, ranks: DataFrame) -> DataFrame:
    """(src, dst, src_layer, dst_layer): edges into a layer that comes before the source's own.

    layer_of is (id, layer), ranks (layer, rank); unmapped ends violate nothing.
    """
    of = layer_of.join(ranks, "layer")
    a = of.select(F.col("id").alias("src"), F.col("layer").alias("src_layer"), F.col("rank").alias("r1"))
    b = of.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer"), F.col("rank").alias("r2"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("r2 < r1").select("src", "dst", "src_layer", "dst_layer")


def resolve_prefix(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """(target, module): the longest dotted prefix of a target that is a module; unresolved ones are left out."""
    parts = F.split("target", r"\.")
    ends = targets.select("target").distinct().withColumn("parts", parts).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    prefixes = ends.select("target", "n", F.concat_ws(".", F.slice("parts", F.lit(1), F.col("n"))).alias("module"))
    return prefixes.join(modules.select("module").distinct(), "module").groupBy("target").agg(F.max_by("module", "n").alias("module"))


def suffix_match(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the module whose (suffix, module) is the path or ends it after a slash.

    The longest suffix wins, then the smaller module. Every path is cut at its
    slashes and joined by equality; unmatched paths are left out.
    """
    parts = F.split("path", "/")
    ends = paths.select("path").where("path is not null").distinct().withColumn("p", parts).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("p"))))
    each = ends.select("path", "n", F.concat_ws("/", F.slice("p", -F.col("n"), F.col("n"))).alias("suffix"))
    found = each.join(modules.select("suffix", "module").distinct(), "suffix")
    return found.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), "module"))["module"].alias("module"))


def edge_friction(edges: DataFrame, volatility: DataFrame) -> DataFrame:
    """(src, friction): strength times tree distance (1 at least) times the source's volatility, summed."""
    from plumbline.functions.scalar import tree_distance

    far = F.greatest(tree_distance(F.col("src"), F.col("dst")), F.lit(1))
    return edges.join(volatility.select(F.col("id").alias("src"), "volatility"), "src").groupBy("src").agg(F.sum(F.col("strength") * far * F.col("volatility")).alias("friction"))
