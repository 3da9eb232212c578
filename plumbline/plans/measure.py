"""Composite plans: everything measured about states of a source tree, and the check against a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalar import ratio
from plumbline.operators import budget, cochange, graph, history, signals, similarity
from plumbline.session import cut
from plumbline.sources import facts as source_facts
from plumbline.sources.files import GitLog, GitTree

#: Metrics that a budget watches, and those that are ratios.
WATCHED = ["redundant_clusters", "redundant_functions", "duplication_ratio", "cycle_ratio", "connascence_shared"]
RATIOS = ["duplication_ratio", "cycle_ratio"]


def duplication(facts: DataFrame, least: float = similarity.SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, metrics): clusters (state, id, cluster) of alike functions, and a row for each state.

    Functions are compared inside their state only: the state is a part of
    every id and feature.
    """
    f = source_facts.functions(facts)
    sid = F.concat_ws("\x01", "state", "qualname", F.col("lineno").cast("string"))
    tagged = f.select("state", sid.alias("sid"), F.col("tokens"))
    sets = similarity.item_sets(tagged, "sid", F.col("tokens"), least=source_facts.LEAST_TOKENS)
    state = F.split("id", "\x01")[0]
    salted = sets.withColumn("s", F.transform("s", lambda x: F.xxhash64(state, x)))
    salted = cut(salted)
    pairs = similarity.similar_pairs(salted, least)
    members = cut(similarity.clusters(salted, pairs).withColumn("state", state))
    sums = members.groupBy("state").agg(F.count_distinct("cluster").alias("redundant_clusters"), F.count("*").alias("redundant_functions"))
    states = facts.select("state").distinct()
    total = tagged.groupBy("state").agg(F.count("*").alias("total_functions"))
    row = states.join(total, "state", "left").join(sums, "state", "left").na.fill(0)
    row = row.withColumn("duplication_ratio", ratio(F.col("redundant_functions"), F.col("total_functions")))
    return members.select("state", F.split("id", "\x01")[1].alias("qualname"), "cluster"), row


def architecture(facts: DataFrame, package: str) -> DataFrame:
    """A row for each state: modules, edges, density, cycles, fan-in, unreadable files, and the means of `graph.main_sequence`."""
    edges = cut(source_facts.import_edges(facts, package))
    modules = facts.groupBy("state").agg(F.count_distinct("module").alias("n_modules"), F.count_if(F.col("kind") == "unreadable").alias("unreadable"))
    scc = graph.strong_components_by(edges, "state").groupBy("state", "scc").count().where("count > 1")
    cycles = scc.groupBy("state").agg(F.sum("count").alias("cyclic_modules"), F.count("*").alias("n_cycles"), F.max("count").alias("largest_cycle"))
    fan = edges.groupBy("state", "dst").count().groupBy("state").agg(F.max("count").alias("max_fan_in"))
    n = edges.groupBy("state").agg(F.count("*").alias("n_edges"))
    row = modules.join(n, "state", "left").join(cycles, "state", "left").join(fan, "state", "left").na.fill(0)
    for name, top in (("coupling_density", "n_edges"), ("cycle_ratio", "cyclic_modules"), ("max_fan_in_ratio", "max_fan_in")):
        row = row.withColumn(name, ratio(F.col(top), F.col("n_modules")))
    return row.join(module_means(facts, edges, package), "state", "left").na.fill(0)


def module_means(facts: DataFrame, edges: DataFrame, package: str) -> DataFrame:
    """(state, mean_instability, mean_abstractness, mean_distance, distance_modules, zone_of_pain), as `graph.main_sequence` has them."""
    name = F.concat_ws(".", F.lit(package), F.when(F.col("module") != "", F.col("module")))
    classes = source_facts.view(facts, "class").groupBy("state", name.alias("id")).agg((F.count_if("is_abstract") / F.count("*")).alias("a"))
    ends = edges.select("state", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e"))
    unstable = ends.groupBy("state", F.col("e.id").alias("id")).agg((F.sum("e.out") / F.count("*")).alias("i"))
    both = unstable.join(classes, ["state", "id"], "full_outer")
    a, i = F.col("a"), F.col("i")
    return both.groupBy("state").agg(
        F.avg(i).alias("mean_instability"), F.avg(a).alias("mean_abstractness"), F.avg(F.abs(a + i - 1)).alias("mean_distance"),
        F.count(a + i).alias("distance_modules"), F.count_if((a < 0.3) & (i < 0.3)).alias("zone_of_pain"),
    )


def shared_literals(facts: DataFrame) -> DataFrame:
    """(state, lit_type, lit_repr, n_modules, occurrences) of significant values in two modules or more."""
    lit = source_facts.view(facts, "literal").where(signals.significant(F.col("lit_type"), F.col("lit_repr")))
    keyed = lit.withColumn("lit_type", F.concat_ws("\x01", "state", "lit_type"))
    out = signals.shared_values(keyed)
    parts = F.split("lit_type", "\x01")
    return out.select(parts[0].alias("state"), parts[1].alias("lit_type"), "lit_repr", "n_modules", "occurrences")


def metrics(facts: DataFrame, package: str) -> DataFrame:
    """Long (state, metric, value, numerator, denominator) of all states."""
    _, dup = duplication(facts)
    arch = architecture(facts, package)
    shared = facts.select("state").distinct().join(shared_literals(facts).groupBy("state").agg(F.count("*").alias("connascence_shared")), "state", "left").na.fill(0)
    wide = dup.join(arch, "state").join(shared, "state")
    none = F.lit(None).cast("long")
    rows = [
        ("redundant_clusters", "redundant_clusters", none, none),
        ("redundant_functions", "redundant_functions", none, none),
        ("duplication_ratio", "duplication_ratio", F.col("redundant_functions"), F.col("total_functions")),
        ("cycle_ratio", "cycle_ratio", F.col("cyclic_modules"), F.col("n_modules")),
        ("connascence_shared", "connascence_shared", none, none),
        ("coupling_density", "coupling_density", F.col("n_edges"), F.col("n_modules")),
        ("n_modules", "n_modules", none, none),
        ("n_edges", "n_edges", none, none),
    ]
    each = [F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value"), a.cast("long").alias("numerator"), b.cast("long").alias("denominator")) for n, c, a, b in rows]
    return wide.select("state", F.explode(F.array(*each)).alias("m")).select("state", "m.*")


def measure_all(facts: DataFrame, package: str, touches: DataFrame | None = None, history_error: str | None = None) -> DataFrame:
    """Long (state, metric, value, numerator, denominator, error): `metrics` and the rest of the composite.

    touches is (state, basket, item) with items named as modules of the package.
    Without a history hidden coupling and contagion are 0, and error says why
    where it could not be read, so that a zero can be told from no reading.
    """
    extra = source_facts.third_party(facts, package).select("state", "module", "top").distinct()
    sprawl = extra.groupBy("state", "top").agg(F.count("*").alias("n")).groupBy("state").agg(F.count("*").alias("third_party_imports"), F.count_if(F.col("n") == 1).alias("single_use_third_party"))
    arch = architecture(facts, package).select("state", "max_fan_in", "max_fan_in_ratio", "cyclic_modules", "n_modules")
    row = arch.join(sprawl, "state", "left").na.fill(0)
    if touches is None:
        row = row.withColumn("hyperliminal_pairs", F.lit(0)).withColumn("contagion_mean", F.lit(0.0))
    else:
        row = row.join(hidden_by_state(touches, source_facts.import_edges(facts, package)), "state", "left").na.fill(0)
    none = F.lit(None).cast("long")
    rows = [("max_fan_in_ratio", F.col("max_fan_in"), F.col("n_modules")), *((c, none, none) for c in ("max_fan_in", "cyclic_modules", "third_party_imports", "single_use_third_party", "hyperliminal_pairs", "contagion_mean"))]
    each = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), a.cast("long").alias("numerator"), b.cast("long").alias("denominator")) for c, a, b in rows]
    long = row.select("state", F.explode(F.array(*each)).alias("m")).select("state", "m.*")
    unread = F.when(F.col("metric").isin("hyperliminal_pairs", "contagion_mean"), F.lit(history_error))
    return metrics(facts, package).unionByName(long).withColumn("error", unread.cast("string"))


def hidden_by_state(touches: DataFrame, edges: DataFrame) -> DataFrame:
    """(state, hyperliminal_pairs, contagion_mean): pairs that change together without an edge, and modules a change touches."""
    key = lambda c: F.concat_ws("\x01", "state", c)
    keyed = touches.select(key("basket").alias("basket"), key("item").alias("item"))
    hidden = cochange.hidden_coupling(cochange.pair_counts(keyed), edges.select(key("src").alias("src"), key("dst").alias("dst")))
    pairs = hidden.groupBy(F.split("a", "\x01")[0].alias("state")).agg(F.count("*").alias("hyperliminal_pairs"))
    sizes = touches.select("state", "basket", "item").distinct().groupBy("state", "basket").agg(F.count("*").alias("n")).groupBy("state").agg(F.avg("n").alias("contagion_mean"))
    return sizes.join(pairs, "state", "left").na.fill(0)


def check(measured: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(state, n_breaches, n_improved, status): held or crossed for each state; a breach comes first."""
    bad = budget.breaches(measured, ceilings).groupBy("state").agg(F.count("*").alias("n_breaches"))
    good = budget.improvements(measured, ceilings).groupBy("state").agg(F.count("*").alias("n_improved"))
    out = measured.select("state").distinct().join(bad, "state", "left").join(good, "state", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("n_breaches") > 0, "crossed").otherwise("held"))


def measure_history(spark: SparkSession, repo: str, package: str, n: int, subdir: str = "") -> DataFrame:
    """Long (seq, committed_at, state, metric, value, numerator, denominator, error) of n commits, evenly sampled.

    All sampled trees are read and measured in one plan, a task for each commit. A commit that can't be
    read keeps one row with its error and no metric.
    """
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitTree)
    commits = history.even_sample(cut(spark.read.format("gitlog").option("repo", repo).load()), n)
    commits = cut(commits)
    shas = [r["sha"] for r in commits.select("sha").collect()]  # n names
    trees = cut(spark.read.format("gittree").option("repo", repo).option("subdir", subdir).option("shas", ",".join(shas)).load())
    long = metrics(source_facts.extract(trees.where("error is null")), package).withColumn("error", F.lit(None).cast("string"))
    none = F.lit(None)
    bad = trees.where("error is not null").select("state", none.cast("string").alias("metric"), none.cast("double").alias("value"), none.cast("long").alias("numerator"), none.cast("long").alias("denominator"), "error")
    return commits.select("seq", "committed_at", F.col("sha").alias("state")).join(long.unionByName(bad), "state")
