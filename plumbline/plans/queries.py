"""Registered queries: every operator applied to the driver's tables, with SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import scalar
from plumbline.operators import apidiff, budget, calibrate, cochange, compare, graph, history, ledger, lineage, lookup, model, pairsample, priority, signals, similarity, stats
from plumbline.plans import measure
from plumbline.session import cut, shared_path, table
from plumbline.sources import facts as source_facts
from plumbline.sources import blocks, files, gitstore, rewrite, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- near-duplicate detection over documents ------------------------------------

WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda w: w <> '')"
SETS_SQL = f"""
    tok AS (SELECT doc_id, source, {WORDS_SQL} AS t FROM documents),
    one AS (SELECT min(doc_id) AS id, arg_min(source, doc_id) AS source, any_value(t) AS t, count(*) AS copies FROM tok WHERE len(t) >= 12 GROUP BY array_to_string(t, chr(1))),
    sets AS (SELECT id, source, copies, list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i+4], chr(1)))) AS s FROM one),
    feat AS (SELECT id, len(s) AS n, unnest(s) AS f FROM sets),
    co AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS inter FROM feat x JOIN feat y ON x.f = y.f AND x.id < y.id GROUP BY x.id, y.id),
    pairs AS (SELECT a, b, inter, na + nb - inter AS uni, inter::DOUBLE / (na + nb - inter)::DOUBLE AS jaccard FROM co)
"""
CLUSTERS_SQL = """
    e AS (SELECT a, b FROM pairs WHERE jaccard >= 0.45 UNION SELECT b, a FROM pairs WHERE jaccard >= 0.45),
    reach AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
    members AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)
"""


def _docs(spark, sf_dir):
    return similarity.document_sets(table(spark, sf_dir, "documents"))


@query(f"WITH {SETS_SQL} SELECT a, b, inter, uni, jaccard FROM pairs WHERE jaccard >= 0.45")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(_docs(spark, sf_dir))


@query(f"WITH RECURSIVE {SETS_SQL}, {CLUSTERS_SQL} SELECT id, cluster FROM members")
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _docs(spark, sf_dir)
    return similarity.clusters(sets, similarity.similar_links(sets))


@query(
    f"""WITH RECURSIVE {SETS_SQL}, {CLUSTERS_SQL}
    SELECT t.total_items, c.redundant_clusters, c.redundant_items,
           CASE WHEN t.total_items = 0 THEN 0.0::DOUBLE ELSE c.redundant_items::DOUBLE / t.total_items END AS duplication_ratio
    FROM (SELECT count(*) AS total_items FROM sets) t, (SELECT count(DISTINCT cluster) AS redundant_clusters, count(*) AS redundant_items FROM members) c"""
)
def dup_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _docs(spark, sf_dir)
    return similarity.snapshot(sets, similarity.similar_links(sets))


@query(
    f"""WITH {SETS_SQL}, th AS (SELECT round(0.20 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(13) r(i))
    SELECT threshold, count(a) AS n_pairs FROM th LEFT JOIN pairs ON jaccard >= threshold GROUP BY threshold"""
)
def dup_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.similar_pairs(_docs(spark, sf_dir), calibrate.THRESHOLDS[0])
    one = pairs.agg(*(F.count_if(F.col("jaccard") >= t).alias(f"n{i}") for i, t in enumerate(calibrate.THRESHOLDS)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n_pairs")) for i, t in enumerate(calibrate.THRESHOLDS)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(f"WITH {SETS_SQL} SELECT x.id AS added, y.id AS base, p.jaccard FROM pairs p JOIN sets x ON x.id IN (p.a, p.b) JOIN sets y ON y.id IN (p.a, p.b) WHERE p.jaccard >= 0.45 AND x.source = 'src3' AND y.source <> 'src3'")
def change_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = similarity.document_sets(table(spark, sf_dir, "documents"), also="source")
    return similarity.change_collisions(sets.where("source <> 'src3'"), sets.where("source = 'src3'"))


# The queries above compare each text once, as their SQL says; those below count every document.

EVERY_SQL = f"""
    every AS (SELECT doc_id AS id, source, {WORDS_SQL} AS t FROM documents WHERE len({WORDS_SQL}) >= 12),
    class_of AS (SELECT id, source, t, min(id) OVER (PARTITION BY array_to_string(t, chr(1))) AS class FROM every),
    sets AS (SELECT id, source, class, list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i+4], chr(1)))) AS s FROM class_of),
    feat AS (SELECT id, class, source, len(s) AS n, unnest(s) AS f FROM sets),
    co AS (SELECT x.id AS a, y.id AS b, any_value(x.class) AS ca, any_value(y.class) AS cb, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS inter FROM feat x JOIN feat y ON x.f = y.f AND x.id < y.id GROUP BY x.id, y.id),
    pairs AS (SELECT a, b, least(ca, cb) AS ca, greatest(ca, cb) AS cb, inter, na + nb - inter AS uni, inter::DOUBLE / (na + nb - inter)::DOUBLE AS jaccard FROM co)
"""


@query(f"WITH {EVERY_SQL} SELECT ca AS a, cb AS b, count(*) AS n_pairs, any_value(inter) AS inter, any_value(uni) AS uni, any_value(jaccard) AS jaccard FROM pairs WHERE jaccard >= 0.45 GROUP BY ca, cb")
def dup_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _docs(spark, sf_dir)
    return similarity.class_pairs(sets, similarity.similar_pairs(sets))


@query(f"WITH RECURSIVE {EVERY_SQL}, {CLUSTERS_SQL} SELECT s.id AS doc_id, s.class, m.cluster FROM sets s LEFT JOIN members m ON s.id = m.id")
def dup_document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _docs(spark, sf_dir)
    found = similarity.document_clusters(sets, similarity.similar_links(sets)).select("class", "cluster")
    return similarity.document_members(table(spark, sf_dir, "documents")).join(found, "class", "left").select("doc_id", "class", "cluster")


@query(
    f"""WITH RECURSIVE {EVERY_SQL}, {CLUSTERS_SQL}
    SELECT t.total_items, c.redundant_clusters, c.redundant_items,
           CASE WHEN t.total_items = 0 THEN 0.0::DOUBLE ELSE c.redundant_items::DOUBLE / t.total_items END AS duplication_ratio
    FROM (SELECT count(*) AS total_items FROM sets) t, (SELECT count(DISTINCT cluster) AS redundant_clusters, count(*) AS redundant_items FROM members) c"""
)
def dup_document_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _docs(spark, sf_dir)
    return similarity.document_snapshot(sets, similarity.similar_links(sets))


@query(
    f"""WITH {EVERY_SQL}, th AS (SELECT round(0.20 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(13) r(i))
    SELECT threshold, count(a) AS n_pairs FROM th LEFT JOIN pairs ON jaccard >= threshold GROUP BY threshold"""
)
def dup_document_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _docs(spark, sf_dir)
    pairs = similarity.class_pairs(sets, similarity.similar_pairs(sets, calibrate.THRESHOLDS[0]))
    one = pairs.agg(*(F.coalesce(F.sum(F.when(F.col("jaccard") >= t, F.col("n_pairs"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(calibrate.THRESHOLDS)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n_pairs")) for i, t in enumerate(calibrate.THRESHOLDS)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(
    f"""WITH tok AS (SELECT doc_id, source = 'src3' AS added, {WORDS_SQL} AS t FROM documents WHERE source IS NOT NULL),
    sides AS (SELECT added, min(doc_id) AS id, any_value(t) AS t, count(*) AS copies FROM tok WHERE len(t) >= 12 GROUP BY added, array_to_string(t, chr(1))),
    feat AS (SELECT added, id, copies, unnest(list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i+4], chr(1))))) AS f FROM sides),
    size AS (SELECT id, count(*) AS n FROM feat GROUP BY id),
    co AS (SELECT x.id AS added, y.id AS base, any_value(x.copies) AS added_copies, any_value(y.copies) AS base_copies, count(*) AS inter FROM feat x JOIN feat y ON x.f = y.f AND x.added AND NOT y.added GROUP BY x.id, y.id)
    SELECT co.added, co.base, added_copies, base_copies, inter::DOUBLE / (p.n + q.n - inter)::DOUBLE AS jaccard
    FROM co JOIN size p ON p.id = co.added JOIN size q ON q.id = co.base WHERE inter::DOUBLE / (p.n + q.n - inter)::DOUBLE >= 0.45"""
)
def change_collisions_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are folded on each side by itself, so a text on both sides collides with itself; copies tell how many it stands for."""
    docs = table(spark, sf_dir, "documents")
    base, change = (similarity.document_sets(docs.where(side)) for side in ("source <> 'src3'", "source = 'src3'"))
    found = similarity.change_collisions(base, change)
    found = found.join(change.select(F.col("id").alias("added"), F.col("copies").alias("added_copies")), "added")
    return found.join(base.select(F.col("id").alias("base"), F.col("copies").alias("base_copies")), "base").select("added", "base", "added_copies", "base_copies", "jaccard")


# --- dependency graph over nations ---------------------------------------------

TRADE_SQL = """
    w AS (SELECT a.n_name AS src, b.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
          WHERE a.n_name <> b.n_name GROUP BY a.n_name, b.n_name),
    edges AS (SELECT src, dst FROM w WHERE n * (SELECT count(*) FROM w) * 10 >= (SELECT sum(n) FROM w) * 16),
    deg AS (SELECT n_name AS id, (SELECT count(*) FROM edges WHERE src = n_name) AS fan_out, (SELECT count(*) FROM edges WHERE dst = n_name) AS fan_in FROM nation)
"""
SCC_SQL = """
    reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
    touched AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
    scc AS (SELECT t.id, least(t.id, min(r.b)) AS scc FROM touched t LEFT JOIN reach r ON r.a = t.id AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = t.id) GROUP BY t.id)
"""


def _trade(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    per = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    per = per.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    w = per.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    w = w.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst")), "s_nationkey")
    return cut(w.select("src", "dst", "n"))


def _edges(spark, sf_dir):
    w = _trade(spark, sf_dir)
    whole = w.agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    return w.join(F.broadcast(whole)).where("n * k * 10 >= s * 16").select("src", "dst")


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))


@query(f"WITH {TRADE_SQL} SELECT id, fan_out, fan_in, CASE WHEN fan_out + fan_in > 0 THEN fan_out::DOUBLE / (fan_out + fan_in)::DOUBLE END AS instability FROM deg")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_nations(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {TRADE_SQL} SELECT id, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'isolated' WHEN fan_out = 0 THEN 'foundation' WHEN fan_in = 0 THEN 'entry' ELSE 'intermediate' END AS role FROM deg")
def graph_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roles(graph.degrees(_nations(spark, sf_dir), _edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {TRADE_SQL}, {SCC_SQL} SELECT id, scc FROM scc")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_edges(spark, sf_dir))


@query(
    """WITH RECURSIVE w AS (SELECT c_mktsegment AS segment, c_nationkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    edges AS (SELECT segment, src, dst FROM w WHERE n * 10 >= (SELECT 16.0 * avg(n) FROM w)),
    reach AS (SELECT segment, src AS a, dst AS b FROM edges UNION SELECT r.segment, r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src AND r.segment = e.segment),
    touched AS (SELECT segment, src AS id FROM edges UNION SELECT segment, dst FROM edges)
    SELECT t.segment, t.id, least(t.id, min(r.b)) AS scc FROM touched t
    LEFT JOIN reach r ON r.segment = t.segment AND r.a = t.id AND EXISTS (SELECT 1 FROM reach q WHERE q.segment = t.segment AND q.a = r.b AND q.b = t.id) GROUP BY t.segment, t.id"""
)
def graph_strong_components_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    per = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = cut(per.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n")))
    edges = w.join(F.broadcast(w.agg(F.count("*").alias("k"), F.sum("n").alias("s")))).where("n * k * 10 >= s * 16")
    return graph.strong_components_by(edges, "segment")


@query(
    """WITH RECURSIVE w AS (SELECT year(o_orderdate) AS y, c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
    edges AS (SELECT y, src, dst FROM w WHERE n * 10 >= (SELECT 16.0 * avg(n) FROM w)),
    v AS (SELECT DISTINCT y, n_nationkey AS id FROM w, nation),
    deg AS (SELECT y, id, (SELECT count(*) FROM edges e WHERE e.y = v.y AND src = id) AS fan_out, (SELECT count(*) FROM edges e WHERE e.y = v.y AND dst = id) AS fan_in FROM v),
    reach AS (SELECT y, src AS a, dst AS b FROM edges UNION SELECT r.y, r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src AND r.y = e.y),
    scc AS (SELECT r.y, r.a AS id, min(r.b) AS scc FROM reach r JOIN reach q ON q.y = r.y AND q.a = r.b AND q.b = r.a GROUP BY r.y, r.a),
    c AS (SELECT y, scc, count(*) AS k FROM scc GROUP BY y, scc HAVING count(*) > 1),
    cy AS (SELECT y, count(*) AS n_cycles, sum(k)::BIGINT AS cyclic, max(k) AS largest FROM c GROUP BY y),
    d AS (SELECT y, count(*) AS n, sum(fan_out)::BIGINT AS e, max(fan_in) AS f, max(fan_out) AS g,
        CASE WHEN count(*) FILTER (fan_in + fan_out > 0) > 1 THEN stddev_pop(fan_out::DOUBLE / (fan_in + fan_out)::DOUBLE) FILTER (fan_in + fan_out > 0) / (avg(fan_out::DOUBLE / (fan_in + fan_out)::DOUBLE) FILTER (fan_in + fan_out > 0) + 1e-9::DOUBLE) ELSE 0.0::DOUBLE END AS cv
        FROM deg GROUP BY y),
    j AS (SELECT d.*, coalesce(n_cycles, 0) AS n_cycles, coalesce(cyclic, 0) AS cyclic, coalesce(largest, 0) AS largest FROM d LEFT JOIN cy USING (y)),
    p AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - e::DOUBLE / n / 5)) * 0.6::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - f::DOUBLE / n)) * 0.4::DOUBLE AS mod,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - cyclic::DOUBLE / n)) * 0.7::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - largest::DOUBLE / n)) * 0.3::DOUBLE AS hier, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - cv)) AS cons FROM j),
    m AS (SELECT *, 10 * (0.45::DOUBLE * mod + 0.30::DOUBLE * hier + 0.25::DOUBLE * cons) AS mmi FROM p)
    SELECT y::VARCHAR AS state, n AS n_modules, e AS n_edges, f AS max_fan_in, g AS max_fan_out, n_cycles, cyclic AS cyclic_modules, largest AS largest_cycle,
      e::DOUBLE / n AS coupling_density, cyclic::DOUBLE / n AS cycle_ratio, f::DOUBLE / n AS max_fan_in_ratio,
      round(mmi, 2) AS mmi, CASE WHEN mmi < 4 THEN 'critical' WHEN mmi < 6 THEN 'high' WHEN mmi < 7.5 THEN 'moderate' ELSE 'low' END AS tier, round(mod, 3) AS mod, round(hier, 3) AS hier, round(cons, 3) AS cons FROM m"""
)
def graph_snapshots_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph of every year, measured in one plan: a history of snapshots with their modularity."""
    t = lambda n: table(spark, sf_dir, n)
    per = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = per.where("c_nationkey != s_nationkey").groupBy(F.year("o_orderdate").cast("string").alias("state"), F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    w = cut(w)
    edges = w.join(F.broadcast(w.agg(F.count("*").alias("k"), F.sum("n").alias("s")))).where("n * k * 10 >= s * 16").select("state", "src", "dst")
    nations = w.select("state").distinct().join(F.broadcast(t("nation").select(F.collect_list("n_nationkey").alias("ids"))))  # the one list of nations
    return graph.graph_snapshots(nations.select("state", F.explode("ids").alias("id")), edges, "state")


@query(
    f"""WITH RECURSIVE {TRADE_SQL}, {SCC_SQL}, c AS (SELECT count(*) AS k FROM scc GROUP BY scc HAVING count(*) > 1)
    SELECT d.*, c.*, CASE WHEN d.n_modules = 0 THEN 0.0::DOUBLE ELSE d.n_edges::DOUBLE / d.n_modules END AS coupling_density, CASE WHEN d.n_modules = 0 THEN 0.0::DOUBLE ELSE c.cyclic_modules::DOUBLE / d.n_modules END AS cycle_ratio, CASE WHEN d.n_modules = 0 THEN 0.0::DOUBLE ELSE d.max_fan_in::DOUBLE / d.n_modules END AS max_fan_in_ratio
    FROM (SELECT count(*) AS n_modules, coalesce(sum(fan_out), 0)::BIGINT AS n_edges, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out FROM deg) d,
         (SELECT count(*) AS n_cycles, coalesce(sum(k), 0)::BIGINT AS cyclic_modules, coalesce(max(k), 0) AS largest_cycle FROM c) c"""
)
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_snapshot(_nations(spark, sf_dir), _edges(spark, sf_dir))


@query(
    f"""WITH {TRADE_SQL}, l AS (SELECT n_name AS id, r_name AS layer, r_regionkey AS rank FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT e.src, e.dst, a.layer AS src_layer, b.layer AS dst_layer FROM edges e JOIN l a ON e.src = a.id JOIN l b ON e.dst = b.id WHERE b.rank < a.rank"""
)
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    layer_of = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("layer"))
    return graph.layer_violations(_edges(spark, sf_dir), layer_of, region.select(F.col("r_name").alias("layer"), F.col("r_regionkey").alias("rank")))


@query(
    """WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS target FROM pages), m AS (SELECT DISTINCT regexp_extract(target, '^([^.]*\\.[^.]*)', 1) AS module FROM h WHERE target LIKE '%.%.%')
    SELECT target, arg_max(module, length(module)) AS module FROM h JOIN m ON target = module OR starts_with(target, module || '.') GROUP BY target"""
)
def resolve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("target")).distinct()
    modules = hosts.where("target like '%.%.%'").select(F.regexp_extract("target", r"^([^.]*\.[^.]*)", 1).alias("module"))
    return graph.resolve_prefix(hosts, modules)


@query(
    f"""WITH {TRADE_SQL}, f AS (SELECT w.src, r.r_regionkey, w.n, count(*) OVER (PARTITION BY w.src) AS k FROM w JOIN nation x ON w.src = x.n_name JOIN nation y ON w.dst = y.n_name JOIN region r ON x.n_regionkey = r.r_regionkey),
    g AS (SELECT w.src, sum(w.n * CASE WHEN x.n_regionkey = y.n_regionkey THEN 2 ELSE 4 END)::DOUBLE AS friction FROM w JOIN nation x ON w.src = x.n_name JOIN nation y ON w.dst = y.n_name GROUP BY w.src)
    SELECT src, friction FROM g"""
)
def edge_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_name", F.concat_ws(".", F.col("n_regionkey").cast("string"), "n_name").alias("path"))
    w = _trade(spark, sf_dir).join(nation.select(F.col("n_name").alias("src"), F.col("path").alias("p1")), "src").join(nation.select(F.col("n_name").alias("dst"), F.col("path").alias("p2")), "dst")
    edges = w.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.col("n").alias("strength"))
    still = nation.select(F.col("path").alias("id"), F.lit(1.0).alias("volatility"))
    return graph.edge_friction(edges, still).select(F.substring_index("src", ".", -1).alias("src"), "friction")


# --- co-change over orders -----------------------------------------------------------

TOUCH_SQL = """
    t AS (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem), k AS (SELECT item, count(*) AS n FROM t GROUP BY item),
    c AS (SELECT x.item AS a, y.item AS b, count(*) AS co FROM t x JOIN t y ON x.basket = y.basket AND x.item < y.item GROUP BY x.item, y.item),
    pairs AS (SELECT a, b, co, p.n AS na, q.n AS nb, co::DOUBLE / (p.n + q.n - co)::DOUBLE AS jaccard FROM c JOIN k p ON a = p.item JOIN k q ON b = q.item),
    linked AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
"""
LEAST_JACCARD = 0.02  # the tables' suppliers meet at random; the default of 0.25 would leave nothing


def _touches(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item"))


def _same_nation(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("src"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("dst"), "s_nationkey"), "s_nationkey").where("src < dst").select("src", "dst")


@query(f"WITH {TOUCH_SQL} SELECT * FROM pairs WHERE co >= 3")
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.pair_counts(_touches(spark, sf_dir)).where("co >= 3")


@query(f"WITH {TOUCH_SQL} SELECT * FROM pairs WHERE co >= 3 AND jaccard >= 0.02 AND (a, b) NOT IN (SELECT (a, b) FROM linked)")
def hidden_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.hidden_coupling(cochange.pair_counts(_touches(spark, sf_dir)), _same_nation(spark, sf_dir), LEAST_JACCARD)


@query(f"WITH {TOUCH_SQL} SELECT p.*, (a, b) IN (SELECT (a, b) FROM linked) AS linked FROM pairs p WHERE co >= 3 AND jaccard >= 0.02")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.merge_candidates(cochange.pair_counts(_touches(spark, sf_dir)), _same_nation(spark, sf_dir), LEAST_JACCARD)


@query(
    f"""WITH {TOUCH_SQL}, b AS (SELECT basket, count(*) AS n FROM t GROUP BY basket)
    SELECT count(*) AS baskets, coalesce(avg(n), 0) AS mean_blast, coalesce(max(n), 0) AS max_blast, count(*) FILTER (WHERE n > 5) AS wide_baskets FROM b"""
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.blast(_touches(spark, sf_dir))


@query(
    f"""WITH {TOUCH_SQL} SELECT s.s_nationkey AS cluster, count(*) AS n_pairs, max(coalesce(p.jaccard, 0)) AS max_jaccard, round(avg(coalesce(p.jaccard, 0)), 9) AS mean_jaccard
    FROM linked l JOIN supplier s ON l.a = s.s_suppkey LEFT JOIN pairs p ON p.a = l.a AND p.b = l.b GROUP BY s.s_nationkey"""
)
def cluster_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("item"))
    return cochange.cluster_cochange(members, _touches(spark, sf_dir)).withColumn("mean_jaccard", F.round("mean_jaccard", 9))


USES_SQL = "u AS (SELECT DISTINCT l_partkey AS symbol, c_nationkey AS consumer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def _uses(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("l_partkey").alias("symbol"), F.col("c_nationkey").alias("consumer"))


@query(f"WITH {USES_SQL} SELECT symbol, count(*) AS consumers FROM u GROUP BY symbol HAVING count(*) >= 2")
def shared_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.shared_kernel(_uses(spark, sf_dir))


@query(f"WITH {USES_SQL} SELECT x.consumer AS a, y.consumer AS b, count(*) AS shared FROM u x JOIN u y ON x.symbol = y.symbol AND x.consumer < y.consumer GROUP BY x.consumer, y.consumer")
def kernel_consumer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.consumer_pairs(_uses(spark, sf_dir))


@query(
    f"""WITH {TOUCH_SQL}, s AS (SELECT p.jaccard AS score, l.a IS NOT NULL AS pos FROM pairs p LEFT JOIN linked l ON p.a = l.a AND p.b = l.b),
    v AS (SELECT score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM s GROUP BY score),
    z AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
    SELECT sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives, sum(p * (2 * below + q))::BIGINT AS wins2, sum(p * (2 * below + q))::DOUBLE / (2 * (sum(p)::DOUBLE * sum(q)::DOUBLE)) AS auc FROM z"""
)
def kernel_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cochange.pair_counts(_touches(spark, sf_dir))
    same = _same_nation(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("positive"))
    scored = pairs.join(same, ["a", "b"], "left").select(F.col("jaccard").alias("score"), F.coalesce("positive", F.lit(False)).alias("positive"))
    return stats.rank_auc(scored)


# --- shared values, spread, keywords -------------------------------------------------------


@query(
    f"""WITH w AS (SELECT source, unnest({WORDS_SQL}) AS word FROM documents), g AS (SELECT word, source, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY word, source)
    SELECT 'str' AS lit_type, word AS lit_repr, count(*) AS n_modules, sum(n)::BIGINT AS occurrences FROM g GROUP BY word HAVING count(*) >= 2"""
)
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.explode(scalar.words(F.col("text"))).alias("lit_repr"))
    typed = rows.withColumn("lit_type", F.lit("str")).where(signals.significant(F.col("lit_type"), F.col("lit_repr")))
    return signals.shared_values(typed).select("lit_type", "lit_repr", "n_modules", "occurrences")


@query(
    """WITH h AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*/([a-z]+)', 1) AS module, regexp_extract(url, '://([^/?#]*)', 1) AS top FROM pages)
    SELECT top, count(*) AS n_modules, count(*) = 1 AS single_use FROM h GROUP BY top"""
)
def dependency_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return signals.dependency_spread(table(spark, sf_dir, "pages").select(F.regexp_extract(url, "://[^/?#]*/([a-z]+)", 1).alias("module"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("top")))


@query(
    """WITH k AS (SELECT DISTINCT event_type AS module, unnest(json_keys(props)) AS key FROM events), s AS (SELECT count(DISTINCT module) AS sites, count(*) AS n FROM k)
    SELECT 'props' AS name, key, count(*) AS n_sites, count(*) = (SELECT sites FROM s) AS everywhere FROM k WHERE (SELECT sites >= 2 OR n >= 2 FROM s) GROUP BY key"""
)
def dict_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("props").alias("name"), F.col("event_type").alias("module"), F.explode(F.json_object_keys("props")).alias("key"))
    return signals.every_site_keys(rows)


@query(
    """WITH s AS (SELECT p_brand AS term, 'm' || (p_size % 10) AS module, list_distinct(array_agg(p_type || ' ' || split_part(p_name, ' ', 1))) AS fields FROM part GROUP BY ALL)
    SELECT x.term, x.module AS a, y.module AS b FROM s x JOIN s y ON x.term = y.term AND x.module < y.module
    WHERE len(list_filter(x.fields, lambda f: NOT list_contains(y.fields, f))) > 0 AND len(list_filter(y.fields, lambda f: NOT list_contains(x.fields, f))) > 0"""
)
def incompatible_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as terms, sizes as modules, kinds of parts as fields."""
    field = F.concat_ws(" ", "p_type", F.split("p_name", " ")[0])
    parts = table(spark, sf_dir, "part")
    shapes = parts.groupBy(F.col("p_brand").alias("term"), F.concat(F.lit("m"), (F.col("p_size") % 10).cast("string")).alias("module")).agg(F.collect_set(field).alias("fields"))
    return signals.incompatible_shapes(shapes)


QUESTION = "Which small steel or brass parts do we have in burnished steel?"
ASKED = "small steel brass parts we burnished steel".split()


@query(
    "WITH q AS (SELECT p_name AS name, regexp_split_to_array(lower(p_name), '[ ]+') AS t, lower(p_type) AS d, p_partkey FROM part), s AS (SELECT p_partkey, name, ("
    + " + ".join(f"list_contains(t, '{w}')::INT + contains(d, '{w}')::INT" for w in ASKED)
    + ")::INT AS score FROM q) SELECT name, score FROM s WHERE score > 0"
)
def keyword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.split(F.lower("p_name"), "[ ]+").alias("tokens"), F.col("p_type").alias("doc"))
    return signals.keyword_hits(part, QUESTION)


@query(
    """WITH s AS (SELECT l_orderkey AS site, l_returnflag AS param, list_distinct(array_agg('k' || l_linenumber)) AS used, any_value(l_orderkey % 3 = 0) AS passed_whole FROM lineitem GROUP BY ALL),
    e AS (SELECT l_returnflag AS param, list_distinct(array_agg('k' || l_linenumber)) AS keys FROM lineitem GROUP BY ALL),
    j AS (SELECT site, param, len(list_filter(used, lambda u: list_contains(keys, u)))::INT AS n_used, len(keys)::INT AS n_full, passed_whole FROM s JOIN e USING (param) WHERE len(keys) >= 3)
    SELECT site, param, n_used, n_full, n_used::DOUBLE / n_full AS fraction FROM j WHERE n_used::DOUBLE / n_full <= 0.34 OR (passed_whole AND n_used <= 1)"""
)
def under_used_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sites that take a flag's lines and use some of its line numbers; every third passes it on whole."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_returnflag").alias("param"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key"))
    sites = lines.groupBy("site", "param").agg(F.collect_set("key").alias("used")).withColumn("passed_whole", F.col("site") % 3 == 0)
    return signals.under_used_parameters(sites, lines.groupBy("param").agg(F.collect_set("key").alias("keys")))


# --- budgets over monthly snapshots of orders ------------------------------------------------------

MONTHS_SQL = """
    o AS (SELECT strftime(o_orderdate, '%Y-%m') AS state, o_orderstatus, o_orderpriority LIKE '1%' AS urgent FROM orders),
    m AS (SELECT state, count(*) FILTER (WHERE urgent) AS k, count(*) AS n, count(*) FILTER (WHERE urgent)::DOUBLE / count(*) AS r FROM o GROUP BY state),
    metrics AS (SELECT state, 'urgent' AS metric, k::DOUBLE AS value, NULL::BIGINT AS numerator, NULL::BIGINT AS denominator FROM m UNION ALL SELECT state, 'urgent_ratio', r, k, n FROM m),
    ceilings AS (SELECT metric, value AS ceiling, numerator FROM metrics WHERE state = (SELECT min(state) FROM m))
"""


def _months(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("state")
    m = table(spark, sf_dir, "orders").groupBy(month).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("k"), F.count("*").alias("n"))
    return cut(m.withColumn("r", scalar.ratio(F.col("k"), F.col("n"))))


def _metrics(months):
    none = F.lit(None).cast("long")
    row = lambda name, value, a, b: F.struct(F.lit(name).alias("metric"), value.alias("value"), a.alias("numerator"), b.alias("denominator"))
    each = F.array(row("urgent", F.col("k").cast("double"), none, none), row("urgent_ratio", F.col("r"), F.col("k"), F.col("n")))
    return months.select("state", F.explode(each).alias("m")).select("state", "m.*")


def _first_budget(months):
    metrics = _metrics(months)
    first = months.agg(F.min("state").alias("state"))
    return metrics, budget.budget_of(metrics.join(F.broadcast(first), "state"), ["urgent", "urgent_ratio"], ["urgent_ratio"])


@query(f"WITH {MONTHS_SQL} SELECT state, metric, ceiling, value AS observed, value - ceiling AS delta FROM metrics JOIN ceilings USING (metric) WHERE value > ceiling")
def budget_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.breaches(*_first_budget(_months(spark, sf_dir)))


@query(f"WITH {MONTHS_SQL} SELECT state, metric, ceiling, value AS observed FROM metrics JOIN ceilings USING (metric) WHERE value < ceiling")
def budget_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.improvements(*_first_budget(_months(spark, sf_dir)))


@query(
    f"""WITH {MONTHS_SQL} SELECT c.metric,
      CASE WHEN m.value < c.ceiling AND (c.metric = 'urgent' OR m.numerator < c.numerator) THEN m.value ELSE c.ceiling END AS ceiling,
      CASE WHEN m.value < c.ceiling AND c.metric = 'urgent_ratio' AND m.numerator < c.numerator THEN m.numerator ELSE c.numerator END AS numerator,
      CASE WHEN m.value >= c.ceiling THEN 'stands' WHEN c.metric = 'urgent' OR m.numerator < c.numerator THEN 'tightened' WHEN m.numerator > c.numerator THEN 'declined: numerator rose' ELSE 'declined: numerator held' END AS decision
    FROM ceilings c JOIN metrics m ON c.metric = m.metric AND m.state = (SELECT max(state) FROM m)"""
)
def budget_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _months(spark, sf_dir)
    metrics, ceilings = _first_budget(months)
    last = months.agg(F.max("state").alias("state"))
    return budget.tighten(metrics.join(F.broadcast(last), "state"), ceilings, ["urgent_ratio"])


@query(
    f"""WITH RECURSIVE {MONTHS_SQL}, p AS (SELECT row_number() OVER (ORDER BY state) AS seq, r AS value, k AS numerator FROM m),
    f AS (SELECT seq, value, numerator, value AS ceiling, numerator AS floor_numerator, false AS tightened FROM p WHERE seq = 1
      UNION ALL SELECT p.seq, p.value, p.numerator, CASE WHEN p.value < f.ceiling AND p.numerator < f.floor_numerator THEN p.value ELSE f.ceiling END,
        CASE WHEN p.value < f.ceiling AND p.numerator < f.floor_numerator THEN p.numerator ELSE f.floor_numerator END, p.value < f.ceiling AND p.numerator < f.floor_numerator FROM f JOIN p ON p.seq = f.seq + 1)
    SELECT 'urgent' AS key, seq, value, numerator, ceiling, floor_numerator, tightened FROM f"""
)
def budget_tighten_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.tighten_sequence(_points(spark, sf_dir).select("key", "seq", F.col("ratio").alias("value"), F.col("k").alias("numerator")))


def _points(spark, sf_dir):
    at = history.numbered(_months(spark, sf_dir), "state")
    return at.select(F.lit("urgent").alias("key"), (F.col("at") + 1).alias("seq"), "state", F.col("r").alias("ratio"), "k", "n")


# --- history -------------------------------------------------------------------------------------------


@query(
    f"""WITH {MONTHS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY state) - 1 AS pos, count(*) OVER () AS total FROM m),
    i AS (SELECT DISTINCT CASE WHEN (SELECT max(total) FROM p) <= 12 THEN i ELSE round_even(i * ((SELECT max(total) FROM p) - 1)::DOUBLE / 11.0, 0)::BIGINT END AS pos FROM range(12) r(i))
    SELECT state, k, n, r FROM p WHERE pos IN (SELECT pos FROM i)"""
)
def history_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.even_sample(_months(spark, sf_dir), 12, "state").select("state", "k", "n", "r")


@query(
    f"""WITH {MONTHS_SQL}, p AS (SELECT 'urgent' AS key, row_number() OVER (ORDER BY state) AS seq, r AS ratio, lag(r) OVER (ORDER BY state) AS before FROM m)
    SELECT *, coalesce(ratio > before + 1e-9, false) AS flagged FROM p"""
)
def replay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay(_points(spark, sf_dir).select("key", "seq", "ratio"))


BUSY_SQL = f"""
    {MONTHS_SQL}, v AS (SELECT strftime(o_orderdate, '%Y-%m') AS state, c_nationkey::VARCHAR AS id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    busy AS (SELECT state, list(id ORDER BY id) AS members FROM v x WHERE n * 10 >= (SELECT 12 * avg(n) FROM v y WHERE y.state = x.state) GROUP BY state),
    vol AS (SELECT id, sum(n)::DOUBLE / max(sum(n)) OVER () AS volatility FROM v GROUP BY id),
    p AS (SELECT row_number() OVER w AS seq, r AS ratio, lag(r) OVER w AS before, coalesce(b.members, []) AS members, lag(coalesce(b.members, [])) OVER w AS old FROM m LEFT JOIN busy b USING (state) WINDOW w AS (ORDER BY state)),
    q AS (SELECT *, CASE WHEN old IS NULL THEN []::VARCHAR[] ELSE list_sort(list_filter(members, lambda x: NOT list_contains(old, x))) END AS newly, coalesce(ratio > before + 1e-9, false) AS flagged FROM p),
    z AS (SELECT *, coalesce((SELECT max(volatility) FROM vol WHERE list_contains(newly, id)) > 0.9, false) AS moving FROM q)
"""


@query(
    f"""WITH {BUSY_SQL} SELECT 'urgent' AS key, seq, array_to_string(newly, ',') AS newly, flagged, flagged AND moving AS gated,
    CASE WHEN flagged AND NOT moving THEN CASE WHEN len(newly) = 0 THEN 'denominator-shift' ELSE 'all-frozen' END END AS suppressed FROM z"""
)
def replay_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    by = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("state"), F.col("c_nationkey").cast("string").alias("id"))
    v = cut(by.agg(F.count("*").alias("n")))
    mean = v.groupBy("state").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    busy = v.join(mean, "state").where("n * 10 * c >= 12 * s").groupBy("state").agg(F.array_sort(F.collect_set("id")).alias("members"))
    points = _points(spark, sf_dir).join(busy, "state", "left").select("key", "seq", "ratio", F.coalesce("members", F.array().cast("array<string>")).alias("members"))
    whole = v.groupBy("id").agg(F.sum("n").alias("n"))
    volatility = whole.join(F.broadcast(whole.agg(F.max("n").alias("top")))).select(F.lit("urgent").alias("key"), "id", (F.col("n").cast("double") / F.col("top")).alias("volatility"))
    return history.replay_gated(points, volatility, frozen=0.9).withColumn("newly", F.concat_ws(",", "newly"))


@query("WITH t AS (SELECT event_type, user_id AS item, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, item, n::DOUBLE / max(n) OVER (PARTITION BY event_type) AS volatility FROM t")
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.volatility_of(table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("item")), ["event_type"])


# --- ledger --------------------------------------------------------------------------------------------

LEDGER_SQL = """
    n AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey AS "when" FROM orders),
    l AS (SELECT 'c' || o_custkey AS region, "when", CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN lag("when") OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS closes,
        CASE WHEN o_orderkey % 5 > 0 THEN 'owner ' || o_orderkey % 7 END AS owner,
        CASE o_orderkey % 3 WHEN 0 THEN 'by ' || strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') || ' at last' WHEN 1 THEN 'when traffic doubles' END AS repayment_trigger,
        CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') WHEN 2 THEN 'soon' END AS review_date,
        CASE WHEN o_totalprice > 300000 THEN 'HIGH' WHEN o_totalprice > 150000 THEN 'MODERATE' WHEN o_totalprice > 50000 THEN 'LOW' END AS exposure_tier FROM n)"""
OPEN_SQL = f"{LEDGER_SQL}, o AS (SELECT * FROM l WHERE coalesce(status, '') <> 'closed' AND NOT EXISTS (SELECT 1 FROM l c WHERE c.status = 'closed' AND c.region = l.region AND c.closes = l.\"when\"))"
DATE_SQL = "try_cast(nullif(regexp_extract(coalesce({0}, ''), '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE)"


def _ledger(spark, sf_dir):
    """Orders as decisions of a customer: an F closes the one before."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    later = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    before = F.lag(F.concat_ws(" ", day, k.cast("string"))).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("region"),
        F.concat_ws(" ", day, k.cast("string")).alias("when"),
        F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").alias("status"),
        F.when(F.col("o_orderstatus") == "F", before).alias("closes"),
        F.when(k % 5 > 0, F.concat(F.lit("owner "), (k % 7).cast("string"))).alias("owner"),
        F.when(k % 3 == 0, F.concat(F.lit("by "), later(90), F.lit(" at last"))).when(k % 3 == 1, "when traffic doubles").alias("repayment_trigger"),
        F.when(k % 4 == 1, later(30)).when(k % 4 == 2, "soon").alias("review_date"),
        F.when(price > 300000, "HIGH").when(price > 150000, "MODERATE").when(price > 50000, "LOW").alias("exposure_tier"),
    )


@query(f"WITH {OPEN_SQL} SELECT * FROM o")
def ledger_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.open_entries(_ledger(spark, sf_dir)).select("region", "when", "status", "closes", "owner", "repayment_trigger", "review_date", "exposure_tier")


@query(
    f"""WITH {OPEN_SQL}, d AS (SELECT *, coalesce({DATE_SQL.format('review_date')}, {DATE_SQL.format('repayment_trigger')}) AS due FROM o)
    SELECT (SELECT count(*) FROM l) AS n_entries, (SELECT count(*) FROM l WHERE status = 'closed') AS n_closed, count(*) AS n_open, count(*) FILTER (WHERE coalesce(owner, '') <> '') AS n_owned,
      count(*) FILTER (WHERE due < DATE '2000-06-30') AS n_overdue, max("when"[1:10]::DATE) AS last_accepted, round(count(*) FILTER (WHERE coalesce(owner, '') <> '')::DOUBLE / count(*), 3) AS coverage,
      date_diff('day', max("when"[1:10]::DATE), DATE '2000-06-30')::INT AS held_days FROM d"""
)
def ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.report(_ledger(spark, sf_dir), dt.date(2000, 6, 30))


@query(f"WITH {OPEN_SQL} SELECT coalesce(exposure_tier, 'NEEDS_ASSESSMENT') AS tier, count(*) AS n_open FROM o GROUP BY 1")
def ledger_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.by_tier(_ledger(spark, sf_dir))


_LEVEL = "CASE WHEN {0} < {1} THEN 'low' WHEN {0} < {2} THEN 'medium' WHEN {0} < {3} THEN 'high' END"
EXPOSURE = {"v": ("l_quantity", 17, 34, 49), "s": ("l_discount", 0.035, 0.065, 0.095), "c": ("l_tax", 0.025, 0.055, 0.085), "d": ("l_extendedprice", 30000, 60000, 100000), "b": ("l_linenumber", 3, 6, 8)}


@query(
    f"""WITH d AS (SELECT {", ".join(f"{_LEVEL.format(*x)} AS {n}" for n, x in EXPOSURE.items())} FROM lineitem),
    n AS (SELECT *, (v='high')::INT + (s='high')::INT + (c='high')::INT + (d='high')::INT + (b='high')::INT AS h, (v='medium')::INT + (s='medium')::INT + (c='medium')::INT + (d='medium')::INT + (b='medium')::INT AS m FROM d)
    SELECT v, s, c, d, b, CASE WHEN v IS NULL OR s IS NULL OR c IS NULL OR d IS NULL OR b IS NULL THEN 'NEEDS_ASSESSMENT' WHEN c='high' AND s='high' THEN 'HIGH' WHEN c='high' AND b='high' THEN 'HIGH'
      WHEN h >= 3 AND (c='high' OR v='high') THEN 'HIGH' WHEN h >= 1 OR m >= 2 THEN 'MODERATE' ELSE 'LOW' END AS tier, count(*) AS n_lines FROM n GROUP BY ALL"""
)
def exposure_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with five dimensions in levels, some of them missing."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(*(f"{_LEVEL.format(*x)} AS {n}" for n, x in EXPOSURE.items()))
    tier = scalar.exposure_tier(*(F.col(n) for n in EXPOSURE))
    return lines.withColumn("tier", tier).groupBy(*EXPOSURE, "tier").agg(F.count("*").alias("n_lines"))


# --- votes and agreement --------------------------------------------------------------------------------

BALLOTS_SQL = "b AS (SELECT user_id AS item, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS match FROM events)"


def _ballots(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("match"))


@query(
    f"""WITH {BALLOTS_SQL}, n AS (SELECT item, coalesce(match, 'NONE') AS match, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, match) AS k, sum(n) OVER (PARTITION BY item)::BIGINT AS trials FROM n)
    SELECT item, match AS top, n AS votes, trials, CASE WHEN match <> 'NONE' AND n >= 4 THEN 'CLEARED' ELSE 'SURFACE' END AS status FROM r WHERE k = 1"""
)
def votes_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.votes(_ballots(spark, sf_dir), 4)


@query(
    f"""WITH {BALLOTS_SQL}, n AS (SELECT item, match, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT item, max(n) AS top, sum(n)::DOUBLE AS w, sum(n * (n - 1)) AS same FROM n GROUP BY item)
    SELECT item, top / w AS majority, CASE WHEN w >= 2 THEN same::DOUBLE / (w * (w - 1)) END AS pairwise FROM s"""
)
def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.agreement(_ballots(spark, sf_dir))


@query("SELECT event_type AS violation, count(DISTINCT user_id % 5) AS n FROM events GROUP BY event_type HAVING count(DISTINCT user_id % 5) >= 4")
def violation_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.violations(table(spark, sf_dir, "events").select(F.col("event_type").alias("violation"), (F.col("user_id") % 5).alias("trial")), 4)


@query(
    """WITH e AS (SELECT event_type AS condition, user_id % 7 AS shape, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 5)::BIGINT AS ensemble FROM events)
    SELECT condition, ensemble, count(DISTINCT shape) AS shapes FROM e GROUP BY condition, ensemble HAVING count(*) = 5"""
)
def ensemble_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("event_id").alias("trial"), (F.col("user_id") % 7).alias("shape"))
    return stats.distinct_per_ensemble(rows)


@query(
    """WITH p AS (SELECT l_returnflag AS flag, l_quantity::DECIMAL(18,4) AS x, l_discount::DECIMAL(18,4) AS y FROM lineitem),
    s AS (SELECT flag, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x*x)::DOUBLE AS sxx, sum(y*y)::DOUBLE AS syy, sum(x*y)::DOUBLE AS sxy FROM p GROUP BY flag)
    SELECT flag, n, CASE WHEN n >= 3 AND n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0 THEN (n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)) END AS r FROM s"""
)
def pearson_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pearson(table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag")), "l_quantity", "l_discount", ["flag"]).select("flag", "n", "r")


SNAPSHOT_SQL = """c AS (SELECT count(*) AS k FROM scc GROUP BY scc HAVING count(*) > 1),
    d AS (SELECT count(*)::DOUBLE AS n, sum(fan_out)::DOUBLE AS e, max(fan_in)::DOUBLE AS f FROM deg), y AS (SELECT coalesce(sum(k), 0)::DOUBLE AS cyclic, coalesce(max(k), 0)::DOUBLE AS largest FROM c),
    i AS (SELECT id, fan_out::DOUBLE / (fan_in + fan_out)::DOUBLE AS i FROM deg WHERE fan_in + fan_out > 0)"""


@query(
    f"""WITH RECURSIVE {TRADE_SQL}, {SCC_SQL}, {SNAPSHOT_SQL},
    v AS (SELECT CASE WHEN count(*) > 1 THEN stddev_pop(i) / (avg(i) + 1e-9::DOUBLE) ELSE 0.0::DOUBLE END AS cv FROM i),
    p AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - e / n / 5)) * 0.6::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - f / n)) * 0.4::DOUBLE AS mod,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - cyclic / n)) * 0.7::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - largest / n)) * 0.3::DOUBLE AS hier, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - cv)) AS cons FROM d, y, v),
    m AS (SELECT *, 10 * (0.45::DOUBLE * mod + 0.30::DOUBLE * hier + 0.25::DOUBLE * cons) AS mmi FROM p)
    SELECT round(mmi, 2) AS mmi, CASE WHEN mmi < 4 THEN 'critical' WHEN mmi < 6 THEN 'high' WHEN mmi < 7.5 THEN 'moderate' ELSE 'low' END AS tier, round(mod, 3) AS mod, round(hier, 3) AS hier, round(cons, 3) AS cons FROM m"""
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, edges = _nations(spark, sf_dir), _edges(spark, sf_dir)
    return stats.modularity(graph.graph_snapshot(nations, edges), graph.degrees(nations, edges))


@query(
    f"""WITH {TRADE_SQL}, i AS (SELECT id, fan_out::DOUBLE / (fan_in + fan_out)::DOUBLE AS i FROM deg WHERE fan_in + fan_out > 0),
    a AS (SELECT n_name AS id, count(*) FILTER (WHERE s_acctbal < 0)::DOUBLE / count(*)::DOUBLE AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
    b AS (SELECT a, i FROM a FULL JOIN i USING (id))
    SELECT round(coalesce(avg(i), 0), 9) AS mean_instability, round(coalesce(avg(a), 0), 9) AS mean_abstractness, round(coalesce(avg(abs(a + i - 1)), 0), 9) AS mean_distance, count(a + i) AS distance_modules, count(*) FILTER (WHERE a < 0.3 AND i < 0.3) AS zone_of_pain FROM b"""
)
def graph_main_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for classes, those in debt for abstract ones."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("id"))
    share = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("k")).groupBy("id").agg((F.count_if(F.col("s_acctbal") < 0) / F.count("*")).alias("abstractness"))
    row = graph.main_sequence(graph.degrees(_nations(spark, sf_dir), _edges(spark, sf_dir)), share)
    return row.select(*(F.round(c, 9).alias(c) for c in ("mean_instability", "mean_abstractness", "mean_distance")), "distance_modules", "zone_of_pain")


# --- calibration ---------------------------------------------------------------------------------------------

LABELLED_SQL = f"x AS (SELECT doc_id, quality, {WORDS_SQL} AS t FROM documents JOIN labels USING (doc_id)), s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(t))::DOUBLE / len(t)::DOUBLE END AS score, CASE WHEN quality = 1 THEN 'same' ELSE 'different' END AS label FROM x)"


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", scalar.words(F.col("text")).alias("t"))
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", scalar.ratio(F.size(F.array_distinct("t")), F.size("t")).alias("score"), F.when(F.col("quality") == 1, "same").otherwise("different").alias("label"))


@query(
    f"""WITH {LABELLED_SQL}, th AS (SELECT round(0.20 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(13) r(i)),
    c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 'same') AS tp, count(*) FILTER (WHERE score >= threshold AND label <> 'same') AS fp, count(*) FILTER (WHERE score < threshold AND label = 'same') AS fn FROM th, s GROUP BY threshold),
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM c)
    SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
      CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, (precision + 3.8416::DOUBLE / (2 * (tp + fp)) - 1.96::DOUBLE * sqrt(precision * (1 - precision) / (tp + fp) + 3.8416::DOUBLE / (4 * (tp + fp) * (tp + fp)))) / (1 + 3.8416::DOUBLE / (tp + fp))), 3) END AS precision_low,
      CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, (precision + 3.8416::DOUBLE / (2 * (tp + fp)) + 1.96::DOUBLE * sqrt(precision * (1 - precision) / (tp + fp) + 3.8416::DOUBLE / (4 * (tp + fp) * (tp + fp)))) / (1 + 3.8416::DOUBLE / (tp + fp))), 3) END AS precision_high FROM p"""
)
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.curve(_labelled(spark, sf_dir), strict=False)


@query(
    f"""WITH {LABELLED_SQL}, b AS (SELECT doc_id AS a, doc_id + 1 AS b, score, CASE WHEN score >= 0.80 THEN 5 WHEN score >= 0.60 THEN 4 WHEN score >= 0.45 THEN 3 WHEN score >= 0.35 THEN 2 WHEN score >= 0.20 THEN 1 ELSE 0 END AS band FROM s),
    q AS (SELECT band, [1,2,4,4,2,1][band + 1] AS w FROM (SELECT DISTINCT band FROM b)), l AS (SELECT band, greatest(1, round_even(60.0::DOUBLE * w / (SELECT sum(w) FROM q), 0)) AS quota FROM q),
    r AS (SELECT b.*, quota, row_number() OVER (PARTITION BY band ORDER BY md5(a || '/' || b.b || '/0'), a, b.b) AS k FROM b JOIN l USING (band)) SELECT a, b, score, band FROM r WHERE k <= quota"""
)
def band_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), "score")
    return calibrate.band_sample(rows, 60)


_DRAW = "('0x' || substr(md5('0/' || {band} || '/' || k || '/{what}'), 1, 15))::BIGINT"
_BAND = "CASE " + " ".join(f"WHEN jaccard >= {low} THEN {i}" for i, low in reversed(list(enumerate(calibrate.BANDS)))) + " END"


@query(
    f"""WITH {EVERY_SQL},
    ids AS (SELECT id, class, s, row_number() OVER (ORDER BY id) - 1 AS at, count(*) OVER () AS total FROM sets),
    high AS (SELECT a, b, least(ca, cb) AS ca, greatest(ca, cb) AS cb, jaccard AS score, {_BAND} AS band FROM pairs WHERE jaccard >= 0.2),
    size AS (SELECT band, count(*) AS n FROM high GROUP BY band UNION ALL SELECT 0, (SELECT count(*) * (count(*) - 1) // 2 FROM sets) - (SELECT count(*) FROM high)),
    there AS (SELECT *, [1,2,4,4,2,1][band + 1] AS w FROM size WHERE n > 0),
    quota AS (SELECT band, n, least(n, greatest(1, round_even(60.0::DOUBLE * w / (SELECT sum(w) FROM there), 0)))::BIGINT AS q FROM there),
    nums AS (SELECT k, {_DRAW.format(band="0", what="i")} % total AS i, {_DRAW.format(band="0", what="j")} % (total - 1) AS j, total FROM range(2000) r(k), (SELECT any_value(total) AS total FROM ids)),
    low AS (
        SELECT k, x.id AS x, y.id AS y, CASE WHEN x.class = y.class THEN 1.0 ELSE len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) END AS score
        FROM nums JOIN ids x ON x.at = i JOIN ids y ON y.at = j + (j >= i)::BIGINT
    ),
    low_draws AS (SELECT least(x, y) AS a, greatest(x, y) AS b, any_value(score) AS score, 0 AS band, min(k) AS k FROM low WHERE score < 0.2 GROUP BY 1, 2),
    classes AS (SELECT ca, cb, band, any_value(score) AS score, count(*) AS n FROM high GROUP BY ca, cb, band),
    sums AS (SELECT *, sum(n) OVER (PARTITION BY band ORDER BY ca, cb) AS upto FROM classes),
    hits AS (
        SELECT k, s.* FROM range(2000) r(k), quota t JOIN sums s ON s.band = t.band AND t.band > 0
        WHERE {_DRAW.format(band="t.band", what="r")} % t.n >= s.upto - s.n AND {_DRAW.format(band="t.band", what="r")} % t.n < s.upto
    ),
    one AS (SELECT h.*, arg_min(i.id, md5('0/' || band || '/' || k || '/a/' || i.id)) AS a FROM hits h JOIN ids i ON i.class = ca GROUP BY ALL),
    two AS (SELECT o.*, arg_min(i.id, md5('0/' || band || '/' || k || '/b/' || i.id)) AS b FROM one o JOIN ids i ON i.class = cb AND i.id <> o.a GROUP BY ALL),
    high_draws AS (SELECT least(a, b) AS a, greatest(a, b) AS b, any_value(score) AS score, band, min(k) AS k FROM two GROUP BY 1, 2, 4),
    ranked AS (SELECT d.*, row_number() OVER (PARTITION BY band ORDER BY k) AS r FROM (SELECT * FROM low_draws UNION ALL SELECT * FROM high_draws) d)
    SELECT a, b, score, band FROM ranked JOIN quota USING (band) WHERE r <= q AND q < n
    UNION ALL SELECT a, b, score, band FROM high JOIN quota USING (band) WHERE q >= n"""
)
def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all documents with enough words over all bands, those without a common shingle too."""
    docs = table(spark, sf_dir, "documents")
    members = similarity.document_members(docs).withColumnRenamed("doc_id", "id")
    return pairsample.pair_sample(members, _docs(spark, sf_dir), 60)


# --- comparison, surfaces, decisions -----------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * (1 - l_discount) * 1000)::DECIMAL(18,0)::BIGINT AS mills FROM lineitem),
    c AS (SELECT *, (mills + 5) // 10 AS left_value, CASE WHEN mills % 10 = 5 THEN (mills // 10) + (mills // 10) % 2 ELSE (mills + 5) // 10 END AS right_value FROM r)
    SELECT * FROM c WHERE left_value <> right_value ORDER BY l_orderkey, l_linenumber, mills LIMIT 5"""
)
def compare_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    mills = (F.col("l_extendedprice") * (1 - F.col("l_discount")) * 1000).cast("decimal(18,0)").cast("long")
    cases = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mills.alias("mills"))
    tens = F.floor(F.col("mills") / 10)
    even = F.when(F.col("mills") % 10 == 5, tens + tens % 2).otherwise(scalar.half_up_cents(F.col("mills"))).cast("long")
    order = F.struct("l_orderkey", "l_linenumber", "mills")
    return compare.mismatches(cases.withColumn("case", order), scalar.half_up_cents(F.col("mills")), even).drop("case")


@query(
    """WITH p AS (SELECT l_partkey, l_linestatus, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
    f AS (SELECT 'p' || l_partkey AS symbol, 'a' || l_linenumber AS name, l_linestatus = 'F' AS old, q >= 25 AS has_default, CASE WHEN q >= 25 THEN floor(q / 10)::INT::VARCHAR END AS d FROM p),
    s AS (SELECT symbol, bool_or(old) AS before, bool_or(NOT old) AS after FROM f GROUP BY symbol),
    j AS (SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.name, y.name) AS name, x.name IS NULL AS fresh, y.name IS NULL AS gone, x.has_default AS d1, y.has_default AS d2, x.d AS t1, y.d AS t2
        FROM (SELECT * FROM f WHERE old) x FULL JOIN (SELECT * FROM f WHERE NOT old) y ON x.symbol = y.symbol AND x.name = y.name),
    r AS (SELECT symbol, CASE WHEN gone THEN 'parameter gone: ' || name WHEN fresh AND NOT d2 THEN 'new required: ' || name WHEN NOT fresh AND d1 AND NOT d2 THEN 'default lost: ' || name END AS reason,
        CASE WHEN fresh AND d2 THEN 'new optional: ' || name WHEN d1 AND d2 AND t1 <> t2 THEN 'default of ' || name || ': ' || t1 || ' to ' || t2 END AS note,
        fresh OR gone OR d1 IS DISTINCT FROM d2 OR t1 IS DISTINCT FROM t2 AS changed FROM j)
    SELECT s.symbol, CASE WHEN NOT after THEN 'removed' WHEN NOT before THEN 'added' ELSE 'changed' END AS status,
        CASE WHEN NOT after THEN true WHEN NOT before THEN false ELSE count(reason) > 0 END AS breaking,
        CASE WHEN NOT after THEN 'symbol removed' WHEN NOT before THEN '' ELSE coalesce(string_agg(reason, '|' ORDER BY reason), '') END AS reasons,
        CASE WHEN after AND before THEN coalesce(string_agg(note, '|' ORDER BY note), '') ELSE '' END AS notes
    FROM s JOIN r USING (symbol) GROUP BY s.symbol, before, after HAVING bool_or(changed)"""
)
def surface_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions with keyword parameters: the lines shipped before and those after make two surfaces."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    has = F.col("q") >= 25
    one = F.struct(F.col("l_linenumber"), F.struct(F.lit("kwonly").alias("kind"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("name"), has.alias("has_default")).alias("p"), F.when(has, F.floor(F.col("q") / 10).cast("int").cast("string")).alias("d"))
    each = lines.groupBy("l_partkey", "l_linestatus").agg(F.array_sort(F.collect_list(one)).alias("x"))
    each = each.select("l_linestatus", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"), F.lit("function").alias("kind"), F.col("x.p").alias("params"), F.col("x.d").alias("defaults"))
    found = apidiff.diff_with_defaults(each.where("l_linestatus = 'F'"), each.where("l_linestatus != 'F'"))
    return found.withColumn("reasons", F.concat_ws("|", "reasons")).withColumn("notes", F.concat_ws("|", "notes"))


@query("SELECT o_custkey AS candidate_id, o_orderkey AS id, row_number() OVER w AS revision, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def decision_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("approved_at"))
    return model.revisions(rows)


@query("SELECT p_partkey, 'reuse_helper:' || substr(sha256('reuse_helper' || chr(1) || p_name || chr(1) || p_brand), 1, 16) AS id FROM part")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", model.candidate_id(F.lit("reuse_helper"), F.col("p_name"), F.col("p_brand")).alias("id"))


@query(
    """WITH r AS (SELECT sha256(concat_ws(chr(1), p_partkey::VARCHAR, p_name, p_brand, p_size::VARCHAR)) AS h, count(*) AS n FROM part GROUP BY 1),
    b AS (SELECT substr(h, 1, 2) AS bucket, sha256(string_agg(h || '*' || n, ',' ORDER BY h)) AS d, sum(n) AS n FROM r GROUP BY 1)
    SELECT sha256(string_agg(bucket || d, ',' ORDER BY bucket)) AS model_hash, sum(n)::BIGINT AS n FROM b"""
)
def model_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.model_hash(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_size"])


@query(
    """WITH h AS (SELECT p_partkey, p_name, p_brand, list_filter(regexp_split_to_array(lower(p_name), '[ ]+'), lambda w: w <> '') AS t FROM part)
    SELECT p_partkey, array_to_string(t, ' ') AS words FROM h"""
)
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", scalar.identifier_words(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))).alias("words"))


@query("SELECT event_type AS signal, count(*) AS raw, count(DISTINCT (user_id, event_id % 7)) AS n_sites FROM events GROUP BY event_type")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.count_findings(table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 7).alias("start_line")))


# --- lookups, rankings, tallies ------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), e AS (SELECT regexp_extract(path, '([^/]+)$', 1) AS suffix FROM p UNION SELECT regexp_extract(path, '([^/]+/[^/]+)$', 1) FROM p WHERE path LIKE '%/es/%'),
    m AS (SELECT suffix, 'm:' || suffix AS module FROM e WHERE suffix <> '') SELECT path, arg_min(module, {'n': -length(suffix), 'm': module}) AS module FROM p JOIN m ON path = suffix OR ends_with(path, '/' || suffix) GROUP BY path"""
)
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")).distinct()
    one = paths.select(F.regexp_extract("path", "([^/]+)$", 1).alias("suffix"))
    two = paths.where("path like '%/es/%'").select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("suffix"))
    suffixes = one.union(two).where("suffix <> ''").distinct()
    return graph.suffix_match(paths, suffixes.select("suffix", F.concat(F.lit("m:"), "suffix").alias("module")))


SCORES_SQL = """s AS (SELECT s_nationkey % 7 AS cluster, n_regionkey || '.' || n_name AS module, n_regionkey AS package FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    d AS (SELECT cluster, count(*) AS degree, CASE WHEN count(DISTINCT module) = 1 THEN 1 WHEN count(DISTINCT package) = 1 THEN 2 ELSE 3 END AS locality FROM s GROUP BY cluster HAVING count(*) >= 2),
    scores AS (SELECT *, locality * degree AS score FROM d)"""


def _scores(spark, sf_dir):
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return priority.cluster_scores(both.select((F.col("s_nationkey") % 7).alias("cluster"), F.concat_ws(".", F.col("n_regionkey").cast("string"), "n_name").alias("module")))


@query(f"WITH {SCORES_SQL} SELECT * FROM scores")
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(
    f"""WITH {TOUCH_SQL}, {SCORES_SQL}, x AS (SELECT a.s_nationkey % 7 AS cluster, max(jaccard) AS j FROM pairs JOIN supplier a ON a = a.s_suppkey JOIN supplier b ON b = b.s_suppkey WHERE a.s_nationkey % 7 = b.s_nationkey % 7 GROUP BY 1)
    SELECT cluster, degree, locality, score, round(coalesce(j, 0), 3) AS cochange, round(score * coalesce(j, 0), 2) AS combined FROM scores LEFT JOIN x USING (cluster)"""
)
def combined_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 7).alias("cluster"), F.col("s_suppkey").alias("item"))
    return priority.combined_priority(_scores(spark, sf_dir), cochange.cluster_cochange(members, _touches(spark, sf_dir)))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS high, count(*) FILTER (WHERE user_id > 10) AS late FROM events GROUP BY event_type")
def condition_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 100).alias("high"), (F.col("user_id") > 10).alias("late"))
    return priority.tallies(rows, "event_type", ["high", "late"])


@query(
    """WITH o AS (SELECT DISTINCT lower(str_split(p_name, ' ')[1]) AS name, p_brand AS module, p_type AS field FROM part), g AS (SELECT CASE WHEN length(name) > 3 AND ends_with(name, 's') AND NOT ends_with(name, 'es') THEN name[:-2] ELSE name END AS term, module, list_sort(list(DISTINCT field)) AS f FROM o GROUP BY 1, 2),
    bad AS (SELECT DISTINCT a.term FROM g a JOIN g b ON a.term = b.term AND a.module < b.module WHERE NOT list_has_all(a.f, b.f) AND NOT list_has_all(b.f, a.f)), seam AS (SELECT DISTINCT p_brand AS module FROM part WHERE p_size >= 49)
    SELECT term, string_agg(g.module, ',' ORDER BY g.module) AS modules, bool_or(seam.module IS NOT NULL) AS translated FROM g JOIN bad USING (term) LEFT JOIN seam ON g.module = seam.module GROUP BY term"""
)
def term_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names' first words are terms, brands modules, types the fields."""
    part = table(spark, sf_dir, "part")
    shapes = part.select(F.split("p_name", " ")[0].alias("name"), F.col("p_brand").alias("module"), F.array("p_type").alias("fields"))
    return priority.term_violations(shapes, part.where("p_size >= 49").select(F.col("p_brand").alias("module"))).withColumn("modules", F.concat_ws(",", "modules"))


@query(
    """WITH r AS (SELECT p_retailprice AS first, p_partkey AS id, lower(p_name) AS text, lower(p_brand) AS scope, CASE WHEN p_size > 25 THEN 1 END AS sup FROM part), q AS (SELECT * FROM (VALUES ('widget', 'brand#1'), ('economy', NULL), ('nothing', NULL)) v(concept, wanted)),
    d AS (SELECT concept, arg_min(id, {'a': r.first, 'b': id::VARCHAR})::VARCHAR AS decided FROM q JOIN r ON contains(text, concept) AND (wanted IS NULL OR contains(scope, wanted)) WHERE sup IS NULL GROUP BY concept),
    c AS (SELECT concept, min(p_partkey)::VARCHAR AS proposed FROM q JOIN part ON contains(lower(p_type), concept) GROUP BY concept)
    SELECT concept, CASE WHEN decided IS NOT NULL THEN 'RATIFIED' WHEN proposed IS NOT NULL THEN 'CANDIDATE' ELSE 'NONE' END AS status, decided IS NOT NULL AS binding, coalesce(decided, proposed) AS id FROM q LEFT JOIN d USING (concept) LEFT JOIN c USING (concept)"""
)
def concept_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    gone = F.when(F.col("p_size") > 25, F.col("p_partkey"))
    ratified = part.select(F.col("p_retailprice").alias("at"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_brand").alias("scope"), gone.alias("superseded_by"))
    candidates = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("text"))
    one, two, three = (lookup.standing(ratified, candidates, c, s) for c, s in (("widget", "Brand#1"), ("economy", None), ("nothing", None)))
    return one.unionByName(two).unionByName(three)


@query("SELECT page_id, h AS region FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) WHERE contains(lower(coalesce(h, '')), 'example.org') OR contains('example.org', lower(coalesce(h, '')))")
def debts_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("region"))
    return lookup.debts_near(entries, "Example.org")


@query(
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS state, * FROM orders), r AS (SELECT state, count(*) AS n, count(DISTINCT o_custkey) AS k FROM o GROUP BY state), m AS (SELECT state, count(*) AS n, count(DISTINCT o_custkey) AS k FROM o WHERE o_orderpriority NOT LIKE '1%' AND state NOT LIKE '%-03' GROUP BY state),
    b AS (SELECT r.state, r.n AS rn, m.n AS mn, r.k AS rk, m.k AS mk, m.state IS NULL AS absent, r.state LIKE '%-02' AS failed FROM r LEFT JOIN m USING (state))
    SELECT state, 'present' AS field, 'true' AS recorded, 'false' AS measured FROM b WHERE absent UNION ALL SELECT state, 'error', NULL, 'unreadable' FROM b WHERE NOT absent AND failed
    UNION ALL SELECT state, 'n', rn::VARCHAR, mn::VARCHAR FROM b WHERE NOT absent AND NOT failed AND rn <> mn UNION ALL SELECT state, 'k', rk::VARCHAR, mk::VARCHAR FROM b WHERE NOT absent AND NOT failed AND rk <> mk"""
)
def recorded_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as recorded against months without urgent orders, without March, February unreadable."""
    o = table(spark, sf_dir, "orders").withColumn("state", F.date_format("o_orderdate", "yyyy-MM"))
    points = lambda rows: rows.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("k"))
    measured = points(o.where("o_orderpriority not like '1%' and state not like '%-03'")).withColumn("error", F.when(F.col("state").like("%-02"), "unreadable"))
    return lookup.differences(points(o).withColumn("error", F.lit(None).cast("string")), measured, ["state"], ["n", "k"])


@query(
    """WITH a AS (SELECT user_id, list(DISTINCT event_type) AS x FROM events WHERE value < 100 GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS y FROM events WHERE value >= 100 GROUP BY 1),
    f AS (SELECT user_id AS site, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (user_id)),
    d AS (SELECT site, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS missing, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS extra FROM f) SELECT site, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM d WHERE len(missing) + len(extra) > 0"""
)
def undeclared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "event_type", "value")
    names = lambda rows: rows.groupBy("site").agg(F.collect_set("event_type").alias("names"))
    found = lookup.undeclared(names(e.where("value < 100")), names(e.where("value >= 100")))
    return found.select("site", *(F.concat_ws(",", c).alias(c) for c in ("missing", "extra")))


@query("SELECT p_partkey FROM part WHERE list_has_any(str_split(lower(p_name), ' '), ['cold', 'widget']) OR lower(p_name) IN ('cold', 'widget')")
def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), scalar.identifier_words(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("tokens"))
    return lookup.entity_matches(part, "Which shape has the cold widget?").select("p_partkey")


@query("SELECT DISTINCT p_brand AS module FROM part WHERE contains(p_brand, '12') OR contains(p_brand, '3')")
def module_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), scalar.identifier_words(F.col("p_brand")).alias("tokens")).distinct()
    return lookup.module_matches(brands, "Which layer depends on 12 and 3?").select("module")


@query("SELECT p_type AS value, count(DISTINCT p_brand) AS n FROM part GROUP BY p_type HAVING contains(lower(p_type), 'economy') OR bool_or(p_brand = 'Brand#25')")
def convention_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.collect_set("p_brand").alias("modules"))
    joined = types.withColumn("modules", F.transform("modules", lambda m: F.replace(m, F.lit("#"), F.lit(""))))
    hits = lookup.convention_matches(joined.withColumn("modules", F.transform("modules", lambda m: F.concat(m, F.lit(";")))), "which constants of economy")
    more = lookup.convention_matches(joined.where(F.array_contains("modules", "Brand25")), "which constants")
    return hits.unionByName(more).select("value", F.size("modules").cast("long").alias("n")).distinct()


@query("SELECT 'helper' AS what, p_brand AS name FROM part WHERE str_split(p_name, ' ')[1] = 'cold' UNION ALL SELECT 'function', p_name FROM part WHERE list_contains(str_split(p_name, ' '), 'cold')")
def helper_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, words = table(spark, sf_dir, "part"), F.split("p_name", " ")
    helpers = part.select(words[0].alias("concept"), F.slice(words, 1, 1).alias("tokens"), F.col("p_brand").alias("site"))
    return lookup.helper_matches(helpers, part.select(F.col("p_name").alias("qualname"), words.alias("tokens")), "which helper is cold")


@query("SELECT c_custkey AS item, CASE WHEN c_mktsegment < 'G' THEN c_mktsegment ELSE 'NONE' END AS match FROM customer")
def catalogue_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("answer"))
    return lookup.covered_votes(answers, answers.where("answer < 'G'").select(F.col("answer").alias("name")))


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 9)::DOUBLE AS mean, median(l_quantity)::DOUBLE AS median FROM lineitem GROUP BY l_returnflag")
def mean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.mean_median(table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q")), "q", ["l_returnflag"]).withColumn("mean", F.round("mean", 9))


@query(
    f"""WITH {MONTHS_SQL}, p AS (SELECT 'urgent' AS key, row_number() OVER (ORDER BY state) AS seq, r, lag(r) OVER (ORDER BY state) AS b FROM m)
    SELECT key, seq, CASE WHEN r > b + 1e-9 THEN 'flag' WHEN r < b - 1e-9 THEN 'consolidation' ELSE 'hold' END AS change FROM p WHERE b IS NOT NULL"""
)
def replay_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.intervals(_points(spark, sf_dir).select("key", "seq", "ratio"))


@query(f"WITH {MONTHS_SQL} SELECT 'urgent' AS key, arg_min(r, state) AS first_ratio, arg_max(r, state) AS last_ratio FROM m")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.first_last(_points(spark, sf_dir).select("key", "seq", "ratio"))


@query(f"SELECT * FROM ({ORACLE['shared_values']}) ORDER BY n_modules DESC, occurrences DESC, lit_type, lit_repr LIMIT 10")
def shared_values_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of a report."""
    return priority.most_spread(shared_values(spark, sf_dir))


@query(
    f"""WITH x AS (SELECT p_size AS cluster, str_split(p_name, ' ') AS t, p_brand FROM part), n AS (SELECT cluster, w, count(*) AS n FROM (SELECT cluster, unnest(t) AS w FROM x) GROUP BY ALL), con AS (SELECT cluster, arg_min(w, {{'n': -n, 'w': w}}) AS concept FROM n GROUP BY cluster),
    h AS (SELECT 'reuse_helper' AS kind, 'medium' AS confidence, concept AS name, arg_min(q, {{'s': -(CASE WHEN t[1] = concept THEN 4 ELSE 0 END), 'l': len(t), 'q': q}}) AS suggestion, count(*) AS n_sites FROM (SELECT *, p_brand || '.' || t[1] AS q FROM x JOIN con USING (cluster)) GROUP BY cluster, concept),
    k AS (SELECT DISTINCT o_orderstatus AS name, o_orderpriority AS key, strftime(o_orderdate, '%Y-%m') AS module FROM orders), s AS (SELECT name, count(DISTINCT module) AS sites, count(*) AS pairs FROM k GROUP BY name), c AS (SELECT name, key, count(*) AS n FROM k GROUP BY ALL),
    e AS (SELECT 'entity_shape', CASE WHEN bool_or(n = sites) THEN 'medium' ELSE 'low' END, name, coalesce(min(CASE WHEN n = sites THEN key END), ''), coalesce(max(CASE WHEN n = sites THEN n END), max(n)) FROM c JOIN s USING (name) WHERE sites >= 2 OR pairs >= 2 GROUP BY name),
    v AS (SELECT 'shared_value', 'low', lit_type, lit_repr, n_modules FROM ({ORACLE['shared_values']})), u AS (SELECT * FROM h UNION ALL SELECT * FROM e UNION ALL SELECT * FROM v)
    SELECT kind || ':' || substr(sha256(concat_ws(chr(1), kind, name, suggestion, n_sites::VARCHAR)), 1, 16) AS id, * FROM u"""
)
def derive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    members = table(spark, sf_dir, "part").select(F.col("p_size").alias("cluster"), F.concat_ws(".", "p_brand", words[0]).alias("qualname"), words.alias("tokens"))
    access = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("key"), F.date_format("o_orderdate", "yyyy-MM").alias("module"))
    return model.derive(model.cluster_helpers(members), signals.every_site_keys(access), shared_values(spark, sf_dir))


# --- source text -----------------------------------------------------------------------------------------------------


_BODY = {
    True: "    total = a + b\n    for x in range(total):\n        total = total + x * b\n    return total\n",
    False: "    found = [a]\n    while a < b:\n        found.append(a)\n        a = a + 1\n    if found:\n        return found\n    return None\n",
}
TREE_SQL = """
    place AS (SELECT n_nationkey, r_name AS state, lower(replace(n_name, ' ', '_')) AS module, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    inside AS (SELECT a.state, a.module AS src, b.module AS dst FROM edges e JOIN place a ON a.n_name = e.src JOIN place b ON b.n_name = e.dst AND b.state = a.state),
    function AS (SELECT state, module, c_mktsegment, count(*) % 2 = 0 AS even FROM place JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
"""


def trade_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python source made from the tables (state, path, module, text): a tree for each region, a module for each nation.

    A module imports the nations of its region that `_edges` gives it, names the
    region in a string and has a function for each market segment of its
    customers, of one of two shapes. Texts follow from counts, so a file is
    short whatever the tables.
    """
    t = lambda n: table(spark, sf_dir, n)
    module = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("state"), module.alias("module"))
    place = cut(place)
    ends = lambda c: place.select(F.col("n_name").alias(c), F.col("state").alias(f"{c}_state"), F.col("module").alias(f"{c}_module"))
    inside = _edges(spark, sf_dir).join(ends("src"), "src").join(ends("dst"), "dst").where("src_state = dst_state")
    imports = inside.groupBy(F.col("src_module").alias("module")).agg(F.array_sort(F.collect_list(F.concat(F.lit("import trade."), "dst_module", F.lit("\n")))).alias("imports"))
    counts = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    body = F.when(F.col("n") % 2 == 0, _BODY[True]).otherwise(_BODY[False])
    name = F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "_"))
    functions = counts.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("def "), name, F.lit("(a, b):\n"), body))).alias("functions"))
    rows = place.join(imports, "module", "left").join(functions, "n_nationkey", "left")
    text = F.concat(F.concat_ws("", "imports"), F.lit('REGION = "trade of '), "state", F.lit('"\n'), F.concat_ws("", "functions"))
    return rows.select("state", F.concat("module", F.lit(".py")).alias("path"), "module", text.alias("text"))


@query(
    f"""WITH RECURSIVE {TRADE_SQL}, {TREE_SQL},
    each AS (
        SELECT state, module, 'module' AS kind, 1 AS n FROM place
        UNION ALL SELECT state, src, 'import', 1 FROM inside
        UNION ALL SELECT state, module, 'literal', 1 FROM place
        UNION ALL SELECT state, module, unnest(['function', 'surface', 'param', 'param']), 1 FROM function
        UNION ALL SELECT state, module, 'literal', 1 FROM function WHERE NOT even
    ) SELECT state, module, kind, count(*) AS n FROM each GROUP BY state, module, kind"""
)
def source_facts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = source_facts.extract(trade_source(spark, sf_dir))
    return facts.groupBy("state", "module", "kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {TRADE_SQL}, {TREE_SQL},
    reach AS (SELECT state, src AS a, dst AS b FROM inside UNION SELECT r.state, r.a, i.dst FROM reach r JOIN inside i ON i.state = r.state AND i.src = r.b),
    ring AS (SELECT DISTINCT r.state, r.a AS module FROM reach r JOIN reach q ON q.state = r.state AND q.a = r.b AND q.b = r.a),
    shape AS (SELECT state, even, count(*) AS k FROM function GROUP BY ALL),
    per AS (SELECT state, count(*)::DOUBLE AS modules, (SELECT count(*) FROM inside i WHERE i.state = p.state)::DOUBLE AS edges, (SELECT count(*) FROM ring i WHERE i.state = p.state)::DOUBLE AS cyclic,
        (SELECT count(*) FROM function f WHERE f.state = p.state)::DOUBLE AS total, (SELECT coalesce(sum(k), 0) FROM shape f WHERE f.state = p.state AND k > 1)::DOUBLE AS redundant,
        (SELECT count(*) FROM shape f WHERE f.state = p.state AND k > 1)::DOUBLE AS clusters FROM place p GROUP BY state),
    long AS (
        SELECT state, 'redundant_clusters' AS metric, clusters AS value, NULL AS numerator, NULL AS denominator FROM per
        UNION ALL SELECT state, 'redundant_functions', redundant, NULL, NULL FROM per
        UNION ALL SELECT state, 'duplication_ratio', CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE redundant / total END, redundant, total FROM per
        UNION ALL SELECT state, 'cycle_ratio', cyclic / modules, cyclic, modules FROM per
        UNION ALL SELECT state, 'connascence_shared', (modules >= 2)::INT::DOUBLE, NULL, NULL FROM per
        UNION ALL SELECT state, 'coupling_density', edges / modules, edges, modules FROM per
        UNION ALL SELECT state, 'n_modules', modules, NULL, NULL FROM per
        UNION ALL SELECT state, 'n_edges', edges, NULL, NULL FROM per
    ) SELECT state, metric, value, numerator::BIGINT AS numerator, denominator::BIGINT AS denominator FROM long"""
)
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.metrics(source_facts.extract(trade_source(spark, sf_dir)), "trade")


# --- history: content, ancestry, renames ------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT year(o_orderdate)::VARCHAR AS state, o_orderkey, substr(o_orderpriority, 1, 1)::INT AS k FROM orders),
    each AS (SELECT state, 'module' AS kind, 1 AS n FROM f UNION ALL SELECT state, 'import', 1 FROM f UNION ALL SELECT state, unnest(['function', 'param', 'surface']), k FROM f UNION ALL SELECT state, 'literal', k FROM f)
    SELECT state, kind, sum(n)::BIGINT AS n FROM each GROUP BY state, kind"""
)
def history_facts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as commits, orders as files whose content follows from priority and state: each content is parsed once."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    functions = F.array_join(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("(a):\n    return a + "), i.cast("string"), F.lit("\n"))), "")
    text = F.concat(F.lit("import status_"), F.lower("o_orderstatus"), F.lit("\n"), functions)
    orders = table(spark, sf_dir, "orders").withColumn("k", digit).withColumn("text", text)
    files = orders.select(F.year("o_orderdate").cast("string").alias("state"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), F.md5("text").alias("blob"), "text")
    contents = files.groupBy("blob").agg(F.first("text").alias("text"))
    return gitstore.facts_by_content(files.drop("text"), contents).groupBy("state", "kind").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE c AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS own FROM events),
    edge AS (
        SELECT event_id AS sha, coalesce(own, event_id - 1) AS parent FROM c WHERE event_id > 0
        UNION SELECT event_id, event_id - 1 FROM c WHERE event_type = 'purchase' AND event_id > 0 AND event_id % 4 = 0
    ),
    tips AS (SELECT max(event_id) AS tip FROM events WHERE event_type IN ('signup', 'error') GROUP BY event_type),
    reach AS (SELECT tip, tip AS sha FROM tips UNION SELECT tip, parent FROM reach JOIN edge USING (sha)),
    plain AS (SELECT sha FROM edge GROUP BY sha HAVING count(*) < 2 UNION SELECT 0),
    n AS (SELECT tip, event_type || ' ' || user_id % 10 AS item, count(*) AS n FROM reach JOIN events ON event_id = sha WHERE sha IN (SELECT sha FROM plain) GROUP BY ALL)
    SELECT tip::VARCHAR AS tip, item, n::DOUBLE / max(n) OVER (PARTITION BY tip) AS volatility FROM n"""
)
def ancestry_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: each goes on from its user's last one or branches off the event before; some purchases also merge that."""
    events, k = table(spark, sf_dir, "events"), F.col("event_id")
    own = F.coalesce(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")), k - 1)
    merged = F.when((F.col("event_type") == "purchase") & (k % 4 == 0) & (F.col("own") != k - 1), k - 1)
    parents = F.when(k > 0, F.transform(F.array_compact(F.array("own", merged)), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    commits = cut(events.withColumn("own", own).select(k.alias("seq"), k.cast("string").alias("sha"), parents.alias("parents")))
    touches = events.select(k.cast("string").alias("sha"), F.concat_ws(" ", "event_type", (F.col("user_id") % 10).cast("string")).alias("item"))
    tips = events.where("event_type in ('signup', 'error')").groupBy("event_type").agg(F.max(k).cast("string").alias("tip"))
    return lineage.bounded_volatility(commits, touches, tips)


@query(
    """WITH RECURSIVE c AS (SELECT event_id AS seq, 'u' || user_id AS path, 'u' || lag(user_id) OVER (ORDER BY event_id) AS prev, event_type FROM events),
    ch AS (SELECT seq, path, CASE WHEN event_type = 'signup' THEN 'A' WHEN event_type = 'error' THEN 'D' WHEN event_type = 'purchase' AND prev <> path THEN 'R' ELSE 'M' END AS status,
        CASE WHEN event_type = 'purchase' AND prev <> path THEN prev END AS old FROM c),
    birth AS (SELECT path, seq, old FROM ch WHERE status IN ('A', 'R')
        UNION ALL SELECT path, min(seq), NULL FROM ch x WHERE status NOT IN ('A', 'R') GROUP BY path HAVING min(seq) < coalesce((SELECT min(seq) FROM ch y WHERE y.path = x.path AND status IN ('A', 'R')), 1e18)),
    life AS (SELECT path, seq AS born, old, lead(seq) OVER (PARTITION BY path ORDER BY seq) AS until FROM birth),
    came AS (SELECT n.path, n.born, o.path AS opath, o.born AS oborn FROM life n JOIN life o ON o.path = n.old AND o.born < n.born AND (o.until IS NULL OR o.until >= n.born)),
    heir AS (SELECT opath, oborn, arg_min(path, (born, path)) AS path, min(born) AS born FROM came GROUP BY opath, oborn),
    chain AS (SELECT path, born, path AS p, born AS b FROM life WHERE until IS NULL UNION ALL SELECT c.path, c.born, h.opath, h.oborn FROM chain c JOIN heir h ON h.path = c.p AND h.born = c.b),
    dead AS (SELECT l.path FROM life l JOIN ch ON ch.path = l.path AND status = 'D' AND seq > born WHERE until IS NULL UNION SELECT l.path FROM life l JOIN ch ON ch.old = l.path AND seq > born WHERE until IS NULL),
    hit AS (SELECT l.path, l.born, seq FROM life l JOIN ch ON ch.path = l.path AND CASE WHEN status = 'D' THEN seq > born AND (until IS NULL OR seq <= until) ELSE seq >= born AND (until IS NULL OR seq < until) END)
    SELECT DISTINCT c.path, seq FROM chain c JOIN hit h ON h.path = c.p AND h.born = c.b WHERE c.path NOT IN (SELECT path FROM dead)"""
)
def followed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a file for each user: sign-ups add it, errors remove it, a purchase renames the file of the event before."""
    events = history.numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")
    user = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    before = events.select((F.col("at") + 1).alias("at"), user("user_id").alias("prev"))
    rows = events.join(before, "at", "left").withColumn("path", user("user_id"))
    renamed = (F.col("event_type") == "purchase") & (F.col("prev") != F.col("path"))
    status = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").when(renamed, "R").otherwise("M")
    return lineage.followed(rows.select(F.col("event_id").alias("seq"), status.alias("status"), "path", F.when(renamed, F.col("prev")).alias("old_path")))


_KEYED = "def build_order(a):\n    seen = {\"zz\": a}\n    order = {\"k0\": a}\n"


@query(
    """WITH k AS (SELECT o_orderkey, list_sort(list_distinct(array_agg('k' || l_linenumber))) AS ks FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey)
    SELECT shape, count(*) AS n FROM (SELECT 'k0|' || array_to_string(ks, '|') AS shape FROM k) GROUP BY shape"""
)
def returned_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions made from orders: keys set one by one on the mapping that is returned, and one on another mapping."""
    key = F.concat(F.lit("    order[\"k"), F.col("l_linenumber").cast("string"), F.lit("\"] = a\n"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select("o_orderkey")
    body = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_join(F.collect_list(key), "").alias("body"))
    files_made = body.select("o_orderkey", F.concat(F.lit(_KEYED), "body", F.lit("    return order\n")).alias("text"))
    return rewrite.returned_mappings(files_made, "build_order").groupBy("shape").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT year(o_orderdate)::VARCHAR AS state, o_orderstatus AS s, o_orderkey % 3 = 0 AS guarded FROM orders)
    SELECT state, count(*) AS files, count(*) FILTER (guarded) AS stripped, count(*) FILTER (NOT guarded) AS imports FROM f GROUP BY state"""
)
def runtime_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from orders, every third importing for type checkers only: what is left after the strip; each distinct text is read once."""
    guarded = F.col("o_orderkey") % 3 == 0
    line = F.concat(F.lit("import status_"), F.lower("o_orderstatus"), F.lit("\n"))
    text = F.when(guarded, F.concat(F.lit("if TYPE_CHECKING:\n    "), line, F.lit("else:\n    x = 1\n"))).otherwise(line)
    path = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    made = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("state"), path.alias("path"), text.alias("text"))
    stripped, contents = gitstore.stripped_by_content(made)
    facts = gitstore.facts_by_content(stripped, contents).where("kind = 'import'").groupBy("state").agg(F.count("*").alias("imports"))
    return stripped.groupBy("state").agg(F.count("*").alias("files"), F.count_if("stripped").alias("stripped")).join(facts, "state", "left").na.fill(0)


# --- runs and answers -------------------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda w: w <> '')) AS n FROM conversations)
    SELECT role, count(*) AS n_turns, sum(n)::BIGINT AS n_words, 'words 1' AS scorer FROM t GROUP BY role"""
)
def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns scored by their words in a run that stops after every other turn and is taken up again."""
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    path = shared_path(spark, "run")
    score = lambda df: df.select("key", F.size(scalar.words(F.col("text"))).cast("string").alias("value"))
    runs.take_up(turns.where("turn % 2 = 0").select("key", "text"), path, "words 1", score)
    whole = runs.take_up(turns.select("key", "text"), path, "words 1", score)
    return whole.join(turns.select("key", "role"), "key").groupBy("role", "scorer").agg(F.count("*").alias("n_turns"), F.sum(F.col("value").cast("long")).alias("n_words"))


@query(
    """WITH a AS (SELECT conv_id, count(*) FILTER (turn % 3 = 0 AND turn < 6) AS n, bool_or(turn = 0) AS f0, bool_or(turn = 3) AS f3, bool_or(turn = 0 AND conv_id % 2 = 0) AS c0, bool_or(turn = 3 AND conv_id % 2 = 0) AS c3 FROM conversations GROUP BY conv_id)
    SELECT (f0::INT + f3::INT) AS files_returned, (c0::INT + c3::INT) AS sites_covered, c0 AND c3 AS oracle, count(*) AS n FROM a GROUP BY ALL"""
)
def covered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from conversations: turns 0 and 3 come back as fenced files, in even conversations with the mark."""
    turn = F.col("turn").cast("string")
    mark = F.when(F.col("conv_id") % 2 == 0, "PLATINUM").otherwise("GOLD")
    words = F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit("'"))
    fence = F.concat(F.lit("./site/t"), turn, F.lit(".py\n```python\n# "), F.regexp_replace(words, r"\s+", " "), F.lit("\nTIER = '"), mark, F.lit("'\n```\n"))
    block = F.when((F.col("turn") % 3 == 0) & (F.col("turn") < 6), fence).otherwise("and so on\n")
    answers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "").alias("text"))
    found = blocks.site_coverage(blocks.file_blocks(answers), ["site/t0.py", "site/t3.py"], "PLATINUM")
    return found.groupBy("files_returned", "sites_covered", "oracle").agg(F.count("*").alias("n"))
