"""Conversation prefix trie with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns, named by a digest of that
sequence. Names come in blocks: inside a block of BLOCK turns a name is the
digest of the turns so far, and a block's start is named by the same procedure
over the blocks' digests, so a conversation of n turns needs log(n) / log(BLOCK)
passes and no task holds more than a block of it.

Heavy paths: a node's largest child is the one with most members (ties: the
smaller conversation). A path ends in a childless node, and all its nodes are
prefixes of that node's smallest conversation, from the depth of that
conversation's last light node on. So the paths follow from the prefix rows, with
no walk along them. As members part among children, a light child has at most
half of its parent's, and a path hangs below at most log2(members) others: the
rounds that attach light paths to their parents are as many.

A path's sums go from its end upwards: inside blocks of BLOCK nodes over arrays,
and over the blocks by a running sum of their totals.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.texts import map_arrow
from plumbline.session import written

BLOCK = 64
FAMILY, SHARED = 5, 9  # conversations of one family share less than SHARED first turns
LEAVES = 64
PIECE = 8192
PIECES = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def look_up(rows: DataFrame, key: str, found: DataFrame, spread: str) -> DataFrame:
    """rows joined with found (unique by `key`); a key that many rows hold is first dealt by a hash of `spread`.

    The distinct (leaf, key) pairs meet `found`, so a frequent key is LEAVES rows there, and each leaf's share
    of its rows in the second join.
    """
    leaved = rows.withColumn("__leaf", F.pmod(F.xxhash64(spread), F.lit(LEAVES)).cast("int"))
    pairs = leaved.select("__leaf", key).distinct().join(found, key)
    return leaved.join(pairs, ["__leaf", key]).drop("__leaf")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, turn_sha, n_bytes): the turns of each conversation numbered from 1.

    Order: turn, null first, then role and text. The table is sorted by ranges
    over the rows, so one long conversation is many tasks' work, and numbered by
    counts of the ranges before. Null roles and texts are empty. Rows without
    conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("__u")]
    ordered = rows.withColumn("__u", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sha = F.unhex(F.sha2(F.concat_ws("/", F.octet_length("role").cast("string"), F.concat("role", "text")), 256))
    placed = written(
        ordered.select(
            "conv_id", sha.alias("turn_sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
        )
    )
    first = placed.groupBy("part", "conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A conversation's ranges: as many rows as it has tasks.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "conv_id", "first", "skip")
    return placed.join(starts, ["part", "conv_id"]).select("conv_id", (F.col("at") - F.col("first") + F.col("skip") + 1).alias("i"), "turn_sha", "n_bytes")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, d, turn_sha, n_bytes), (conv_id, n)) of the rebuilt conversations.

    Conversation c gets the first h turns of c - c % 5, fewer if there are
    fewer, then its own after its first h; h is CRC-32 of the decimal c, mod 9.
    % keeps the sign of c, as in SQL. Conversations left without turns have n = 0.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = numbered.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    ids = own.select("conv_id", h.alias("h"), base.alias("base"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    plan = ids.join(lengths, "base", "left").join(own, "conv_id")
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    plan = written(plan.select("conv_id", "base", "h", "n_own", taken.alias("k")))
    heads = numbered.where(F.col("i") < SHARED).withColumnRenamed("conv_id", "base")
    shared = heads.join(plan.select("conv_id", "base", "k"), "base").where(F.col("i") <= F.col("k")).select("conv_id", F.col("i").alias("d"), "turn_sha", "n_bytes")
    rest = look_up(numbered, "conv_id", plan.select("conv_id", "h", "k"), "i").where(F.col("i") > F.col("h"))
    rows = shared.unionByName(rest.select("conv_id", (F.col("i") - F.col("h") + F.col("k")).alias("d"), "turn_sha", "n_bytes"))
    return rows, plan.select("conv_id", (F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n"))


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (conv_id, d from 1, sha) with `name` of the first d and `before`, the name of the first d - 1.

    The name of no turns is empty. Equal names mean equal sequences.
    """
    empty = F.lit(b"")
    j = F.floor((F.col("d") - 1) / block)
    parts = rows.groupBy("conv_id", j.alias("j")).agg(F.array_sort(F.collect_list(F.struct("d", "sha"))).alias("all"))
    shas = F.transform("all", lambda x: F.hex(x["sha"]))
    inner = F.transform("all", lambda x, k: F.struct(x["d"].alias("d"), F.unhex(F.sha2(F.array_join(F.slice(F.col("shas"), 1, k + 1), ""), 256)).alias("inner")))
    parts = parts.withColumn("shas", shas).select("conv_id", "j", inner.alias("inner"))
    parts = written(parts)
    last = F.element_at("inner", -1)["inner"]
    name = lambda start, x: _sha(start, x)
    if parts.where("j > 0").isEmpty():
        named = parts.withColumn("start", empty).withColumn("end", empty)
    else:
        # Whole blocks are a shorter sequence of the same kind; a block starts where the one before it ended.
        upper = parts.select("conv_id", (F.col("j") + 1).alias("d"), last.alias("sha"))
        ends = prefixes(upper, block).select("conv_id", F.col("d").alias("j"), F.col("name").alias("start"), name(F.col("before"), F.col("sha")).alias("end"))
        later = parts.where("j > 0").join(ends, ["conv_id", "j"])
        named = parts.where("j = 0").withColumn("start", empty).withColumn("end", empty).unionByName(later)
    named = named.withColumn("names", F.transform("inner", lambda x: F.struct(x["d"].alias("d"), name(F.col("start"), x["inner"]).alias("name"))))
    each = F.transform("names", lambda x, k: F.struct(x["d"].alias("d"), x["name"].alias("name"), F.when(k == 0, F.col("end")).otherwise(F.get(F.col("names"), k - 1)["name"]).alias("before")))
    out = named.select("conv_id", F.explode(each).alias("x")).select("conv_id", "x.*")
    return rows.join(out, ["conv_id", "d"])


def nodes_of(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, before, depth, conv_id, n_convs, n_bytes) from prefix rows; the root's name is empty."""
    below = rows.groupBy("name").agg(
        F.first("before").alias("before"), F.first("d").cast("long").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes")
    )
    one = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = one.select(F.lit(b"").alias("name"), F.lit(None).cast("binary").alias("before"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    return below.unionByName(root)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): digest of the ids of each name's rows, ascending, comma-joined.

    The ids are sorted by ranges, so those of a frequent name are many tasks'
    work, and joined to strings of at most PIECE ids there. The digest then
    reads a name's strings in order, one at a time.
    """
    ordered = ends.select("name", F.col("conv_id").alias("first")).repartitionByRange("name", "first").sortWithinPartitions("name", "first")
    joined = written(map_arrow(ordered, _join_ids, "name binary, first long, ids string"))
    return map_arrow(joined.repartition("name").sortWithinPartitions("name", "first"), _digest_ids, "name binary, ends_sha256 string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], target: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(itertools.islice(rows, size)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        name, ids = None, []
        for n, c in _runs(batches):
            if ids and (n != name or len(ids) >= PIECE):
                yield name, ids[0], ",".join(map(str, ids))
                ids = []
            name = n
            ids.append(c)
        if ids:
            yield name, ids[0], ",".join(map(str, ids))

    yield from _batches(made(), PIECES)


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        name, state = None, None
        for n, _, ids in _runs(batches):
            if state is None or n != name:
                if state is not None:
                    yield name, state.hexdigest()
                name, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if state is not None:
            yield name, state.hexdigest()

    yield from _batches(made(), DIGESTS)


def heavy_paths(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with n_children and light, places (name, path, light_depth)).

    A path is named by the smallest conversation of the childless node at its
    end; light_depth is the number of light nodes above and at its nodes.
    """
    largest = F.max_by("name", F.struct("n_convs", -F.col("conv_id")))
    kids = nodes.where("depth > 0").groupBy("before").agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    kids = written(kids)
    marked = nodes.join(kids.select(F.col("before").alias("name"), "n_children"), "name", "left").join(kids.select(F.col("heavy").alias("name"), F.lit(True).alias("is_heavy")), "name", "left")
    marked = written(marked.select(*nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("is_heavy").isNull().alias("light")))
    # Rows of the conversations that stand for a path; the root is on each of them.
    ends = marked.where("n_children = 0").select(F.col("conv_id").alias("path"), F.col("depth").alias("last"))
    tips = ends.where("last > 0")
    mine = look_up(rows.select(F.col("conv_id").alias("path"), F.col("d").cast("long").alias("d"), "name"), "path", tips, "d").where(F.col("d") <= F.col("last"))
    flagged = written(look_up(mine.select("path", "d", "name"), "name", marked.select("name", "light"), "path"))
    heads = flagged.where("light").groupBy("path").agg(F.max("d").alias("head"), F.count("*").alias("light_depth"))
    heads = ends.select("path").join(heads, "path", "left").select("path", F.coalesce("head", F.lit(0)).alias("head"), F.coalesce("light_depth", F.lit(0)).alias("light_depth"))
    below = look_up(flagged.select("path", "d", "name"), "path", heads, "d").where(F.col("d") >= F.col("head")).select("name", "path", "light_depth")
    # The root's path is the one without light nodes.
    root = heads.where("light_depth = 0").select(F.lit(b"").alias("name"), "path", "light_depth")
    return marked, below.unionByName(root)


def suffix_sums(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (path, depth, name, x, y) with sums of x and y over the path from each depth on: (name, x, y)."""
    j = F.floor(F.col("depth") / block)
    arrays = rows.groupBy("path", j.alias("j")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "name", "x", "y")))).alias("all"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    later = Window.partitionBy("path").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    arrays = arrays.select("all", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"more_{c}") for c in ("x", "y")))

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        sums = [(F.coalesce(last[c], F.col(f"more_{c}")) + r[c]).alias(c) for c in ("x", "y")]
        return F.concat(done, F.array(F.struct(r["name"].alias("name"), *sums)))

    start = F.array().cast("array<struct<name: binary, x: bigint, y: bigint>>")
    return arrays.select(F.explode(F.aggregate("all", start, step)).alias("r")).select("r.*")


def subtree_sums(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """nodes with path, n_leaves and saved_tokens of their subtrees, and the parents' conv_id."""
    own = (F.col("n_convs") - 1) * F.col("n_bytes")
    placed = written(nodes.join(places, "name").withColumn("x", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("y", own))
    whole = placed.groupBy("path").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("light_depth").alias("light_depth"))
    # Where each path hangs: the parent of its head; a parent that many paths share is dealt by path.
    heads = placed.where("light and depth > 0").select("path", F.col("before").alias("name"))
    hung = look_up(heads, "name", placed.select("name", F.col("path").alias("upper"), F.col("conv_id").alias("parent_conv_id")), "path")
    hung = written(hung.select("path", "name", "upper", "parent_conv_id"))
    rest = written(whole.join(hung.select("path", "name", "upper"), "path", "left"))
    deepest = rest.agg(F.max("light_depth")).first()[0] or 0
    done = None
    carried = None
    for depth in range(deepest, 0, -1):  # at most log2 of the conversations
        level = rest.where(F.col("light_depth") == depth)
        if carried is not None:
            level = level.join(carried, "path", "left").withColumn("x", F.col("x") + F.coalesce("cx", F.lit(0))).withColumn("y", F.col("y") + F.coalesce("cy", F.lit(0)))
        level = written(level.select("path", "name", "upper", "x", "y"))
        done = level if done is None else done.unionByName(level)
        carried = level.groupBy(F.col("upper").alias("path")).agg(F.sum("x").alias("cx"), F.sum("y").alias("cy"))
    sums = placed
    if done is not None:
        extra = done.groupBy("name").agg(F.sum("x").alias("ex"), F.sum("y").alias("ey"))
        sums = placed.join(extra, "name", "left").withColumn("x", F.col("x") + F.coalesce("ex", F.lit(0))).withColumn("y", F.col("y") + F.coalesce("ey", F.lit(0)))
    summed = suffix_sums(sums.select("path", "depth", "name", "x", "y")).select("name", F.col("x").alias("n_leaves"), F.col("y").alias("saved_tokens"))
    # A node's parent is the node before it on its path, but for heads.
    beside = placed.select("path", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    out = placed.join(beside, ["path", "depth"], "left").join(hung.select("path", "parent_conv_id"), "path", "left").join(summed, "name")
    parent = F.when(F.col("light"), F.when(F.col("depth") > 0, F.col("parent_conv_id"))).otherwise(F.col("above"))
    return out.select("name", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "path", "light_depth")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves and saved_tokens (summed over the subtree),
    ends_sha256 (of the ids that end here), all as the module says. Repeated
    rows are turns of their own. A table without conversations gives no node;
    one whose conversations are all left without turns gives the root. Other
    columns are ignored.
    """
    rows, lengths = rebuilt(turns(conversations))
    lengths = written(lengths)
    bytes_of = rows.select("conv_id", "d", F.col("turn_sha").alias("sha"), "n_bytes")
    named = written(prefixes(bytes_of))
    nodes = written(nodes_of(named, lengths))
    marked, places = heavy_paths(named, nodes)
    sums = subtree_sums(marked, places)
    last = look_up(named.select("conv_id", "d", "name"), "conv_id", lengths, "d").where(F.col("d") == F.col("n")).select("name", "conv_id")
    last = last.unionByName(lengths.where("n = 0").select(F.lit(b"").alias("name"), "conv_id"))
    out = sums.join(ends_digests(last), "name", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "light_depth"
    )

