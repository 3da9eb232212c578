"""SimHash near-dedup by tiled exact comparison.

A fingerprint has bit b set when more than half of a text's shingles have it
set in their XXH64. Distinct fingerprints, not documents, are compared: copies
with one fingerprint are one class from the start. The classes are laid out in
tiles by the population counts of the fingerprint's segments. Two fingerprints
at Hamming distance d have segment counts that differ by at most d in sum, so
tile pairs beyond the radius are skipped without loss; all others are compared
in full with numpy exclusive-or and bit counts. For small radii four segments
of 16 bits skip most pairs, for larger ones the whole count is one segment.
Large tiles are split into blocks, and a task holds two blocks at a time. Blocks
grow with the table only up to MOST_BLOCK fingerprints (some MB), so a task's
memory is bounded whatever the table. The comparisons themselves grow with the
square of the number of distinct fingerprints in tiles within reach, which is
what an exact comparison costs.

Links are emitted as minimum spanning forests, never all pairs of a group:
components are unchanged, and n near copies give O(n) links for a tile pair.
Components come from joins over those links.

`near_components` links by the fingerprints alone. `similar_components` links
texts whose sets of shingles have a Jaccard similarity of `similarity` or more,
computed on the whole texts. Its classes are the distinct sets, its fingerprints
are of the distinct shingles, and tiles are also cut by the size of the set,
whose ratio bounds the similarity. The tiles are compared in two passes:
every block with itself, then blocks with each other, where classes that are
already joined give no link any more. The candidates are verified, and what the
fingerprints did not bring together is found by an exact prefix-filter join of
the sets (`prefix_candidates`), so every pair with the similarity is linked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.texts import map_arrow, map_rows, raw
from plumbline.operators.components import connected_components
from plumbline.session import cut, written

SEED = 42
BLOCK = 2048
MOST_BLOCK = 1 << 17
GRID = 512
SIZE_STEP, SIZE_BASE = 1.25, 128
#: Links of a tile pair that are held before they are cut down to a forest (about 150 bytes each while that is done).
HELD = 1 << 17
#: So many shingles before a shared one are looked at for an earlier meeting of two sets.
MEETINGS = 8


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each word shingle of an already lower-cased text, repeats included."""
    parts = text.split()  # bytes.split() cuts at 0x20 and 0x09-0x0D only
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        grams: Iterable[bytes] = (b" ".join(parts),)
    else:
        grams = map(b" ".join, zip(*(itertools.islice(parts, i, None) for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint; a text without words has 0."""
    return majority(shingle_hashes(text.lower(), words))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, size) for every row; size: distinct shingles. Null text counts as empty."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            hashed = [shingle_hashes(x.lower(), words) for x in raw(batch.column(1))]
            return {"doc_id": batch.column(0), "fp": [majority(h) for h in hashed], "size": [len(np.unique(h)) for h in hashed]}

        return work

    return map_rows(_texts(docs, id_col, text_col), make, "doc_id long, fp long, size int")


def set_digest(distinct: np.ndarray) -> int:
    """Signed digest of a set of shingles, given as sorted distinct hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), SEED + 1)).astype(np.int64))


def shingle_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, shingles): digest and distinct shingle hashes of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(shingle_hashes(x.lower(), words)) for x in raw(batch.column(1))]
            return {"doc_id": batch.column(0), "key": [set_digest(h) for h in sets], "shingles": [h.view(np.int64) for h in sets]}

        return work

    return map_rows(_texts(docs, id_col, text_col), make, "doc_id long, key long, shingles array<long>")


def frequent_shingles(docs: DataFrame, words: int, id_col: str, text_col: str, rows: int = 10_000, share: float = 0.1, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, rank of each): shingles of three or more of some sampled texts, rank 1 the rarest.

    They only set the order of a prefix: any sample gives the same links. A
    share of the table is sampled, `rows` texts at least, and the `most` most
    frequent shingles are taken (some MB whatever the table).
    """
    n = docs.count()
    some = docs.sample(min(1.0, max(share, rows / max(1, n))), SEED)
    counts = shingle_sets(some, words, id_col, text_col).select(F.explode("shingles").alias("f")).groupBy("f").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "f").limit(most).toArrow()
    hashes = found["f"].to_numpy().view(np.uint64)
    ranks = np.arange(len(hashes), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def prefix(distinct: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n shingles, in one order for all texts: by hash, frequent ones last."""
    n = len(distinct)
    rank = np.zeros(n, np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], distinct), len(frequent[0]) - 1)
        rank = np.where(frequent[0][at] == distinct, frequent[1][at], 0)
    return distinct[np.argsort(rank, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]]


def set_prints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp, size) of every row's distinct shingles."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(shingle_hashes(x.lower(), words)) for x in raw(batch.column(1))]
            return {"doc_id": batch.column(0), "key": [set_digest(h) for h in sets], "fp": [majority(h) for h in sets], "size": [len(h) for h in sets]}

        return work

    return map_rows(_texts(docs, id_col, text_col), make, "doc_id long, key long, fp long, size int")


def shared_features(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(f, key, size, pos): prefix shingles that more than one class holds, each at its place in the prefix.

    A task gives each class once, so copies don't add up. The prefixes move
    once, by shingle; those of one class only are dropped where they arrive.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words, id_col, text_col))

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> dict:
            fs, keys, sizes, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for text in raw(batch.column(0)):
                distinct = np.unique(shingle_hashes(text.lower(), words))
                key = set_digest(distinct)
                if key in seen or not len(distinct):
                    continue
                seen.add(key)
                first = prefix(distinct, frequent.value, similarity).view(np.int64)
                fs.append(first)
                keys.append(np.full(len(first), key))
                sizes.append(np.full(len(first), len(distinct), np.int32))
                places.append(np.arange(1, len(first) + 1, dtype=np.int32))
            return {n: pa.array(np.concatenate(x)) for n, x in (("f", fs), ("key", keys), ("size", sizes), ("pos", places))}

        return work

    features = map_rows(docs.select(F.col(text_col).cast("string").alias("text")), make, "f long, key long, size int, pos int")
    near = Window.partitionBy("f")
    held = features.withColumn("low", F.min("key").over(near)).withColumn("high", F.max("key").over(near)).where("low <> high")
    return written(held.select("f", "key", "size", "pos").distinct())


def _prefix_length(n: Column, similarity: float) -> Column:
    return n - F.ceil(F.lit(similarity) * n - 1e-9) + 1


def live_features(shared: DataFrame, named: DataFrame) -> DataFrame:
    """The shared features with their root, of shingles that more than one component holds."""
    live = shared.join(named.select("key", "root"), "key")
    several = live.groupBy("f").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("f")
    return written(live.join(several, "f", "left_semi"))


def star_candidates(live: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, r1, r2): of every shingle the most shared class with all others, one pair for two components.

    The class that shares most of its prefix is the middle of its group: what
    the others were made from. So a group of n gives n candidates.
    """
    share = live.groupBy("key").agg((F.count("*") / _prefix_length(F.first("size"), similarity)).alias("part"))
    live = live.join(share, "key")
    middle = live.groupBy("f").agg(F.max_by(F.struct("key", "size", "root"), F.struct("part", "key")).alias("m"))
    pairs = live.join(middle, "f").where((F.col("root") != F.col("m.root")) & _sizes_fit(F.col("size"), F.col("m.size"), similarity))
    counted = pairs.groupBy("key", F.col("m.key").alias("mid"), "root", F.col("m.root").alias("other")).count()
    ends = F.struct(F.col("key").alias("src"), F.col("mid").alias("dst"))
    best = counted.groupBy(F.least("root", "other").alias("r1"), F.greatest("root", "other").alias("r2")).agg(F.max_by(ends, F.struct("count", "key", "mid")).alias("e"))
    return best.select("e.src", "e.dst", "r1", "r2")


def _sizes_fit(n1: Column, n2: Column, similarity: float) -> Column:
    return F.least(n1, n2) >= F.lit(similarity) * F.greatest(n1, n2) - 1e-6


def folded(live: DataFrame, back: int = MEETINGS) -> DataFrame:
    """The live features without those that the same classes hold as an earlier one, each with the `back` before it.

    All prefixes are in one order, so the first of the shingles that a set of
    classes holds comes first in each of them, and so does the first that two
    classes share: every pair that meets still does. A set of classes is known
    by its number and two sums of hashes.
    """
    held = (F.count("*"), F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64("key", F.lit(SEED))))
    holders = live.groupBy("f").agg(*(c.alias(f"h{i}") for i, c in enumerate(held)), F.min_by("pos", "key").alias("place"))
    first = holders.groupBy("h0", "h1", "h2").agg(F.min_by("f", "place").alias("f")).select("f")
    before = F.collect_list("f").over(Window.partitionBy("key").orderBy("pos").rowsBetween(-back, -1))
    return live.join(first, "f", "left_semi").withColumn("before", before)


def prefix_pairs(live: DataFrame, similarity: float) -> DataFrame:
    """(k1, k2, n1, n2, r1, r2): a row for a shingle on which a class meets a larger one of another component.

    Two sets with the similarity share a shingle among the first
    n - ceil(similarity n) + 1 of the larger and the first n - ceil(2 similarity / (1 + similarity) n) + 1
    of the smaller, in the one order of all prefixes. At the first shared
    one, what follows it in either set must still allow the overlap. Shingles
    of few texts come first, so sets with many of their own meet nothing,
    however many others resemble them less. What two sets share after their
    first meeting gives no more rows where one of the last few shingles of both
    shows that they have met.
    """
    least = 2 * similarity / (1 + similarity)
    live = written(folded(live))
    side = lambda i, df: df.select("f", *(F.col(c).alias(f"{x}{i}") for c, x in (("key", "k"), ("root", "r"), ("size", "n"), ("pos", "pos"), ("before", "before"))))
    small = side(1, live.where(F.col("pos") <= _prefix_length(F.col("size"), least)))
    order = F.struct("n1", "k1") < F.struct("n2", "k2")
    room = 1 + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    fits = order & (F.col("r1") != F.col("r2")) & _sizes_fit(F.col("n1"), F.col("n2"), similarity) & (room >= _needed(similarity))
    first = ~F.arrays_overlap("before1", "before2")
    return small.join(side(2, live), "f").where(fits & first).select("k1", "k2", "n1", "n2", "r1", "r2")


def _needed(similarity: float) -> Column:
    """Shared shingles that sets of n1 and n2 need."""
    return F.lit(similarity / (1 + similarity)) * (F.col("n1") + F.col("n2")) - 1e-6


def prefix_candidates(live: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, r1, r2) of all classes in different components that may have the similarity, at any distance.

    Shared shingles before the nearer end of the two prefixes lie in both
    prefixes, the others behind one prefix. So the shared ones of the prefixes
    and the longer rest bound the whole number of shared shingles. A pair is one
    row with the two prefixes, whatever they share.
    """
    met = written(prefix_pairs(live, similarity).distinct())
    ends = met.select(F.explode(F.array("k1", "k2")).alias("key")).distinct()
    held = written(live.join(ends, "key", "left_semi").groupBy("key").agg(F.collect_list("f").alias("fs")))
    one = met.join(held.select(F.col("key").alias("k1"), F.col("fs").alias("fs1")), "k1")
    both = one.join(held.select(F.col("key").alias("k2"), F.col("fs").alias("fs2")), "k2")
    rest = F.greatest(*(F.col(n) - _prefix_length(F.col(n), similarity) for n in ("n1", "n2")))
    kept = both.where(F.size(F.array_intersect("fs1", "fs2")) + rest >= _needed(similarity))
    return kept.select(F.col("k1").alias("src"), F.col("k2").alias("dst"), F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _segment_counts(segments: int) -> list[Column]:
    bits = 64 // segments
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return [F.bit_count(F.shiftrightunsigned(F.col("fp"), bits * i).bitwiseAND(mask)).cast("int") for i in range(segments)]


def neighbour_offsets(radius: int, segments: int, by_size: bool = False) -> list[tuple[int, ...]]:
    """Differences of segment counts within the radius, and of size steps, one of each opposite pair."""
    most = min(radius, 64 // segments)
    counts = [d for d in itertools.product(range(-most, most + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    every = [(*d, *s) for d in counts for s in (((-1,), (0,), (1,)) if by_size else ((),))]
    return [d for d in every if d >= (0,) * len(d)]


def _bases(segments: int, by_size: bool) -> list[int]:
    return [64 // segments + 1] * segments + [SIZE_BASE] * by_size


def tile_rows(classes: DataFrame, segments: int, block: int = BLOCK, by_size: bool = False) -> DataFrame:
    """(tile, block, xs): the classes (fp, size, perhaps key, ...) packed by segment counts, a block to a row.

    by_size also cuts by the size in steps of SIZE_STEP.
    """
    digits = _segment_counts(segments)
    if by_size:
        digits.append(F.least(F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(SIZE_STEP) + 1e-9), F.lit(SIZE_BASE - 1)).cast("int"))
    key = F.lit(0)
    for base, digit in zip(_bases(segments, by_size), digits, strict=True):
        key = key * base + digit
    tiled = cut(classes.withColumn("tile", key.cast("int")))
    counts = tiled.groupBy("tile").count()  # at most the product of the bases, 83,521 rows
    size = min(MOST_BLOCK, max(block, -(-tiled.count() // GRID)))
    parts = tiled.join(F.broadcast(counts), "tile").withColumn("block", F.pmod(F.xxhash64(*(c for c in ("fp", "key") if c in classes.columns)), F.ceil(F.col("count") / size)).cast("int"))
    return cut(parts.repartition("tile", "block").groupBy("tile", "block").agg(F.array_sort(F.collect_list(F.struct(*classes.columns))).alias("xs")))


def tile_pairs(rows: DataFrame, radius: int, segments: int, by_size: bool = False) -> DataFrame:
    """(tile, block, tile2, block2): pairs of rows within reach, each once, a row with itself included."""
    bases = _bases(segments, by_size)
    keys = rows.select("tile", "block")
    digits = F.array(*(F.pmod(F.floor(F.col("tile") / math.prod(bases[i + 1 :])), F.lit(base)).cast("int") for i, base in enumerate(bases)))
    offsets = F.array(*(F.array(*map(F.lit, d)) for d in neighbour_offsets(radius, segments, by_size)))
    near = keys.withColumn("digits", digits).withColumn("d", F.explode(offsets)).withColumn("to", F.zip_with("digits", "d", lambda a, b: a + b))
    tops = F.array(*map(F.lit, bases))
    near = near.where(~F.exists(F.zip_with("to", tops, lambda x, top: (x < 0) | (x >= top)), lambda x: x))
    other = F.lit(0)
    for i, base in enumerate(bases):
        other = other * base + F.col("to")[i]
    pairs = near.select("tile", "block", other.alias("tile2")).join(keys.select(F.col("tile").alias("tile2"), F.col("block").alias("block2")), "tile2")
    return pairs.where((F.col("tile") != F.col("tile2")) | (F.col("block") <= F.col("block2"))).select("tile", "block", "tile2", "block2")


def compare(rows: DataFrame, radius: int, segments: int, work: Callable, schema: str, pairs: DataFrame | None = None) -> DataFrame:
    """work(x, y, same) over tile pairs: x and y are the two rows' columns by name, same: they are one row."""
    pairs = tile_pairs(rows, radius, segments) if pairs is None else pairs
    left = pairs.join(rows.withColumnRenamed("xs", "xs1"), ["tile", "block"])
    right = rows.select(F.col("tile").alias("tile2"), F.col("block").alias("block2"), F.col("xs").alias("xs2"))
    both = left.join(right, ["tile2", "block2"]).select("tile", "block", "tile2", "block2", "xs1", "xs2")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def columns(cell: pa.Scalar) -> dict[str, pa.Array]:
        return dict(zip((f.name for f in cell.values.type), cell.values.flatten(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = [batch.column(c)[i].as_py() for c in range(4)]
                out = work(columns(batch.column(4)[i]), columns(batch.column(5)[i]), at[:2] == at[2:])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return map_arrow(both, run, schema)


def _numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def near_steps(x: dict, y: dict, same: bool, radius: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, distance) of the pairs within the radius, a few rows of the first block at a time.

    With a ratio, sizes must be of that ratio or more.
    """
    one, two = (_numbers(z["fp"]).view(np.uint64) for z in (x, y))
    sizes = [_numbers(z["size"]).astype(float) for z in (x, y)] if ratio else None
    step = max(1, (1 << 16) // max(1, len(two)))  # the temporary arrays stay in the processor's cache
    for start in range(0, len(one), step):
        apart = np.bitwise_count(one[start : start + step, None] ^ two[None, :])
        u, v = np.nonzero(apart <= radius)
        if not len(u):
            continue
        d = apart[u, v].astype(np.int64)
        u = u + start
        use = u < v if same else np.ones(len(u), bool)
        if sizes:
            use &= np.minimum(sizes[0][u], sizes[1][v]) >= ratio * np.maximum(sizes[0][u], sizes[1][v])
        yield u[use], v[use], d[use]


def tile_links(x: dict, y: dict, same: bool, radius: int, ratio: float = 0.0) -> tuple[np.ndarray, ...]:
    """(src, dst) of a minimum spanning forest of two blocks' links; with roots (src, dst, r1, r2), none inside a root.

    The ends are keys where the classes have them, else fingerprints.
    """
    first = len(x["fp"])
    base, n = (0, first) if same else (first, first + len(y["fp"]))
    both = lambda name: _numbers(x[name]) if same else np.concatenate([_numbers(x[name]), _numbers(y[name])])
    label = np.unique(both("root"), return_inverse=True)[1] if "root" in x else np.arange(n)
    got = [[np.empty(0, np.int64)] for _ in range(3)]
    held = 0
    for u, v, d in near_steps(x, y, same, radius, ratio):
        apart = label[u] != label[v + base]
        for kept, new in zip(got, (u[apart], v[apart] + base, d[apart]), strict=True):
            kept.append(new)
        held += int(apart.sum())
        if held > HELD:
            got = [[z] for z in forest(*map(np.concatenate, got), label)]
            held = len(got[0][0])
    u, v, _ = forest(*map(np.concatenate, got), label)
    nodes = both("key" if "key" in x else "fp")
    if "root" not in x:
        return nodes[u], nodes[v]
    roots = both("root")
    return nodes[u], nodes[v], roots[u], roots[v]


def forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links: every component takes its nearest link out, again and again.

    label: for each node a number below their count; nodes with one label are one from the start.
    """
    label, taken = label.copy(), []
    live = np.arange(len(u))
    while True:
        live = live[label[u[live]] != label[v[live]]]
        if not len(live):
            break
        ends = np.concatenate([label[u[live]], label[v[live]]])
        edge = np.concatenate([live, live])
        order = np.lexsort((edge, d[edge], ends))
        first = np.r_[True, np.diff(ends[order]) != 0]
        chosen = np.unique(edge[order][first])
        taken.append(chosen)
        while True:
            low = np.minimum(label[u[chosen]], label[v[chosen]])
            to = np.arange(len(label))  # of labels: whole components move, never single nodes
            for x in (label[u[chosen]], label[v[chosen]]):
                np.minimum.at(to, x, low)
            after = to[to][label]
            if (after == label).all():
                break
            label = after
    picked = np.concatenate(taken) if taken else np.empty(0, np.int64)
    return u[picked], v[picked], d[picked]


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(src, dst): links among distinct fingerprints with the components of all links within the radius."""
    segments = 4 if radius <= 4 else 1
    rows = tile_rows(classes.select("fp", "size"), segments)
    return compare(rows, radius, segments, lambda x, y, same: tile_links(x, y, same, radius), "src long, dst long")


def near_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of `radius` or fewer
    differing bits reach, the row's own included. Texts with fewer words than a
    shingle hash their whole word sequence; texts without words (null, empty,
    blank) have fingerprint zero and link like any other. Null ids are linked
    but never name a component, unless it has no other id (component_id null).
    Repeated rows stay repeated. Other columns are ignored.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("size").alias("size")))
    roots = connected_components(links(classes, radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    named = cut(named)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sets_of(ends: DataFrame, classes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str, broadcast_rows: int = 200_000) -> DataFrame:
    """(key, shingles) of some classes (key), from the representatives' texts.

    Only their texts are read for it; the ids are broadcast up to
    `broadcast_rows` and joined by shuffle beyond.
    """
    needed = written(classes.join(ends.distinct(), "key").select("key", F.col("low").alias("doc_id")))
    ids = needed.select("doc_id").distinct()
    texts = _texts(docs, id_col, text_col)
    sets = shingle_sets(texts.join(F.broadcast(ids) if needed.count() <= broadcast_rows else ids, "doc_id", "left_semi"), words)
    return written(sets.join(needed, ["key", "doc_id"]).groupBy("key").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst, ...) whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("key").alias("src"), F.col("shingles").alias("a")), "src")
    both = both.join(sets.select(F.col("key").alias("dst"), F.col("shingles").alias("b")), "dst")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select(*pairs.columns)


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id for every row with an id: near copies by shingle sets.

    Texts with one set of shingles are one class. Candidates are classes with
    fingerprints within `radius`, equal ones included, whose numbers of shingles
    allow the similarity; a candidate is a link when the whole texts' sets of
    shingles have it. Every block of classes is compared with itself, and one
    candidate of two components that share a shingle of their prefixes brings
    large groups together. Then blocks are compared with each other, and in the
    end all classes of different components that may still have the similarity
    are joined by their prefixes. Every pair with the similarity is linked, at
    any radius. Null and empty texts are one class.
    """
    named_docs = docs.where(F.col(id_col).isNotNull())
    rows = written(set_prints(named_docs, words, id_col, text_col))
    classes = written(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("low"), F.max("size").alias("size")))
    named = classes.withColumn("root", F.col("key"))

    def joined(named: DataFrame, candidates: DataFrame) -> DataFrame:
        """named with the components that the verified candidates join."""
        candidates = cut(candidates)
        if candidates.isEmpty():
            return named
        ends = candidates.select(F.explode(F.array("src", "dst")).alias("key"))
        good = verified(candidates, sets_of(ends, classes, named_docs, words, id_col, text_col), similarity)
        moved = connected_components(good, "r1", "r2")
        found = named.join(moved, named["root"] == moved["node"], "left")
        return written(found.select("key", "fp", "low", "size", F.coalesce("component", "root").alias("root")))

    shared = shared_features(named_docs, words, similarity, id_col, text_col)
    for own in (True, False):
        tiles = tile_rows(named.select("fp", "key", "size", "root"), 1, by_size=True)
        pairs = tile_pairs(tiles, radius, 1, True)
        pairs = pairs.where((F.col("tile") == F.col("tile2")) & (F.col("block") == F.col("block2")) if own else (F.col("tile") != F.col("tile2")) | (F.col("block") != F.col("block2")))
        links = compare(tiles, radius, 1, lambda x, y, same: tile_links(x, y, same, radius, similarity), "src long, dst long, r1 long, r2 long", pairs)
        one = F.min(F.struct("src", "dst")).alias("e")
        links = links.groupBy(F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2")).agg(one).select("e.src", "e.dst", "r1", "r2")
        named = joined(named, links)
        live = live_features(shared, named)
        if not live.isEmpty():
            named = joined(named, star_candidates(live, similarity) if own else prefix_candidates(live, similarity))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "root").select("key", "component_id")
    return rows.join(ids, "key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id.

    Rows without an id are not compared and stay. Of rows that repeat the id
    that stays, one of each text is left.
    """
    found = cut(similar_components(docs, words, similarity, radius, id_col=id_col, text_col=text_col))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    out = docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(out.where(F.col(id_col).isNull()))
