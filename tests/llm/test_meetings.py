"""Rows of the near-dedup stage's prefix join, one for a meeting and not for each shared shingle, and the memory of a block of near copies."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import simhash


def groups_below(n_groups: int, size: int, words: int = 240, changed: float = 0.03) -> list[str]:
    """Groups made from one text each, words changed anywhere: pairs share many shingles and have a Jaccard similarity near 0.7."""
    rng = random.Random(5)
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{i}" for i in range(words)]
        out += [" ".join(f"c{g}x{k}y{i}" if rng.random() < changed else w for i, w in enumerate(base)) for k in range(size)]
    return out


def live_of(spark, texts, similarity=0.8):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = simhash.set_prints(docs, 5).select("key", F.col("key").alias("root"))
    return simhash.live_features(simhash.shared_features(docs, 5, similarity), named)


def meetings(live, similarity=0.8):
    """Pairs whose first shared shingle leaves room for the overlap, and the number of shared shingles of their prefixes, by a loop."""
    held, size = {}, {}
    for r in live.collect():
        held.setdefault(r["key"], {})[r["f"]] = r["pos"]
        size[r["key"]] = r["size"]
    found = {}
    for a in held:
        for b in held:
            n1, n2 = size[a], size[b]
            common = held[a].keys() & held[b].keys()
            if (n1, a) >= (n2, b) or not common or n1 < similarity * n2 - 1e-6:
                continue
            f = min(common, key=held[a].get)
            short = n1 - -(-(2 * similarity / (1 + similarity) * n1 - 1e-9) // 1) + 1
            if held[a][f] <= short and 1 + min(n1 - held[a][f], n2 - held[b][f]) >= similarity / (1 + similarity) * (n1 + n2) - 1e-6:
                found[a, b] = len(common)
    return found


def test_a_pair_meets_about_once(spark):
    live = live_of(spark, groups_below(6, 20))
    expected = meetings(live)
    rows = [(r["k1"], r["k2"]) for r in simhash.prefix_pairs(live, 0.8).collect()]
    assert set(rows) == set(expected)
    assert sum(expected.values()) > 5 * len(expected) > 500  # what they share is much more than their number
    assert len(rows) <= 1.2 * len(expected)


def test_shingles_of_the_same_classes_are_one(spark):
    """A passage in the same two texts is one feature, and the candidates are those of all features."""
    live = live_of(spark, groups_below(8, 2))
    kept = simhash.folded(live)
    assert kept.count() == 2 * 8 < live.count() / 5
    assert {(r["k1"], r["k2"]) for r in simhash.prefix_pairs(live, 0.8).collect()} == set(meetings(live))


def test_candidates_are_one_row_a_pair(spark):
    """The bound on the overlap is that of a loop over both prefixes."""
    live = live_of(spark, groups_below(3, 12, changed=0.02))
    size = {r["key"]: r["size"] for r in live.collect()}
    rest = lambda n: n - (n - -(-(0.8 * n - 1e-9) // 1) + 1)
    expected = {p for p, m in meetings(live).items() if m + max(rest(size[k]) for k in p) >= 0.8 / 1.8 * sum(size[k] for k in p) - 1e-6}
    got = [(r["src"], r["dst"]) for r in simhash.prefix_candidates(live, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == expected != set()


def test_memory_of_a_block_of_near_copies():
    """All pairs of 1,500 near copies are links; few are held at once, and the forest is as light as that of all."""
    rng = np.random.default_rng(3)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (1500, 3), np.uint64), axis=1)).view(np.int64)
    block = {"fp": fps, "key": fps, "size": np.full(len(fps), 100, np.int32), "root": fps}
    x = {k: simhash.pa.array(v) for k, v in block.items()}
    tracemalloc.start()
    src, dst, _, _ = simhash.tile_links(x, x, True, 10, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(src) == len(fps) - 1
    weight = np.bitwise_count(src.view(np.uint64) ^ dst.view(np.uint64)).sum()
    u, v = np.triu_indices(len(fps), 1)
    d = np.bitwise_count(fps.view(np.uint64)[u] ^ fps.view(np.uint64)[v]).astype(np.int64)
    assert weight == simhash.forest(u, v, d, np.arange(len(fps)))[2].sum()
    assert peak < 40e6, peak
