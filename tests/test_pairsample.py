"""Sampling of all pairs by band: sizes, exact small bands, and even draws from the complement."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import calibrate, pairsample


def table_of(spark, groups):
    """members and sets of items given as (class, copies, features)."""
    sets = spark.createDataFrame([(c, n, s, len(s)) for c, n, s in groups], "id long, copies long, s array<string>, n int")
    members = spark.createDataFrame([(c + 1000 * k, c) for c, n, _ in groups for k in range(n)], "id long, class long")
    return members, sets


def scores(groups):
    items = [(c + 1000 * k, set(s)) for c, n, s in groups for k in range(n)]
    return {(min(a, b), max(a, b)): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(items, 2)}


def band_of(score):
    return max(i for i, low in enumerate(calibrate.BANDS) if score >= low)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(12)]
    out = [(i, 1, sorted(rng.sample(base, 6))) for i in range(12)]
    return out + [(100 + i, 1, [f"u{i}", f"v{i}"]) for i in range(12)] + [(50, 4, ["p", "q"]), (51, 2, ["p", "q", "r"])]


def test_scores_bands_and_quotas(spark, groups):
    members, sets = table_of(spark, groups)
    expected = scores(groups)
    sizes = {}
    for s in expected.values():
        sizes[band_of(s)] = sizes.get(band_of(s), 0) + 1
    for seed in (0, 7):
        rows = pairsample.pair_sample(members, sets, 40, seed).collect()
        assert len({(r["a"], r["b"]) for r in rows}) == len(rows)
        for r in rows:
            assert abs(expected[r["a"], r["b"]] - r["score"]) < 1e-12 and band_of(r["score"]) == r["band"]
        taken = {}
        for r in rows:
            taken[r["band"]] = taken.get(r["band"], 0) + 1
        assert taken == pairsample.quotas(40, sizes)


def test_equal_seeds_give_equal_samples_and_others_differ(spark, groups):
    members, sets = table_of(spark, groups)
    one, two, three = (sorted(map(tuple, pairsample.pair_sample(members, sets, 30, s).select("a", "b").collect())) for s in (1, 1, 2))
    assert one == two != three


def test_complement_draws_are_even(spark, groups):
    """Chi-square over the pairs of the lowest band; 0.999 quantile by the normal approximation of Wilson and Hilferty."""
    members, sets = table_of(spark, groups)
    low = [p for p, s in scores(groups).items() if s < calibrate.BANDS[1]]
    numbered = members.withColumn("at", F.row_number().over(Window.orderBy("id")) - 1)
    total = members.count()
    counts = {(r["a"], r["b"]): r["count"] for r in pairsample.complement_draws(numbered, sets, total, 20_000, 3).groupBy("a", "b").count().collect()}
    assert set(counts) == set(low)
    mean = sum(counts.values()) / len(low)
    chi = sum((counts[p] - mean) ** 2 / mean for p in low)
    k = len(low) - 1
    assert chi < k * (1 - 2 / (9 * k) + 3.09 * (2 / (9 * k)) ** 0.5) ** 3


def test_small_complement_is_listed(spark):
    groups = [(i, 1, ["a", "b", "c", f"x{i}"]) for i in range(30)] + [(90, 1, ["z"])]
    members, sets = table_of(spark, groups)
    rows = pairsample.pair_sample(members, sets, 12).where("band = 0").collect()
    assert rows and all(90 in (r["a"], r["b"]) and r["score"] == 0 for r in rows)


def test_too_few_items(spark):
    members, sets = table_of(spark, [(1, 1, ["a"])])
    assert pairsample.pair_sample(members, sets, 10).collect() == []


def test_pairs_are_kept_as_columns(spark, groups, monkeypatch):
    members, sets = table_of(spark, groups)
    kept, cut = [], pairsample.cut
    monkeypatch.setattr(pairsample, "cut", lambda df: kept.append(df.columns) or cut(df))
    assert pairsample.pair_sample(members, sets, 40).count()
    assert kept and not any("n_pairs" in columns for columns in kept)
