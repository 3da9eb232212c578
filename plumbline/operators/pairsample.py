"""A sample of all pairs of items by similarity band, without forming the pairs.

Pairs from BANDS[1] on come from the similarity join, counted by class of equal
items. The lowest band is the complement: n (n - 1) / 2 pairs less the joined
ones. Its pairs are drawn by number, two positions for each draw, and a draw
whose pair belongs to a higher band is rejected, so every pair of the band is
equally likely, those that share nothing among them, and the band's size is
known without a look at it. A higher band draws a number below its size, finds
the pair of classes by running sums and a member of each by the smallest hash.
Draws are functions of the seed: equal seeds give equal samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalar import ratio
from plumbline.operators import calibrate, history, similarity
from plumbline.session import cut, written

#: Below this share of accepted draws the complement is no larger than what was joined, and is listed instead.
LEAST_SHARE = 1 / 64


def drawn(seed: int, band: Column | int, k: Column, what: str) -> Column:
    """A number of 60 bits for draw k."""
    band = band if isinstance(band, Column) else F.lit(band)
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), band.cast("string"), k.cast("string"), F.lit(what))), 1, 15), 16, 10).cast("long")


def band_sizes(total: int, pairs: DataFrame) -> dict[int, int]:
    """Pairs in each band that has any; the lowest is what the joined pairs leave of all."""
    rows = pairs.groupBy("band").agg(F.sum("n_pairs").alias("n")).collect()  # a row for each band
    sizes = {r["band"]: r["n"] for r in rows}
    sizes[0] = total * (total - 1) // 2 - sum(sizes.values())
    return {b: n for b, n in sorted(sizes.items()) if n > 0}


def quotas(n: int, sizes: dict[int, int]) -> dict[int, int]:
    """max(1, round(n * weight / weights of the bands there)) for each band, halves to even, and no more than it has."""
    whole = sum(calibrate.WEIGHTS[b] for b in sizes)
    return {b: min(size, max(1, round(n * calibrate.WEIGHTS[b] / whole))) for b, size in sizes.items()}


def first_distinct(draws: DataFrame, quota: int) -> DataFrame:
    """(a, b, score, band) of the first `quota` distinct pairs by draw; the draws are few."""
    once = draws.groupBy("a", "b").agg(F.min("k").alias("k"), F.first("score").alias("score"), F.first("band").alias("band"))
    return once.orderBy("k").limit(quota).select("a", "b", "score", "band")


def _until(make, quota: int) -> DataFrame:
    """Draws made until they hold `quota` distinct pairs."""
    m = 4 * quota + 16
    while True:
        draws = cut(make(m))
        if draws.select("a", "b").distinct().count() >= quota:
            return first_distinct(draws, quota)
        m *= 4


def complement_draws(members: DataFrame, sets: DataFrame, total: int, m: int, seed: int) -> DataFrame:
    """(k, a, b, score, band): the draws below m that fall into the lowest band."""
    draws = members.sparkSession.range(m).withColumnRenamed("id", "k")
    i = drawn(seed, 0, F.col("k"), "i") % total
    j = drawn(seed, 0, F.col("k"), "j") % (total - 1)
    both = draws.withColumn("i", i).withColumn("j", j).withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("long"))
    ends = cut(both.select("k", F.explode(F.array("i", "j")).alias("at")))
    # The draws are as many as the sample needs; the items and sets stay where they are.
    found = members.join(F.broadcast(ends), "at").select("k", "id", "class")
    found = cut(found)
    with_sets = sets.select(F.col("id").alias("class"), "s").join(F.broadcast(found), "class")
    side = with_sets.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("id", "class", "s"))).alias("e"))  # two a draw
    x, y = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    inter = F.size(F.array_intersect(x["s"], y["s"]))
    score = F.when(x["class"] == y["class"], 1.0).otherwise(ratio(inter, F.size(x["s"]) + F.size(y["s"]) - inter))
    return side.select("k", x["id"].alias("a"), y["id"].alias("b"), score.alias("score"), F.lit(0).alias("band")).where(F.col("score") < calibrate.BANDS[1])


def complement(members: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """(a, b, score, band) of every pair of the lowest band, for tables where nearly all pairs are in higher ones."""
    numbers = members.withColumn("other", F.explode(F.sequence(F.col("at"), F.lit(total - 1)))).where("other > at")
    right = members.select(F.col("at").alias("other"), F.col("id").alias("b"), F.col("class").alias("cb"))
    pairs = numbers.select("other", F.col("id").alias("a"), F.col("class").alias("ca")).join(right, "other")
    s = sets.select("id", "s")
    wide = pairs.join(s.select(F.col("id").alias("ca"), F.col("s").alias("sa")), "ca").join(s.select(F.col("id").alias("cb"), F.col("s").alias("sb")), "cb")
    inter = F.size(F.array_intersect("sa", "sb"))
    score = F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(ratio(inter, F.size("sa") + F.size("sb") - inter))
    out = wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score"), F.lit(0).alias("band"))
    return out.where(F.col("score") < calibrate.BANDS[1])


def running(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with `upto`, the sum of `value` over the rows before in the order, by ranges and their sums."""
    spread = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sums = spread.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__before"))  # a row for each range
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("upto", inside - F.col(value)).join(F.broadcast(before), "__p").withColumn("upto", F.col("upto") + F.col("__before")).drop("__p", "__before")


def _member(chosen: DataFrame, members: DataFrame, side: str, seed: int, apart: bool) -> DataFrame:
    """chosen with `side`: the member of its class with the smallest hash, other than `a` where `apart`."""
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("band").cast("string"), F.col("k").cast("string"), F.lit(side), F.col("id").cast("string")))
    held = members.select(F.col("class").alias(f"c{side}"), "id").join(F.broadcast(chosen), f"c{side}")
    if apart:
        held = held.where("id <> a")
    rest = [c for c in chosen.columns if c not in ("band", "k")]
    return held.groupBy("band", "k").agg(F.min_by("id", key).alias(side), *(F.first(c).alias(c) for c in rest))


def joined_draws(pairs: DataFrame, members: DataFrame, band: int, size: int, m: int, seed: int) -> DataFrame:
    """(k, a, b, score, band): draws below m from a band of the joined pairs, which hold running sums."""
    k = F.col("id")
    draws = members.sparkSession.range(m).select(k.alias("k"), (drawn(seed, band, k, "r") % size).alias("r"))
    hit = pairs.where(F.col("band") == band).join(F.broadcast(draws), (F.col("r") >= F.col("upto")) & (F.col("r") < F.col("upto") + F.col("n_pairs")))
    chosen = cut(hit.select("k", "band", F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("jaccard").alias("score")))
    first = cut(_member(chosen, members, "a", seed, False))
    out = _member(first, members, "b", seed, True)
    return out.select("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "band")


def all_of(pairs: DataFrame, members: DataFrame, band: int) -> DataFrame:
    """(a, b, score, band): every pair of items of a band that the sample takes whole."""
    small = cut(pairs.where(F.col("band") == band).select("band", F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("jaccard").alias("score")))
    one = members.select(F.col("class").alias("ca"), F.col("id").alias("a")).join(F.broadcast(small), "ca")
    two = one.join(members.select(F.col("class").alias("cb"), F.col("id").alias("b")), "cb").where("ca <> cb or a < b")
    return two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "band")


def pair_sample(members: DataFrame, sets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(a, b, score, band): about n of all pairs of items, by band weight over the bands that have pairs.

    members is (id, class), sets (id, copies, s, n) for each class of equal
    items, as `similarity.document_members` and `document_sets` give them. A
    band with no more pairs than its quota comes whole. Fewer than two items
    give no pair.
    """
    numbered = cut(history.numbered(members.select("id", "class"), "id"))
    total = numbered.count()
    joined = similarity.class_pairs(sets, similarity.similar_pairs(sets, calibrate.BANDS[1])).withColumn("band", calibrate.band(F.col("jaccard")))
    joined = written(joined.select("a", "b", "n_pairs", "jaccard", "band"))
    sizes = band_sizes(total, joined) if total > 1 else {}
    out = None
    for band, quota in quotas(n, sizes).items():
        if band == 0:
            share = 2 * sizes[0] / (total * (total - 1))
            if sizes[0] > quota and share >= LEAST_SHARE:
                part = _until(lambda m: complement_draws(numbered, sets, total, m, seed), quota)
            else:
                whole = complement(numbered, sets, total)
                order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")))
                part = whole.orderBy(order, "a", "b").limit(quota)
        elif sizes[band] <= quota:
            part = all_of(joined, numbered, band)
        else:
            summed = written(running(joined.where(F.col("band") == band), ["a", "b"], "n_pairs"))
            part = _until(lambda m, b=band, s=summed, q=sizes[band]: joined_draws(s, numbered, b, q, m, seed), quota)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return joined.select("a", "b", F.col("jaccard").alias("score"), "band").limit(0)
    return out
