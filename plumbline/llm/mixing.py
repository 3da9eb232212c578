"""Mixing sources to target weights by Poisson replication.

Every source has a target repetition rate: its share of the mix times the size
of the mix, over its own rows. Each document's number of copies is the inverse
of the Poisson distribution with that rate at a uniform number that a seeded
hash of the document's id gives. Documents are exploded by that number and the
copies shuffled globally: a hashed key deals them to partitions at random and
orders them inside. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 128.0  # a rate above this is a sum of equal Poisson numbers, so that exp(-rate) is never lost
UNIT = float(1 << 52)


def source_rates(docs: DataFrame, targets: dict[str, float] | None, total: float | None, temperature: float, source_col: str) -> tuple[DataFrame, int]:
    """(source, rate) and the number of sources; a null source is the source ''.

    With targets, shares are the given weights over their sum, among sources
    that have rows; other sources have rate 0. Without, the share of a source
    with n rows is n**temperature over the sum of these.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if any(w < 0 for w in targets.values()):
            raise ValueError("a target weight is negative")
        given = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))]) if targets else None
        weight = F.coalesce(given[F.col("__source")], F.lit(0.0)) if targets else F.lit(0.0)
    weighted = counts.withColumn("w", weight)
    sums = weighted.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    whole, size = sums["w"] or 0.0, float(total if total is not None else sums["n"] or 0)
    rate = F.lit(0.0) if not whole else F.col("w") / F.lit(whole) * F.lit(size) / F.col("n").cast("double")
    return weighted.select(F.col("__source"), rate.alias("rate")), sums["k"]


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds parts and cdf: cdf[k] = P(X <= k) at rate / parts, as far as a double can tell from 1."""
    parts = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    each = parts.withColumn("each", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("each") + 12 * F.sqrt("each") + 40).cast("int")
    first = F.exp(-F.col("each"))
    state = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def grow(s, k):
        p = s["p"] * F.col("each") / k.cast("double")
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["cdf"], F.array(s["c"] + p)).alias("cdf"))

    return each.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), state, grow, lambda s: s["cdf"])).drop("each")


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("double") / UNIT


def mix_sources(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    total: float | None = None,
    temperature: float = 0.5,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    broadcast_sources: int = 10_000,
) -> DataFrame:
    """docs' columns, copy (from 1) and shuffle_key, replicated and in shuffled order.

    total is the expected number of rows of the mix (default: as many as docs
    has). A null id hashes like an empty one and a null source is a source of
    its own; rows that repeat an id are replicated alike, each by itself.
    Columns copy and shuffle_key of docs give way to the new ones. An empty
    table gives an empty result. Up to `broadcast_sources` sources (a few hundred bytes each) their
    rates are broadcast, beyond that they are joined by source and salt, so
    that a source with a third of all rows is spread.
    """
    rates, n_sources = source_rates(docs, targets, total, temperature, source_col)
    rates = with_distribution(rates)
    own = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    # The row travels as one column, so that none of its names can clash with those made here.
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in own)).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), source.alias("__source"))
    if n_sources <= broadcast_sources:
        rated = rows.join(F.broadcast(rates), "__source")
    else:
        salts = 64
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rated = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(salted, ["__source", "salt"])
    drawn = F.transform(
        F.sequence(F.lit(1), F.col("parts")), lambda i: F.size(F.filter("cdf", lambda c: c <= uniform(F.col("key"), F.lit(str(seed)), i.cast("string"))))
    )
    counted = rated.withColumn("n", F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).where("n > 0")
    copies = counted.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    shuffle_key = F.md5(F.concat_ws("/", "key", F.col("copy").cast("string"), F.lit(f"{seed} shuffle")))
    keyed = copies.select("row.*", "copy", shuffle_key.alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(temperature: float = 0.5, seed: int = 17) -> str:
    """DuckDB SQL for mix_sources over `documents` without targets, for rates up to PART."""
    return f"""
        WITH RECURSIVE d AS (SELECT *, coalesce(source, '') AS src, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
        c AS (SELECT src, count(*) AS n FROM d GROUP BY src),
        r AS (SELECT src, pow(n::DOUBLE, {temperature}) / (SELECT sum(pow(n::DOUBLE, {temperature})) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n::DOUBLE AS rate FROM c),
        t AS (
            SELECT src, rate, 0 AS i, exp(-rate) AS p, exp(-rate) AS cdf FROM r
            UNION ALL
            SELECT src, rate, i + 1, p * rate / (i + 1)::DOUBLE, cdf + p * rate / (i + 1)::DOUBLE FROM t WHERE i < ceil(rate + 12 * sqrt(rate) + 40)
        ),
        l AS (SELECT src, list(cdf ORDER BY i) AS cdfs FROM t GROUP BY src),
        n AS (
            SELECT d.*, len(list_filter(l.cdfs, lambda c: c <= ('0x' || substr(md5(k || '/{seed}/1'), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0)) AS m
            FROM d JOIN l USING (src)
        ),
        e AS (SELECT *, unnest(range(1, m + 1))::INT AS copy FROM n WHERE m > 0)
        SELECT doc_id, text, lang, source, n_chars, copy, md5(k || '/' || copy || '/{seed} shuffle') AS shuffle_key FROM e
    """
