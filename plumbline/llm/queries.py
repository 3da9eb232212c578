"""Queries of the corpus operators, one opN_<name> for each, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import align, ann, bpe, exact_dedup, mixing, pii, quality, secrets, simhash, token_counts, trie, url_filter, warc
from plumbline.session import table

#: Key of the surrogates in the registered query; a deployment passes its own.
PII_KEY = "registered query"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf")
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    counts, total = url_filter.url_word_counts(pages)
    judged = url_filter.judge_urls(pages, counts, total=total)
    return judged.withColumn("words", F.concat_ws(" ", "words"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.replace_entities(table(spark, sf_dir, "documents"), PII_KEY)
    return made.select("doc_id", "text", "n_entities", *[f"n_{t}" for t in pii.TYPES])


def op8_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(rows), rows.where("vec_id % 50 = 0"), k=5)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures_of(table(spark, sf_dir, "pages"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("light_depth")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality_classifier, op3_poisson_mixing, op4_url_filter, op5_byte_bpe,
        op6_exact_dedup, op7_pii_surrogates, op8_rotated_codes, op9_simhash_near_dedup, op10_token_counts, op11_warc_transactions, op12_cross_tokenizer_alignment,
        op13_conversation_trie,
    )
}

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_poisson_mixing": mixing.mix_sql(),
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {ASCII_LOWER} AS low FROM documents),
        g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY low)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.low) AS text_sha256
        FROM d JOIN g USING (low)
    """,
    "op11_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        bits AS (SELECT *, unhex(sha1(body))::BIT::VARCHAR AS b FROM p)
        SELECT page_id, strlen(body) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT
                + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
            1::BIGINT AS n_requests, CASE WHEN page_id IS NOT DISTINCT FROM first THEN true END AS digest_ok
        FROM bits
    """,
    "op13_conversation_trie": """
        WITH RECURSIVE own AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n FROM own GROUP BY ALL),
        crc AS (
            SELECT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM ids
            UNION ALL
            SELECT conv_id, s, k + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END
            FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, ascii(s[k // 8 + 1])::BIGINT) ELSE v END AS w FROM crc) WHERE k < 8 * length(s)
        ),
        plan AS (
            SELECT a.conv_id, a.base, xor(v, 4294967295) % 9 AS h, least(xor(v, 4294967295) % 9, coalesce(b.n, 0)) AS k
            FROM ids a JOIN crc ON crc.conv_id = a.conv_id AND crc.k = 8 * length(s) LEFT JOIN ids b ON b.conv_id = a.base
        ),
        turns AS (
            SELECT p.conv_id, i AS d, role, text FROM plan p JOIN own o ON o.conv_id = p.base AND i <= k
            UNION ALL SELECT p.conv_id, i - h + k, role, text FROM plan p JOIN own o ON o.conv_id = p.conv_id AND i > h
        ),
        firsts AS (
            SELECT conv_id, d, strlen(text) AS bytes,
                sha256(string_agg(length(role) || '/' || length(text) || '/' || role || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS name
            FROM turns
            UNION ALL SELECT conv_id, 0, 0, '' FROM plan
        ),
        above AS (SELECT f.*, lag(name) OVER (PARTITION BY conv_id ORDER BY d) AS before, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM firsts f),
        nodes AS (
            SELECT name, any_value(before) AS before, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM above GROUP BY name
        ),
        kids AS (SELECT before, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY before),
        sums AS (
            SELECT f.name, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves
            FROM nodes n LEFT JOIN kids ON kids.before = n.name JOIN firsts f ON f.conv_id = n.conv_id AND f.d <= n.depth GROUP BY f.name
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums USING (name) LEFT JOIN kids ON kids.before = n.name LEFT JOIN nodes p ON p.name = n.before AND n.depth > 0
    """,
}
