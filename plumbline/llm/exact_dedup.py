"""Exact dedup: a tree-merge of sorted digest runs.

Every document becomes a digest of its normalised text. Each partition holds a
run: its digests in order, one entry per digest with the identifier that would
stay and the number of rows. Runs then meet in rounds of a tree: in every round
`fan_in` neighbouring leaves send their runs to the tasks of their parent, cut
by digest, so a parent is never a single task. There the shuffle's own merge of
sorted runs brings equal digests together and a streaming pass folds them.
After the last round each digest has one entry. A key is the pair (SHA-256,
byte length), verified at every fold: entries of one digest with different
lengths stop the job instead of merging.

Decisions go down the same tree by (leaf, digest), so a text that makes up a
third of all rows is spread over all leaves on the way up and down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.texts import map_arrow, map_rows, raw
from plumbline.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "leaf int, digest string, n_bytes long, best long, n long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n_bytes): SHA-256 of the text with A-Z lower-cased; null is empty."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            low = [x.lower() for x in raw(batch.column(1))]  # bytes.lower() changes A-Z only
            return {
                "doc_id": batch.column(0),
                "text_sha256": [hashlib.sha256(x).hexdigest() for x in low],
                "n_bytes": [len(x) for x in low],
            }

        return work

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(kept, make, "doc_id long, text_sha256 string, n_bytes long")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Fold neighbours with the same (leaf, digest) in a sorted stream; memory stays at one batch."""
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def flush(rows: list[list]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["leaf", "digest", "n_bytes", "best", "n"])

    held: list | None = None
    out: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[1] == row[1] and held[0] == row[0]:
                if held[2] != row[2]:
                    raise ValueError(f"texts of {held[2]} and {row[2]} bytes share the digest {row[1]}")
                if held[3] is None or (row[3] is not None and row[3] > held[3]):
                    held[3] = row[3]
                held[4] += row[4]
                continue
            if held is not None:
                out.append(held)
            held = list(row)
        if len(out) >= 8192:
            yield flush(out)
            out = []
    if held is not None:
        out.append(held)
    if out:
        yield flush(out)


def merge_tree(rows: DataFrame, n_leaves: int = 256, fan_in: int = 16) -> DataFrame:
    """One row per digest (digest, n_bytes, best, n) from rows (leaf, digest, n_bytes, best, n)."""
    runs = rows.select("leaf", "digest", "n_bytes", "best", "n")
    runs = map_arrow(runs.sortWithinPartitions("leaf", "digest"), _fold, RUN)
    width = n_leaves
    while width > 1:
        width = -(-width // fan_in)
        runs = runs.withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("int"))
        runs = map_arrow(runs.repartition("leaf", "digest").sortWithinPartitions("leaf", "digest"), _fold, RUN)
    return runs.drop("leaf")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_leaves: int = 256, fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the largest id stays; a null id never stays if the
    group has another, and a group of null ids has keep_id null with every row
    kept=true. Repeated rows (same id, same text) each give a row and count in
    group_size. Other columns are ignored; an empty table gives an empty result.
    """
    leaf = F.pmod(F.xxhash64("doc_id"), F.lit(n_leaves)).cast("int")
    rows = cut(digests(docs, id_col, text_col).withColumn("leaf", leaf))
    root = merge_tree(
        rows.select("leaf", F.col("text_sha256").alias("digest"), "n_bytes", F.col("doc_id").alias("best"), F.lit(1).cast("long").alias("n")),
        n_leaves,
        fan_in,
    ).select(F.col("digest").alias("text_sha256"), F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    leaves = rows.select("leaf", "text_sha256").distinct().join(root, "text_sha256")
    return rows.join(leaves, ["leaf", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies: one row of each group stays, with all its columns.

    Rows are found again by id, null-safe. Where several rows carry the id that
    stays (repeated rows), one of them is left, whichever comes first.
    """
    groups = cut(exact_groups(docs, id_col, text_col))
    kept = groups.where("kept")
    sums = groups.agg(F.count_if("kept").alias("rows"), F.count_distinct("text_sha256").alias("groups")).first()
    key = kept.select("doc_id")
    if sums["rows"] == sums["groups"] and kept.where("doc_id is null").isEmpty() and groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(key, docs[id_col] == key["doc_id"], "left_semi")
    # Repeated ids: the text's digest tells which of an id's rows stays.
    low = F.sha2(F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), UPPER, UPPER.lower()), 256)
    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"), low.alias("sha"))
    pairs = kept.select("doc_id", "text_sha256").distinct()
    match = marked["id"].eqNullSafe(pairs["doc_id"]) & (marked["sha"] == pairs["text_sha256"])
    return marked.join(pairs, match, "left_semi").dropDuplicates(["sha"]).select("row.*")
