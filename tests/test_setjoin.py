"""The similarity join by tiles: against all pairs, with small tiles, full maps, unlike sides; what it writes for a group of near copies."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import setjoin, similarity


def rows(df):
    return sorted(map(tuple, df.collect()))


def near_copies(n, words=60):
    """Texts of a group that differ in one word from a common one, and some that share nothing."""
    base = [f"w{k}" for k in range(words)]
    texts = [" ".join([*base[: i % words], f"x{i}", *base[i % words + 1 :]]) for i in range(n)]
    return texts + [" ".join(f"own{i}_{k}" for k in range(20)) for i in range(20)]


def by_hand(sets, least):
    out = []
    for a in sets:
        for b in sets:
            inter, uni = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and uni and inter / uni >= least:
                out.append((a, b, inter, uni, inter / uni))
    return sorted(out)


def runs_of(text, gram=5):
    w = [v for v in re.split("[ \n\t\r]+", text or "") if v]
    return {tuple(w[i : i + gram]) for i in range(max(len(w) - gram + 1, 1))} if w else set()


def test_runs_of_odd_texts():
    texts = [None, "", " \n", "a", "a b c d e f a b c d e", "é b c d e f", "a\x0bb c d e f g", "x" * 3000 + " b c d e", "x" * 3000 + "y b c d e", "  p q r s t u\r\n", "p q r s t u"]
    got = setjoin.text_runs(pa.array(texts), 5).to_pylist()
    assert [len(g) for g in got] == [len(runs_of(t)) for t in texts]
    assert set(got[7]).isdisjoint(got[8])
    assert sorted(got[9]) == sorted(got[10])
    keys = setjoin.text_keys(pa.array(texts)).to_pylist()
    assert keys[9] == keys[10] and len(set(keys)) == len(texts) - 3  # null, empty and blank are one; the padded one is another's


def test_slices_of_a_batch_give_the_same(monkeypatch):
    rng = random.Random(1)
    texts = pa.array([" ".join(rng.choice("abcdefgh") * rng.randint(1, 30) for _ in range(rng.randint(0, 40))) for _ in range(200)])
    whole = setjoin.text_runs(texts, 3).to_pylist()
    monkeypatch.setattr(setjoin, "SLICE", 100)
    assert setjoin.text_runs(texts, 3).to_pylist() == whole == setjoin.text_runs(pa.concat_arrays([pa.array(["z"]), texts]).slice(1), 3).to_pylist()
    assert [len(g) for g in whole] == [len(runs_of(t, 3)) for t in texts.to_pylist()]


def test_numbers_packed():
    for high in (1, 200, 70_000, 20_000_000, 2**30):
        values = np.unique(np.random.default_rng(high).integers(0, high, 1000)).astype(np.uint64)
        assert (setjoin.unpacked(setjoin.packed(values)) == values).all()


@pytest.mark.parametrize("tile, most", [(200, 29), (similarity.TILE, 13)])
def test_exact_with_small_tiles_and_with_full_maps(spark, monkeypatch, tile, most):
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "LEAST_WEIGHT", 1)
    monkeypatch.setattr(setjoin, "MOST", most)
    texts = near_copies(60)
    sets = {i: runs_of(t) for i, t in enumerate(texts)}
    df = similarity.document_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expected = by_hand(sets, 0.45)
    assert len(expected) > 1000
    assert rows(similarity.similar_pairs(df)) == expected
    if tile == 200:
        assert similarity._met(df.select("id", "n", "s", F.lit(None).cast("boolean").alias("new")), 0.45, False).select("t").distinct().count() > 3


def test_a_group_of_near_copies_is_never_written_as_pairs(spark, monkeypatch):
    n, kept, put = 400, [], similarity.written
    df = similarity.document_sets(spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string"))

    def counted(one):
        out = put(one)
        kept.append(out.count())
        return out

    monkeypatch.setattr(similarity, "written", counted)
    pairs = similarity.similar_pairs(df).count()
    assert pairs == n * (n - 1) // 2
    assert max(kept) < pairs / 4


def test_repeated_texts_by_either_way(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(5, text, "x"), (3, " " + text, "y"), (9, text + " more", "z"), (7, "short", "x"), (8, None, "x")], "doc_id long, text string, source string")
    sides = []
    for most in (similarity.MOST_REPEATED, 0):
        monkeypatch.setattr(similarity, "MOST_REPEATED", most)
        sets = similarity.document_sets(docs, also="source")
        assert rows(sets.select("id", "copies", "n", "source")) == [(3, 2, 16, "y"), (9, 1, 17, "z")]
        sides.append(rows(sets.select("id", F.array_sort("s"))))
    assert sides[0] == sides[1]
    twice = spark.createDataFrame([(5, text), (5, text), (None, text + " a"), (None, text + " a")], "doc_id long, text string")
    monkeypatch.undo()
    assert sorted(map(str, rows(similarity.document_sets(twice).select(F.coalesce("id", F.lit(-1)), "copies")))) == ["(-1, 2)", "(5, 2)"]


def test_links_join_what_pairs_join(spark):
    n = 400
    df = similarity.document_sets(spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string"))
    links = similarity.similar_links(df)
    assert links.count() == n - 1  # one tile
    assert rows(similarity.clusters(df, links)) == [(i, 0) for i in range(n)]


#: What each gives for the group of 400 near copies and 20 other texts.
GROUPED = {
    "dup_document_clusters": lambda got: [r[2] for r in got] == [0] * 400 + [None] * 20,
    "dup_clusters": lambda got: got == [(i, 0) for i in range(400)],
    "dup_snapshot": lambda got: got == [(420, 1, 400, 400 / 420)],
    "dup_document_snapshot": lambda got: got == [(420, 1, 400, 400 / 420)],
}


@pytest.mark.parametrize("name", sorted(GROUPED))
def test_clusters_take_links_not_all_pairs(spark, monkeypatch, tmp_path, name):
    from plumbline.plans import queries

    spark.createDataFrame(list(enumerate(near_copies(400))), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    edges, find = [], similarity.connected_components
    monkeypatch.setattr(similarity, "connected_components", lambda df, *ends: edges.append(df.count()) or find(df, *ends))
    got = rows(queries.QUERIES[name](spark, str(tmp_path)))
    assert GROUPED[name](got)
    assert edges == [399]


#: Pairs at thresholds from 0.20 on in the group of 400 near copies; documents are counted with their copies.
SWEPT = {
    "dup_threshold_sweep": 400 * 399 // 2,
    "dup_document_sweep": 401 * 400 // 2,
}


@pytest.mark.parametrize("name", sorted(SWEPT))
def test_sweeps_write_no_pairs(spark, monkeypatch, tmp_path, name):
    from plumbline.plans import queries

    texts = near_copies(400)
    spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept, put = [], similarity.written

    def counted(one):
        out = put(one)
        kept.append(out.count())
        return out

    monkeypatch.setattr(similarity, "written", counted)
    got = rows(queries.QUERIES[name](spark, str(tmp_path)))
    assert len(got) == 13 and got[0] == (0.2, SWEPT[name])
    assert max(kept) < SWEPT[name] / 4


def test_batches_are_worked_on_in_pieces(monkeypatch):
    monkeypatch.setattr(setjoin, "PIECE", 10)
    s = pa.array([[1] * 4, None, [2] * 6, [3], [4] * 30, [], [5] * 2])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), s], names=["id", "s"])
    got = list(setjoin.pieces([batch, batch.slice(3)]))
    assert [b.column("id").to_pylist() for b in got] == [[0, 1, 2], [3], [4], [5, 6], [3], [4], [5, 6]]
    assert setjoin.flat(got[1].column("s"))[0].tolist() == [3]


def test_small_sets_of_a_tile_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 4000)
    sets = spark.createDataFrame([(i, [1, 2, 3, 100 + i % 7], 4) for i in range(100)], "id long, s array<bigint>, n int")
    met = similarity._met(sets.withColumn("new", F.lit(None).cast("boolean")), 0.45, False)
    assert met.groupBy("t", "u").count().agg(F.max("count")).first()[0] < 60
    assert similarity.similar_pairs(sets).count() == 100 * 99 // 2
