"""Each pipeline stage against brute force on its own input, and the whole run."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import bpe, quality, simhash
from plumbline.session import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output rows."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, DATA, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append((before, docs.collect(), docs.columns))
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == list(corpus_pipeline.COLUMNS)


def test_quality(spark, stages):
    before, after, _ = stages[0]
    w, cuts = quality.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    expected = set()
    for r in before:
        index, value = quality.sparse(r["text"] or "")
        if 1 / (1 + math.exp(cuts[0] - (value * w[index]).sum())) >= 0.5:
            expected.add(r["doc_id"])
    assert {r["doc_id"] for r in after} == expected
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
    judged = [(labels[r["doc_id"]] == 1) == (r["doc_id"] in expected) for r in before if r["doc_id"] in labels]
    assert np.mean(judged) > 0.97


def test_exact(stages):
    before, after, _ = stages[1]
    keep = {}
    for r in before:
        low = (r["text"] or "").encode().lower()
        keep[low] = max(keep.get(low, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(keep.values())


def test_near_by_similarity_alone(stages):
    before, after, _ = stages[2]
    rows = sorted(before, key=lambda r: r["doc_id"])
    sets = [set(simhash.shingle_hashes((r["text"] or "").encode().lower(), 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]


def test_mixing(stages):
    before, after, _ = stages[3]
    n = Counter(r["source"] for r in before)
    whole = sum(c**0.5 for c in n.values())
    expected = Counter()
    for r in before:
        rate = n[r["source"]] ** 0.5 / whole * len(before) / n[r["source"]]
        u = int(hashlib.md5(f"{r['doc_id']}/17/1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        expected[tuple(r)] += k
    assert Counter(tuple(r) for r in after) == +expected


def test_encoding(stages):
    before, after, _ = stages[4]
    encoding = bpe.load_encoding(bpe.rank_path())
    expected = []
    for r in before:
        ids = encoding.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], r["source"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, after), key=repr) == sorted(expected, key=repr)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, got.collect())) == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[4][1])


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, extra columns; no rows at all."""
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 1), (1, "", "en", None, 0, 1), (2, None, None, "s", None, 2), (3, "a b c d e f g", "en", "s", 13, 3), (4, "A b c d e f g", "en", "s", 13, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep int"
    for rows_in in (rows, []):
        docs = spark.createDataFrame(rows_in, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows_in)}-{k}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() == 0) or rows_in


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark, monkeypatch):
    """Many rows of one id fetch as much as one, and the model doesn't depend on how often they repeat."""
    texts = [(i, f"word{i % 7} good text number {i}" if i % 2 else f"junk{i} ### {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    sizes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, grades, *a: sizes.append(len(rows)) or fit(rows, grades, *a))
    models = [quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (texts, texts + [texts[3]] * 500)]
    assert sizes == [40, 40]
    assert (models[0][0] == models[1][0]).all() and (models[0][1] == models[1][1]).all()


def test_gradient_of_the_fit(spark):
    """The fitted weights leave no descent: the loss near them is no lower in random directions."""
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(quality.BUCKETS, 5, replace=False)).astype("<i4"), rng.random(5)) for _ in range(60)]
    grades = [int(r[1].sum() > 2.2) + int(r[1].sum() > 2.8) for r in rows]
    w, t = quality.fit(rows, grades, steps=3000)

    def loss(w, t):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.array([v @ w[i] for i, v in rows])
        y = np.array(grades)
        p = 1 / (1 + np.exp(-(edges[y + 1] - s))) - 1 / (1 + np.exp(-(edges[y] - s)))
        return -np.log(np.maximum(p, 1e-12)).mean()

    start = loss(np.zeros_like(w), t)
    here = loss(w, t)
    assert here < start
    step = 1e-3 * np.array([1.0, -1.0])
    for d in step:  # thresholds carry no penalty, so the slope there is flat
        assert abs(loss(w, t + np.array([d, 0])) - here) < 1e-4 and abs(loss(w, t + np.array([0, d])) - here) < 1e-4
