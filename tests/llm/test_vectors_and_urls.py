"""Nearest neighbours against brute force; URL rules, segmentation and scores."""

import math

import numpy as np
import pytest

from plumbline.llm import ann, url_filter


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((900, 40)).astype(np.float32)
    vectors[5] = vectors[4]  # ties
    vectors[6] = 2 * vectors[4]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    bad = [None, [], [0.0] * 40, [float("nan")] * 40, [None] * 40, [float("inf")] * 40, [1.0, 2.0]]
    rows += [(1000 + 50 * i, v, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")
    asked = df.where("vec_id % 50 = 0 or vec_id = 4")
    got = {}
    for r in ann.search(ann.build_index(df), asked).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    assert set(got) == {*range(0, 900, 50), 4}
    for q, found in got.items():
        score = unit @ unit[q]
        assert all(abs(score[v] - s) < 1e-12 for v, s in found.values())
        order = [v for v in np.lexsort((np.arange(900), -score)) if v != q][:5]
        hits += len(set(order) & {v for v, _ in found.values()})
        assert [found[r] for r in sorted(found)] == sorted(found.values(), key=lambda x: (-x[1], x[0]))
    assert hits >= 0.95 * 5 * len(got)
    assert [got[4][1][0], got[4][2][0]] == [5, 6]


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(ann.build_index(df), df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(1, 1), (2, 2)]
    assert got[0]["score"] == pytest.approx(math.sqrt(0.5))
    none = df.limit(0)
    assert ann.search(ann.build_index(none), none).count() == 0
    assert ann.search(ann.build_index(df), none).count() == 0


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((500, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn = ann.rotation(64)
    codes, corrections = ann.encode(unit, turn)
    query = ann.Query(unit[:50], turn)
    estimate = query.estimate(codes, corrections, np.bitwise_count(codes).sum(axis=1), slice(0, 50))
    error = ann.EPS * np.sqrt((1 - corrections**2) / corrections**2 / 63)
    off = np.abs(estimate - unit[:50] @ unit.T)
    np.fill_diagonal(off[:, :50], 0)
    assert (off <= error[None, :]).mean() > 0.97


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2#t", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org", "notexample.org", "", None, "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com?/de/", "x.com", "", None, "allow"),
        ("http://cheappills.net/a", "cheappills.net", "/a", None, "block"),
        ("http://www.free-bets.net/", "www.free-bets.net", "/", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://İ.com/de/x", "İ.com", "/de/x", "com/de/", "block"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, 0.5), (1, url, 0.5)], "page_id long, url string, score double")
    rows = url_filter.judge_urls(df, {"the": 50, "ill": 3, "pill": 2}).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_segmentation_is_the_cheapest():
    import itertools

    seg = url_filter.Segmenter({"the": 90, "rein": 5, "there": 20, "in": 60, "he": 9, "t": 1})
    for name in ("therein", "thethere", "inxx", "zzz"):
        cuts = [
            [name[a:b] for a, b in itertools.pairwise((0, *c, len(name)))]
            for k in range(len(name))
            for c in itertools.combinations(range(1, len(name)), k)
        ]
        best = min(sum(map(seg.price, c)) for c in cuts)
        assert math.isclose(sum(map(seg.price, seg.split(name))), best)


def test_unigram_counts(spark):
    rows = [(1, "<html><TITLE>The cat the</TITLE><p>no"), (2, None), (3, "<title>cat\n42</title>"), (4, "")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert url_filter.unigram_counts(df) == {"the": 2, "cat": 2}
    assert url_filter.unigram_counts(df.limit(0)) == {}
    more = spark.createDataFrame([(1, "<title>aa aa aa bb bb cc dd</title>")], "page_id long, html string")
    assert url_filter.unigram_counts(more, size=3) == {"aa": 3, "bb": 2}
    assert url_filter.unigram_counts(more, size=4) == {"aa": 3, "bb": 2, "cc": 1, "dd": 1}


def test_rare_words_count_at_any_size(spark, tmp_path):
    from plumbline.llm import queries

    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["q" + "".join(letters[k // 26**i % 26] for i in range(4)) for k in range(60_000)]  # one count each
    titles = ["es " * 50 + "sex essex sex", *(" ".join(rare[i : i + 1000]) for i in range(0, 60_000, 1000))]
    urls = ["http://essex.org/x", *(f"http://{rare[i]}{rare[i + 1]}.net/es/Essex" for i in range(0, 60_000, 1000))]
    rows = [(i, u, f"<title>{t}</title>") for i, (u, t) in enumerate(zip(urls, titles, strict=True))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["words"] for r in queries.op4_url_filter(spark, str(tmp_path)).collect()}
    assert got[0] == "essex org x"
    assert got[1] == f"{rare[0]} {rare[1]} net es essex"
    plain = url_filter.judge_urls(df, url_filter.unigram_counts(df, size=10**9))
    assert got == {r["page_id"]: " ".join(r["words"]) for r in plain.collect()}
    counts, total = url_filter.url_word_counts(df, most=10)
    assert not isinstance(counts, dict)
    joined = url_filter.judge_urls(df, counts, total=total)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
