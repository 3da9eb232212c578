"""Cross-tokenizer alignment against a loop over whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import align

TEXTS = [
    None, "", " ", "\n", "a", "A b", "  two  spaces \n\n end ", "x  ", "<|endoftext|> x<|endoftext|>y </s> <unk>", "a▁b c", "naïve für größe 漢字漢字 don't",
    "tab\there\r\nand x\x1cy z\x00 q", "shared words shared words unbelievably", "é café ﬁ ① 🙂🙂", "q" * 700, "漢字" * 3000, "word and other " * 4000,
]


def by_loop(rows):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(align.BYTE_BPE))
    a.encode_special_tokens = True
    a.no_truncation()
    side_a, side_b = align.tokenizers(public_tokenizers.path(align.BYTE_BPE), public_tokenizers.path(align.PIECE_BPE))
    made, count = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = [], []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = side_b.library.encode(text)
            raw = b" " + text.encode()
            if b"".join(side_a.entry[i] for i in ids_a) != raw or b"".join(side_b.entry[i] for i in ids_b) != raw:
                ids_a, ids_b = [], []
        spans = []
        for ids, entry in ((ids_a, side_a.entry), (ids_b, side_b.entry)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(entry[i]), i))
                at += len(entry[i])
            spans.append(out)
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, spans[1][j][2]))
                j += 1
        common = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, part = [], ([], [])
        merged = sorted([(e, k, i) for k in (0, 1) for _, e, i in spans[k]])
        for n, (e, k, i) in enumerate(merged):
            part[k].append(str(i))
            if e in common and (n + 1 == len(merged) or merged[n + 1][0] != e):
                groups.append(",".join(part[0]) + "|" + ",".join(part[1]))
                part = ([], [])
        count.update(links)
        made.append((doc_id, ids_a, ids_b, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (
            d, len(x), len(y), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
        )
        for d, x, y, g, links in made
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(i if i else None, t) for i, t in enumerate(TEXTS)]
    return [*out, out[12], out[12], (99, "shared words")]


@pytest.mark.parametrize(("unit", "most"), [(align.UNIT, align.MOST_PAIRS), (50, 0)])
def test_alignment_equals_a_loop(spark, rows, unit, most):
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, links string, n long".replace("n long", "pieces string"))
    got = [tuple(r) for r in align.align(docs, unit=unit, most_pairs=most).collect()]
    assert sorted(got, key=repr) == sorted(by_loop(rows), key=repr)


def test_faster_library_gives_the_same_tokens():
    side = align.ByteBpe(public_tokenizers.path(align.BYTE_BPE))
    assert side.ranked is not None
    for t in TEXTS:
        if t:
            assert side.library.encode(" " + t, add_special_tokens=False).ids == side.ids(" " + t).tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = align.align(docs)
    assert out.collect() == []
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_kept_links_are_the_counted_ones(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = align.align(docs, keep_links=True)
    assert out.where(F.size("links") != F.col("n_links")).count() == 0


def test_groups_are_written_once_a_piece(spark):
    """Each distinct piece of a unit has its groups as text, however often texts hold it."""
    docs = spark.createDataFrame([(i, "shared words " * 50) for i in range(4)], "doc_id long, text string").coalesce(1)
    units = align.tokenised(docs, ["doc_id"], "text", public_tokenizers.path(align.BYTE_BPE), public_tokenizers.path(align.PIECE_BPE))
    forms = units.withColumn("forms", F.transform("shapes", align.form_of))
    made = forms.select(F.transform("pieces", lambda p: align.piece_of(p, F.col("forms"))).alias("m")).selectExpr("explode(m) AS m").select("m.*").collect()
    assert len(made) == 3  # shared, words, and the last with its space
    for r in made:
        groups = [[x.split(",") for x in g.split("|")] for g in r["groups"].split(";")]
        assert all(len(g) == 2 and all(int(i) >= 0 for x in g for i in x) for g in groups)
        assert len(r["links"]) == sum(len(x) for g in groups for x in g) - len(groups)
