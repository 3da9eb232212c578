"""The conversation trie against a trie of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, name string, path string, d long"


def by_loop(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        made[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids[s])
    return [
        (
            min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s],
            hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest(),
        )
        for s, m in members.items()
    ]


def check(spark, rows):
    table = spark.createDataFrame([(*r, "n", "p", 7) for r in rows], SCHEMA)
    out = trie.prefix_trie(table)
    got = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(by_loop(rows), key=repr)
    return out


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-7, 40), 10**15, 10**15 + 3]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "é漢", "", None, "long " * 50])))
    rows += [(3, None, "user", "first"), (3, None, None, "first"), (None, 1, "user", "x"), rows[5], rows[5]]
    check(spark, rows)


@pytest.mark.parametrize("block", [2, 3])
def test_long_conversations_go_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(trie.prefixes, "__defaults__", (block,))
    monkeypatch.setattr(trie.suffix_sums, "__defaults__", (block,))
    rng = random.Random(block)
    rows = [(c, t, "u", rng.choice("ab") if t > 3 else "same") for c in range(0, 60, 5) for t in range(rng.randint(1, 40))]
    check(spark, rows)


def test_hot_turn_conversation_and_text(spark):
    # one first turn for most, one text for a third, one conversation with a third of all rows
    rows = [(5 * c, 0, "user", "hello") for c in range(120)] + [(5 * c, 1, "user", f"q{c % 40}") for c in range(120)] + [(1000, t, "user", "again") for t in range(150)]
    out = check(spark, rows)
    assert out.agg({"light_depth": "max"}).first()[0] <= 7  # log2 of 121


def test_empty_and_turnless(spark):
    assert check(spark, []).count() == 0
    # 1's base is absent and h is more than its one turn: only the root is left
    assert zlib.crc32(b"1") % 9 >= 1
    assert check(spark, [(1, 0, "user", "x")]).count() == 1
