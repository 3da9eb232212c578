"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score): one weight vector over hashed
text features is shared by all grades, and ordered thresholds cut its score.
Grades come from the labels: 0 low quality, 1 good but toxic, 2 good. The model
gives the expected grade and the tail probability P(grade >= 1), and a document
is kept when that tail probability is at least `keep_at`.

A document's score is the mean over its words of the weights of the hashed word
and of its hashed shape, plus the weights of hashed features of the whole text
(length, share of repeated neighbours, share of distinct words).
"""

from __future__ import annotations

import itertools
import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.texts import map_rows, strings

BUCKETS = 1 << 13
FIT_ROWS = 6000
CACHE = 500_000


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def shape(word: str) -> str:
    """Runs of lower, upper, digit and other letters as one sign each; marks as they are, runs once."""
    signs = ("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c for c in word[:64])
    return "".join(c for c, _ in itertools.groupby(signs))


def text_features(words: list[str]) -> list[int]:
    """Hashed features of the whole text."""
    n = len(words)
    if not n:
        return [_hash("t empty")]
    same = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    size = n.bit_length()
    return [_hash(f"t size {size}"), _hash(f"t same {same * 10 // n}"), _hash(f"t distinct {size} {len(set(words)) * 10 // n}")]


class Weights(dict):
    """word -> summed weight of its two features."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = float(self.w[_hash("w " + word.lower())] + self.w[_hash("s " + shape(word))])
        return value

    def score(self, text: str) -> float:
        words = text.split()
        total = sum(map(self.__getitem__, words)) / len(words) if words else 0.0
        return total + float(self.w[text_features(words)].sum())


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) with which a weight vector gives Weights.score."""
    words = text.split()
    ids = [_hash("w " + x.lower()) for x in words] + [_hash("s " + shape(x)) for x in words]
    first, count = np.unique(np.array(ids, np.int64), return_counts=True)
    more, n_more = np.unique(np.array(text_features(words), np.int64), return_counts=True)
    value = count / len(words) if words else count.astype(float)
    return np.concatenate([first, more]), np.concatenate([value, n_more.astype(float)])


def tail_probabilities(score, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold k, along the last axis."""
    return 1 / (1 + np.exp(np.clip(thresholds - np.asarray(score, float)[..., None], -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int = 3, steps: int = 250, rate: float = 0.05, l2: float = 1e-5):
    """(weights, thresholds) by Adam on the cumulative-link likelihood; thresholds stay ordered.

    Without rows the weights are zero and the thresholds keep everything.
    """
    w = np.zeros(BUCKETS)
    y = np.array(grades, int)
    if not len(y):
        return w, np.full(n_grades - 1, -4.0)
    # Start at the grades' own shares, smoothed, so that a missing grade does no harm.
    share = (np.bincount(y, minlength=n_grades) + 0.5) / (len(y) + 0.5 * n_grades)
    below = np.cumsum(share)[:-1]
    cuts = np.log(below / (1 - below))
    raw = np.concatenate([cuts[:1], np.log(np.diff(cuts))])
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    m = [np.zeros(BUCKETS + len(raw)) for _ in range(2)]
    for step in range(1, steps + 1):
        t = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.add.reduceat(value * w[index], starts)
        up, low = (1 / (1 + np.exp(-np.clip(edges[y + k] - s, -50, 50))) for k in (1, 0))
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_s = (d_up - d_low) / len(y)  # of the mean negative log-likelihood
        g_w = np.bincount(index, weights=value * g_s[row], minlength=BUCKETS) + l2 * w
        g_t = np.array([(d_low[y == k + 1].sum() - d_up[y == k].sum()) / len(y) for k in range(n_grades - 1)])
        g_raw = np.concatenate([[g_t.sum()], np.exp(raw[1:]) * g_t[::-1].cumsum()[::-1][1:]])
        g = np.concatenate([g_w, g_raw])
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:BUCKETS]
        raw -= move[BUCKETS:]
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text"):
    """Fit on at most `fit_rows` labelled documents, those with the smallest seeded hash of the id.

    Only hashed features of the sample reach the driver, one row for each
    labelled id however often the documents repeat it. Labels with a null id
    or quality are left out; a null toxic counts as 0; of contradicting labels
    of one id the lowest grade holds.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(grade).alias("__grade"))
    sample = known.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "__id")
    # An id that many rows repeat is one row of the sample: the text with the smallest digest.
    picked = rows.groupBy("__id").agg(F.first("__grade").alias("__grade"), F.min_by("text", F.sha2("text", 256)).alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = [sparse(x) for x in strings(batch.column(1))]
            return {
                "grade": batch.column(0),
                "ids": [r[0].astype("<i4").tobytes() for r in rows],
                "values": [r[1].astype("<f4").tobytes() for r in rows],
            }

        return work

    got = map_rows(picked.select("__grade", "text"), make, "grade int, ids binary, values binary").toArrow()
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4").astype(float)) for a, b in zip(got["ids"].to_pylist(), got["values"].to_pylist(), strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (got["grade"][i].as_py(), rows[i][0].tobytes(), rows[i][1].tobytes()))
    return fit([rows[i] for i in order], [got["grade"][i].as_py() for i in order])


def classify(docs: DataFrame, model, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, expected_grade, p_tail, keep for every whole text.

    Null and empty texts are judged by the feature of an empty text; repeated
    rows stay repeated; an empty table gives an empty result. With
    keep_columns the rows carry docs' own columns instead of the id; columns
    with the new names give way to them.
    """
    w, thresholds = model
    shared = docs.sparkSession.sparkContext.broadcast((w, thresholds))  # 8,192 weights, whatever the data
    new = ("expected_grade", "p_tail", "keep")
    names = [c for c in docs.columns if c.lower() not in new] if keep_columns else ["doc_id"]
    kept = docs.select(*[docs[c] for c in (names if keep_columns else [id_col])], docs[text_col].cast("string").alias("__judged"))
    ddl = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, kept.schema.fields, strict=False))

    def make():
        weights, cuts = Weights(shared.value[0]), shared.value[1]

        def work(batch: pa.RecordBatch) -> dict:
            tails = tail_probabilities([weights.score(x) for x in strings(batch.column(batch.num_columns - 1))], cuts)
            out = {n: batch.column(i) for i, n in enumerate(names)}
            return out | {"expected_grade": tails.sum(axis=1).tolist(), "p_tail": tails[:, 0].tolist(), "keep": (tails[:, 0] >= keep_at).tolist()}

        return work

    return map_rows(kept, make, f"{ddl}, expected_grade double, p_tail double, keep boolean")
