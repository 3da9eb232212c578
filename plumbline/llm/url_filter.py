"""URL filters: fixed rules, then host word segmentation and naive Bayes.

Names that run words together (`cheappills`) are split by unigram Viterbi: the
split with the largest product of word probabilities, an unknown word costing
ten times more with each letter. Counts come from the titles of all pages
plus the words of the training phrases. A multinomial naive Bayes over the
words of host and path then gives the log-odds of block.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.texts import map_rows, strings
from plumbline.session import cut

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Training phrases of the classifier: short names of pages of either kind.
BLOCK_PHRASES = (
    "cheap pills", "free bets", "adult x", "spam farm", "online casino", "casino bonus", "poker slots", "buy pills", "cheap viagra",
    "free slots", "adult video", "adult cams", "sex cams", "porn tube", "xxx video", "hot escort", "payday loan", "fast loan cash",
    "win prize", "free prize", "lottery win", "replica watch", "cheap replica", "warez crack", "crack keygen", "torrent warez",
    "bets bonus", "betting tips casino", "pills discount", "pharma discount pills", "link farm", "spam links", "click spam", "x rated adult",
)
ALLOW_PHRASES = (
    "news today", "daily news", "blog post", "my blog", "city library", "school board", "open university", "museum of art", "science journal",
    "health service", "travel guide", "garden club", "music school", "food recipes", "weather report", "history archive", "sports club",
    "public radio", "book review", "open source", "help docs", "user guide", "wiki page", "home page", "mobile site", "local council",
    "research group", "data archive", "art gallery", "family farm shop", "free library", "video lessons", "watch repair", "bank cash desk",
)

VOCABULARY = 50_000
LONGEST = 24
WORD = re.compile(r"[a-z]+|[0-9]+")


def parse(url: str | None) -> tuple[str, str]:
    """(host, path): host up to `/`, `?`, `#` or end with A-Z lower-cased, path up to `?`, `#` or end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    cut = end.start() if end else len(rest)
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    return host, re.split(r"[?#]", rest[cut:], maxsplit=1)[0]


def match_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0])) if fits else None


class Segmenter:
    """Unigram Viterbi over one run of letters."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}
        self.unknown = math.log(total) - math.log(10)
        self.kept: dict[str, list[str]] = {}

    def price(self, word: str) -> float:
        found = self.cost.get(word)
        return found if found is not None else self.unknown + len(word) * math.log(10)

    def split(self, name: str) -> list[str]:
        """Words of a run; of equal splits the one with the shorter last words."""
        if name in self.kept:
            return self.kept[name]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(min((best[start][0] + self.price(name[start:end]), -start) for start in range(max(0, end - LONGEST), end)))
        words, end = [], len(name)
        while end:
            start = -best[end][1]
            words.append(name[start:end])
            end = start
        if len(self.kept) > 100_000:
            self.kept.clear()
        self.kept[name] = words[::-1]
        return self.kept[name]

    def words(self, text: str) -> list[str]:
        return [w for run in WORD.findall(text.lower()) for w in (self.split(run) if run[0].isalpha() else [run])]


class NaiveBayes:
    """Multinomial, with add-half smoothing; words that training never saw and single letters say nothing."""

    def __init__(self, block=BLOCK_PHRASES, allow=ALLOW_PHRASES, prior_block: float = 0.3, smooth: float = 0.5):
        counts = [Counter(w for p in phrases for w in p.split() if len(w) > 1) for phrases in (block, allow)]
        words = set(counts[0]) | set(counts[1])
        sums = [sum(c.values()) + smooth * len(words) for c in counts]
        self.bias = math.log(prior_block / (1 - prior_block))
        self.odds = {w: math.log((counts[0][w] + smooth) / sums[0]) - math.log((counts[1][w] + smooth) / sums[1]) for w in words}

    def score(self, words: list[str]) -> float:
        return self.bias + sum(self.odds.get(w, 0.0) for w in words)


def title_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, count) of all words a-z of all page titles."""
    title = F.lower(F.regexp_extract(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"(?is)<title>(.*?)</title>", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"[a-z]{2,%d}" % LONGEST), F.lit(0))).alias("word"))
    return cut(words.groupBy("word").count())


def parts_of(url: str) -> set[str]:
    """All substrings that the segmentation of a URL may ask for."""
    runs = {run for x in parse(url) for run in WORD.findall(x.lower()) if run[0].isalpha()}
    return {run[a:b] for run in runs for a in range(len(run)) for b in range(a + 2, min(len(run), a + LONGEST) + 1)}


def url_word_counts(pages: DataFrame, most: int = 500_000, html_col: str = "html", url_col: str = "url") -> tuple[dict[str, int] | DataFrame, int]:
    """Counts of the title words that lie in some URL, and the sum over all title words.

    No count is lost at any size: words that no URL holds can't change a split.
    Up to `most` words the counts are a dictionary, beyond that a table (word, count).
    """
    counts = title_counts(pages, html_col)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    urls = pages.select(F.col(url_col).cast("string").alias("url"))

    def make():
        return lambda batch: {"word": list(set().union(*map(parts_of, strings(batch.column(0)))))}

    found = cut(counts.join(map_rows(urls, make, "word string").distinct(), "word", "left_semi"))
    if found.limit(most + 1).count() > most:
        return found, total
    return {r["word"]: r["count"] for r in found.toLocalIterator()}, total


def unigram_counts(pages: DataFrame, size: int = VOCABULARY, html_col: str = "html") -> dict[str, int]:
    """Words a-z of all page titles with their counts; the most frequent, at most `size`, are the vocabulary.

    Words of one count are all in or all out, so the edge is found from the
    numbers of words by count, and only the vocabulary itself reaches the driver.
    """
    counts = title_counts(pages, html_col)
    least, held = 1, 0
    for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        held += r["n"]
        if held > size:
            least = r["count"] + 1
            break
    return {r["word"]: r["count"] for r in counts.where(F.col("count") >= least).toLocalIterator()}


def judge_urls(pages: DataFrame, counts: dict[str, int] | DataFrame, rules=RULES, block_at: float = 0.0, id_col: str = "page_id", url_col: str = "url", total: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score for every row.

    words are the segmented words of host and path, score their log-odds of
    block; the verdict is the rule's where one fits and else block for a score
    above block_at. A null url, or one without `://`, has empty host and path
    and is allowed. Repeated rows stay repeated; other columns are ignored; an
    empty table gives an empty result. counts are a dictionary, or a table
    (word, count) whose rows are joined to the URLs that hold the words; `total`
    is the sum of all counts, those not given included.
    """
    table = isinstance(counts, DataFrame)
    if total is None:
        total = (counts.agg(F.sum("count")).first()[0] or 0) if table else sum(counts.values())
    known = Counter(w for p in (*BLOCK_PHRASES, *ALLOW_PHRASES) for w in p.split())
    heavy = max(1, total // 10_000)  # the phrases' words count as fairly frequent words
    phrases = {w: n * heavy for w, n in known.items()}
    whole = total + sum(phrases.values())

    def merged(some: dict[str, int]) -> dict[str, int]:
        return some | {w: some.get(w, 0) + n for w, n in phrases.items()}

    # At most the words of url_word_counts and the phrases'.
    shared = pages.sparkSession.sparkContext.broadcast(merged({} if table else counts))

    def make():
        segmenter, bayes = Segmenter(shared.value, whole), NaiveBayes()

        def work(batch: pa.RecordBatch) -> dict:
            own = batch.column(2).to_pylist() if table else None
            out = {"page_id": batch.column(0), "host": [], "path": [], "rule": [], "verdict": [], "words": [], "score": []}
            for k, url in enumerate(strings(batch.column(1))):
                host, path = parse(url)
                rule = match_rule(host, path, rules)
                used = Segmenter(merged({x["word"]: x["count"] for x in own[k] or ()}), whole) if table else segmenter
                words = used.words(host) + used.words(path)
                score = bayes.score(words)
                verdict = rule[1] if rule else "block" if score > block_at else "allow"
                for name, value in zip(("host", "path", "rule", "verdict", "words", "score"), (host, path, rule and rule[0], verdict, words, score), strict=True):
                    out[name].append(value)
            return out

        return work

    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if table:

        def pieces():
            def work(batch: pa.RecordBatch) -> dict:
                got = [(u, w) for u in set(strings(batch.column(0))) for w in parts_of(u)]
                return {"url": [u for u, _ in got], "word": [w for _, w in got]}

            return work

        held = map_rows(kept.select("url"), pieces, "url string, word string").distinct().join(counts.select("word", "count"), "word")
        held = held.groupBy("url").agg(F.collect_list(F.struct("word", "count")).alias("own"))
        kept = kept.join(held, "url", "left").select("page_id", "url", "own")
    kind = kept.schema["page_id"].dataType.simpleString()
    return map_rows(kept, make, f"page_id {kind}, host string, path string, rule string, verdict string, words array<string>, score double")
