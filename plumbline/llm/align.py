"""Cross-tokenizer alignment: Python tokenises, Spark's array functions do the rest.

A text is read by two tokenizers, A (byte-level BPE over a leading space and
the text) and B (sentencepiece BPE, which adds that space itself). Both start
anew at a space between two characters that are not white space: A's
pre-tokens never hold white space after anything else, and no entry of B's
vocabulary has its space sign after another character (checked when the
vocabulary is loaded; whole texts are encoded otherwise). The pieces between
those places are the same for both, so a piece's tokens, byte ends, groups and
links are found once for all its places in a unit, which is a run of texts of
about UNIT characters.

Groups and links come from array functions alone. The byte ends of A and B,
each tagged with its side and index, are sorted together. At place i of the
sorted ends an end of A with index p has i - p ends of B before it, so token
i - p of B covers its last byte; likewise for B, where an end that A shares is
no second link. Every overlap of two tokens is one interval and so ends at
exactly one distinct end: the links are the distinct ends, n_a + n_b - n_groups
of them. The shared ends (array_intersect) close the groups.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.chunks import TIGHT
from plumbline.llm.texts import map_arrow, pieces_of, strings
from plumbline.session import written

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
UNIT = 1 << 21
CACHE = 100_000
#: Pair counts are broadcast up to this many pairs, and shuffled beyond.
MOST_PAIRS = 1 << 20
BREAK = re.compile(r"(?<=\S)(?= \S)")
PIECE = "struct<a: array<int>, b: array<int>, shape: int>"
SHAPE = "struct<ae: array<int>, be: array<int>>"
SIGN = "▁"


def split_words(text: str) -> list[str]:
    """Pieces of a text that is not empty, without the space before each; the first has none of its own."""
    if TIGHT.search(text) is None:
        return text.split(" ")
    first, *rest = BREAK.split(text)
    return [first, *[w[1:] for w in rest]]


class ByteBpe:
    """Side A: ids and byte lengths for a space and a piece."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(printable, printable, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        byte_of = {chr(c): b for b, c in shown.items()}
        self.entry = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            if all(c in byte_of for c in token):
                self.entry[i] = bytes(byte_of[c] for c in token)
        self.length = np.array([len(x) for x in self.entry], np.int64)
        self.path, self.model = path, None
        # Where each merge makes the next entry, ids are ranks and the faster library gives the same tokens.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        first = min((model["vocab"][a + b] for a, b in merges), default=0)
        self.ranked = None
        if all(model["vocab"][a + b] == first + k for k, (a, b) in enumerate(merges)):
            ranks = {v: k for k, v in enumerate(self.entry[: first + len(merges)])}
            if len(ranks) == first + len(merges):
                self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        """The tokenizers library's reading of the file, loaded where it is needed."""
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path)
            self.model.no_truncation()
            self.model.no_padding()
            self.model.encode_special_tokens = True
        return self.model

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            return np.array(self.ranked.encode_ordinary(text), np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of tokens of each) of a space and each piece; pieces that end visibly are read as one text."""
        text = " " + " ".join(pieces)
        if TIGHT.search(text, 1) is None and text[-1:] != " ":
            ids = self.ids(text)
            ends = np.cumsum(self.length[ids])
            stops = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in pieces), np.int64, len(pieces)))
            cuts = np.searchsorted(ends, stops)
            if len(ids) and ends[-1] == stops[-1] and (ends[cuts] == stops).all():
                return ids, np.diff(cuts + 1, prepend=0)
        each = [self.ids(" " + w) for w in pieces]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


class PieceBpe:
    """Side B: ids and byte lengths for a piece, before which the library puts a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.entry = []
        for i, name in enumerate(names):
            if self.library.is_byte(i):
                self.entry.append(bytes([int(name[3:5], 16)]))
            else:
                self.entry.append(name.replace(SIGN, " ").encode())
        self.length = np.array([len(x) for x in self.entry], np.int64)
        self.cuts = not any(re.search(f"[^{SIGN}]{SIGN}", x) for x in names)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self.library.encode(pieces, num_threads=1)
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), np.int64, int(n.sum())), n


class Tokens:
    """Ids and byte ends of many pieces on one side, end to end."""

    def __init__(self):
        self.ids, self.ends, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, ends: np.ndarray, n: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, ends.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])

    def lists(self, wanted: np.ndarray) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """Arrow lists of ids and of ends for the wanted pieces, and their numbers of tokens."""
        first, n = self.starts[wanted], self.starts[wanted + 1] - self.starts[wanted]
        offsets = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], n)
        offsets = pa.array(offsets, pa.int32())
        return *(pa.ListArray.from_arrays(offsets, pa.array(x[at])) for x in (self.ids, self.ends)), n


class Pieces:
    """Tokens of pieces on both sides, kept between units up to a bound; pieces whose bytes differ have none."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.sides, self.bad = (Tokens(), Tokens()), np.zeros(0, bool)
        # shape: number of a piece's pair of end arrays; model: a piece that has the shape
        self.shapes: dict[bytes, int] = {}
        self.shape, self.model = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def need(self, wanted: set[str]) -> None:
        fresh = [w for w in wanted if w not in self.number]
        if len(self.number) + len(fresh) > CACHE:
            self.clear()
            fresh = list(wanted)
        for start in range(0, len(fresh), 16384):
            part = fresh[start : start + 16384]
            sizes = np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part))
            bad = np.zeros(len(part), bool)
            both = []
            for side in (self.a, self.b):
                ids, n = side.encode(part)
                ends = np.cumsum(side.length[ids])
                stops = np.concatenate([[0], np.cumsum(n)])
                byte_stops = np.concatenate([[0], ends])[stops]
                made = b"".join(map(side.entry.__getitem__, ids.tolist()))
                if made != (" " + " ".join(part)).encode() or (np.diff(byte_stops) != sizes).any():
                    for k, w in enumerate(part):
                        bad[k] |= made[byte_stops[k] : byte_stops[k + 1]] != b" " + w.encode()
                both.append((ids, ends - np.repeat(byte_stops[:-1], n), n))
            for (ids, ends, n), tokens in zip(both, self.sides, strict=True):
                keep = np.repeat(~bad, n)
                tokens.add(ids[keep], ends[keep], np.where(bad, 0, n))
            self.bad = np.concatenate([self.bad, bad])
            self._add_shapes(len(self.number), len(part))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))

    def _add_shapes(self, first: int, n: int) -> None:
        (a, b), stop = self.sides, first + n
        packed = [(x.ends.tobytes(), (x.starts[first : stop + 1] * 4).tolist()) for x in (a, b)]
        keys = [packed[0][0][i:j] + b"/" + packed[1][0][k:m] for (i, j), (k, m) in zip(*(itertools.pairwise(s) for _, s in packed), strict=True)]
        known, shape, model = self.shapes, [], []
        for k, key in enumerate(keys, first):
            if (number := known.setdefault(key, len(known))) == len(self.model) + len(model):
                model.append(k)
            shape.append(number)
        self.shape = np.concatenate([self.shape, np.array(shape, np.int64)])
        self.model = np.concatenate([self.model, np.array(model, np.int64)])


@functools.cache
def tokenizers(a_path: str, b_path: str) -> tuple[ByteBpe, PieceBpe]:
    """Both sides, loaded once a worker."""
    return ByteBpe(a_path), PieceBpe(b_path)


def tokenised(docs: DataFrame, id_cols: list[str], text_col: str, a_path: str, b_path: str, unit: int = UNIT) -> DataFrame:
    """A row for each unit: `docs` (array of id columns, n_a, n_b and the numbers of the text's pieces) and `pieces`."""
    types = docs.select(*id_cols).schema
    ids_ddl = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in types)
    schema = f"docs array<struct<{ids_ddl}, n_a: bigint, n_b: bigint, pieces: array<int>>>, pieces array<{PIECE}>, shapes array<{SHAPE}>"
    target = to_arrow_schema(StructType.fromDDL(schema))
    doc_type = target.field("docs").type.value_type

    def run(batches):
        a, b = tokenizers(a_path, b_path)
        cache = Pieces(a, b)
        ids: list[list] = [[] for _ in id_cols]
        split: list[list[str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cache.need(set().union(*split))
            at = np.fromiter(map(cache.number.__getitem__, itertools.chain.from_iterable(split)), np.int64)
            n = np.fromiter(map(len, split), np.int64, len(split))
            row = np.repeat(np.arange(len(split)), n)
            spoilt = np.bincount(row, cache.bad[at], len(split)) > 0
            at, n = at[~spoilt[row]], np.where(spoilt, 0, n)
            row = np.repeat(np.arange(len(split)), n)
            wanted, local = np.unique(at, return_inverse=True)
            (a_ids, _, n_a), (b_ids, _, n_b) = (side.lists(wanted) for side in cache.sides)
            which, shape = np.unique(cache.shape[wanted], return_inverse=True)
            (_, a_ends, _), (_, b_ends, _) = (side.lists(cache.model[which]) for side in cache.sides)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(local.astype(np.int32)))
            sums = [pa.array(np.bincount(row, x[local], len(split)).astype(np.int64)) for x in (n_a, n_b)]
            columns = [pa.array(c, t.type) for c, t in zip(ids, doc_type, strict=False)]
            made = ([*columns, *sums, places], [a_ids, b_ids, pa.array(shape.astype(np.int32))], [a_ends, b_ends])
            rows = [pa.StructArray.from_arrays(x, fields=list(f.type.value_type)) for x, f in zip(made, target, strict=True)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in rows], schema=target)

        for batch in batches:
            for part in pieces_of(batch, 64):
                texts = strings(part.column(part.num_columns - 1))
                for k in range(len(id_cols)):
                    ids[k] += part.column(k).to_pylist()
                split += [([] if not t else split_words(t) if b.cuts else [t]) for t in texts]
                size += sum(map(len, texts))
                if size >= unit:
                    yield flush()
                    ids, split, size = [[] for _ in id_cols], [], 0
        if split:
            yield flush()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return map_arrow(docs.select(*id_cols, text.alias("__text")), run, schema)


LOW = (1 << 31) - 1
SIDES, GROUPS = -1, -2  # between the sides of a group, before a group


def tagged_ends(shape: Column) -> Column:
    """Byte ends of both sides in order, A before B: end, side and index in one long."""
    side = lambda bit: lambda e, i: F.shiftleft(e.cast("long"), 32) + (i + F.lit(bit))
    return F.sort_array(F.concat(F.transform(shape["ae"], side(0)), F.transform(shape["be"], side(LOW + 1))))


def form_of(shape: Column) -> Column:
    """What a pair of end arrays gives: the links and the order of tokens by groups.

    A link holds an index into A, one into B and a bit for links that end a group, in one long. The order has numbers into the ids of A, the ids of B and the two marks, joined.
    """

    def parts(ends: Column) -> Column:
        def link(v: Column, i: Column) -> Column:
            index = v.bitwiseAND(F.lit(LOW))
            same = lambda k: F.shiftright(F.get(ends, k), 32) == F.shiftright(v, 32)
            of_a = F.shiftleft(index, 32) + F.shiftleft(i - index, 1) + F.when(same(i + 1), 1).otherwise(0)
            of_b = F.when(same(i - 1), F.lit(None)).otherwise(F.shiftleft(i - index, 32) + F.shiftleft(index, 1))
            return F.when(v.bitwiseAND(F.lit(LOW + 1)) == 0, of_a).otherwise(of_b)

        return F.array_compact(F.transform(ends, link))

    def split(links: Column) -> Column:
        """links with those that end a group, where a token of either side ends."""
        return F.struct(links.alias("links"), F.filter(links, lambda x: x.bitwiseAND(F.lit(1)) == 1).alias("lasts"))

    def ordered(x: Column) -> Column:
        n_a, n_b = F.size(shape["ae"]), F.size(shape["be"])

        def group(t: Column, g: Column) -> Column:
            before = F.get(x["lasts"], g - 1)
            first_a, first_b = F.coalesce(_a_of(before) + 1, F.lit(0)), F.coalesce(_b_of(before) + 1, F.lit(0))
            return F.concat(F.array(n_a + n_b + 1), F.sequence(first_a, _a_of(t)), F.array(n_a + n_b), F.sequence(n_a + first_b, n_a + _b_of(t)))

        return F.struct(x["links"].alias("links"), F.flatten(F.transform(x["lasts"], group)).alias("order"))

    return F.transform(F.transform(F.transform(F.array(tagged_ends(shape)), parts), split), ordered)[0]


def _a_of(link: Column) -> Column:
    return F.shiftright(link, 32).cast("int")


def _b_of(link: Column) -> Column:
    return F.shiftright(link.bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")


def piece_of(p: Column, forms: Column) -> Column:
    """A piece's links, as pairs of ids in one long, and its groups written out."""
    form = F.get(forms, p["shape"])
    links = F.transform(form["links"], lambda x: F.shiftleft(F.get(p["a"], _a_of(x)).cast("long"), 32) + F.get(p["b"], _b_of(x)))
    pool = F.array(F.concat(p["a"], p["b"], F.array(F.lit(SIDES), F.lit(GROUPS))))
    order = F.transform(pool, lambda c: F.transform(form["order"], lambda k: F.get(c, k)))[0]
    joined = F.array_join(order.cast("array<string>"), ",")
    text = F.replace(F.replace(F.substring(joined, len(str(GROUPS)) + 2, LOW), F.lit(f",{SIDES},"), F.lit("|")), F.lit(f",{GROUPS},"), F.lit(";"))
    return F.struct(links.alias("links"), text.alias("groups"))


def aligned(units: DataFrame, id_cols: list[str]) -> DataFrame:
    """id columns, n_a, n_b, n_groups, groups_sha256 and links (array of id pairs) of each text of the units."""
    forms = units.withColumn("forms", F.transform("shapes", form_of))
    made = forms.withColumn("made", F.transform("pieces", lambda p: piece_of(p, F.col("forms"))))

    # Only the look-up, one for each place of a piece, stays inside the unit's row; what follows works on a text's own row.
    def one(d: Column) -> Column:
        found = F.transform(d["pieces"], lambda k: F.get(F.col("made"), k)).alias("found")
        return F.struct(*(d[c].alias(c) for c in id_cols), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), found)

    rows = made.select(F.explode(F.transform("docs", one)).alias("d")).select("d.*")
    rows = rows.select(*id_cols, "n_a", "n_b", F.col("found.groups").alias("groups"), F.flatten("found.links").alias("links"))
    return rows.select(
        *id_cols,
        "n_a",
        "n_b",
        (F.col("n_a") + F.col("n_b") - F.size("links")).alias("n_groups"),
        F.when(F.size("groups") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("").alias("groups_sha256"),
        "links",
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of a table with a column `pair`: its number of rows, and whether no pair with the same B has more."""
    counts = written(links.groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("n").alias("most"))
    # One row for each id of B's vocabulary at most.
    joined = counts.join(F.broadcast(most), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)) == F.col("b"))
    return written(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align(
    docs: DataFrame,
    id_cols: list[str] | None = None,
    text_col: str = "text",
    a_path: str | None = None,
    b_path: str | None = None,
    unit: int = UNIT,
    most_pairs: int = MOST_PAIRS,
    keep_links: bool = False,
) -> DataFrame:
    """id columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; with keep_links also the links.

    A reads a space and the text, B the text before which it puts a space; the
    byte offsets at which tokens of both end cut them into groups, and a link
    is a pair of tokens whose byte ranges overlap. An id pair's count is its
    number of links in the whole table; n_best counts the links whose count is
    the highest of their B id, ties included; count_sum adds up the counts.
    groups_sha256 is of `a1,a2|b1;a3|b2` in decimal ids.

    Null and empty texts, and texts whose joined bytes of A or B differ from a
    space and the text, have no tokens: zeros and an empty digest. Repeated
    rows stay and count each; other columns are ignored; an empty table gives
    an empty result. Special strings in a text are plain text. A text is one
    row throughout, its arrays in proportion to its length.
    """
    import public_tokenizers

    id_cols = id_cols or ["doc_id"]
    units = tokenised(docs, id_cols, text_col, a_path or public_tokenizers.path(BYTE_BPE), b_path or public_tokenizers.path(PIECE_BPE), unit)
    rows = written(aligned(units, id_cols).withColumn("__row", F.monotonically_increasing_id()))
    links = rows.select("__row", F.explode("links").alias("pair"))
    pairs = pair_counts(links)
    n = F.col("n")
    if pairs.count() <= most_pairs:  # a sum for each row, in the task that reads it
        valued = links.join(F.broadcast(pairs), "pair").select("__row", n.alias("count_sum"), F.col("best").cast("long").alias("n_best"))
    else:  # a text's equal pairs are one row, and a frequent pair is dealt by the row's salt
        folded = links.groupBy("__row", "pair").agg(F.count("*").alias("m")).withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(16).cast("long")))
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        valued = folded.join(salted, ["pair", "salt"]).select("__row", (n * F.col("m")).alias("count_sum"), F.when(F.col("best"), F.col("m")).otherwise(0).alias("n_best"))
    sums = valued.groupBy("__row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.select("__row", *id_cols, "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256", *["links"] * keep_links)
    kept = out.join(sums, "__row", "left").na.fill(0, ["count_sum", "n_best"])
    return kept.select(*id_cols, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["links"] * keep_links)
