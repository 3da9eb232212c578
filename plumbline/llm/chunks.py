"""Whole-text encoding in overlapping chunks, spliced where boundaries resynchronise.

Both byte-level pre-tokenisers used here start a new pre-token at a single
space or line feed that stands between two characters that are not white
space: a pre-token may begin with a space but never ends with one before
visible text, and a lone line feed is a pre-token of its own. What follows such
a place depends on nothing before it, so an encoder that starts there
gives the same ids as one that has read the whole text. Those places are the
stable boundaries: a text is the concatenation of the pieces between them.

Texts of at most `chunk` characters are one chunk and are encoded where they
are read. Longer texts are cut into chunks that overlap; the chunks of a text
are dealt to different tasks, each encodes from its first stable boundary on,
and the splice takes over from one chunk to the next at the first boundary of
the later one, provided the earlier chunk has the same boundary inside the
overlap. If any chunk of a text fails that test, the text is done again with a
wider overlap, up to a single chunk over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.texts import map_arrow, map_rows, pieces_of, strings
from plumbline.session import cut

CHUNK = 16384
OVERLAP = 256
CACHE = 300_000
TIGHT = re.compile(r"\s\s|\A\s|\s\Z")
BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")


def split_pieces(text: str) -> list[str]:
    """Pieces between stable boundaries; joined they are the text."""
    if not text:
        return []
    if TIGHT.search(text) is None:  # no runs of white space: every space and line feed is a boundary
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[w if w[0] == "\n" else " " + w for w in rest]]
    return BREAK.split(text)


class Cache(dict):
    """Piece -> its encoding by the library, filled a batch at a time and bounded in size."""

    def __init__(self, encode: Callable[[list[str]], Iterable]):
        super().__init__()
        self.encode = encode

    def add(self, pieces: list[str]) -> None:
        fresh = list({p for p in pieces if p not in self})
        if len(self) + len(fresh) > CACHE:
            self.clear()
            fresh = list(set(pieces))
        if fresh:
            self.update(zip(fresh, self.encode(fresh), strict=True))

    def all(self, pieces: list[str]) -> list:
        self.add(pieces)
        return list(map(self.__getitem__, pieces))


def encode_whole(
    docs: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], Iterable]],
    make_total: Callable[[], object],
    schema: str,
    id_cols: list[str],
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """docs' id columns and the `schema` columns of each whole text's encoding.

    make_encoder() gives a function from pieces to one value per piece.
    make_total() gives an object whose start() begins a text, add(values) takes
    the values of successive pieces and result() ends it with a tuple in the
    order of `schema`. pack(values) and unpack(bytes) turn values to bytes and
    back for the splice. Null texts count as empty. Equal long texts are
    encoded once; rows stay as many as they were.
    """
    if not chunk > 2 * overlap > 0:
        raise ValueError("a chunk must be longer than two overlaps")
    names = [c.split()[0] for c in schema.split(",")]
    types = docs.select(*id_cols).schema
    ids_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = docs.where(F.length(text) <= chunk).select(*id_cols, text.alias("__text"))

    def make_short():
        cache, total = Cache(make_encoder()), make_total()

        def work(batch: pa.RecordBatch) -> dict:
            split = [split_pieces(x) for x in strings(batch.column(batch.num_columns - 1))]
            rows = []
            for pieces in split:
                total.start()
                total.add(cache.all(pieces))
                rows.append(total.result())
            out = {name: batch.column(i) for i, name in enumerate(id_cols)}
            return out | dict(zip(names, [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names], strict=True))

        return work

    done = map_rows(short, make_short, f"{ids_ddl}, {schema}")
    long = docs.where(F.length(text) > chunk).select(*id_cols, F.sha2(text, 256).alias("__sha"), text.alias("__text"))
    results = _long_texts(long.select("__sha", "__text"), make_encoder, make_total, schema, names, chunk, overlap)
    if results is None:
        return done
    rows = long.select(*id_cols, "__sha").join(results, "__sha").select(*id_cols, *names)
    return done.unionByName(rows)


def chunk_rows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(sha, part, parts, start, body): chunks of `chunk` characters plus the overlap, equal texts once."""
    step = chunk - overlap
    n = F.ceil(F.greatest(F.length("__text") - overlap, F.lit(1)) / step).cast("int")
    cuts = texts.select("__sha", "__text", n.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start = (F.col("part") * step).cast("long")
    cuts = cuts.select("__sha", "part", "parts", start.alias("start"), F.substring("__text", (start + 1).cast("int"), F.lit(chunk)).alias("body"))
    return cuts.groupBy("__sha", "part", "parts", "start").agg(F.first("body").alias("body"))


def _long_texts(texts, make_encoder, make_total, schema, names, chunk, overlap) -> DataFrame | None:
    """(__sha, schema columns) of every distinct long text, or None where there are none."""
    found, rest, width, size = None, texts, overlap, chunk
    while True:
        spliced = cut(_splice(_encode_chunks(chunk_rows(rest, size, width), make_encoder, make_total), make_total, schema, names))
        good = spliced.where("ok").drop("ok")
        found = good if found is None else found.unionByName(good)
        failed = spliced.where("not ok").select("__sha")
        if failed.isEmpty():
            return found if not found.isEmpty() else None
        width, size = width * 8, size * 8
        rest = texts.join(failed, "__sha", "left_semi")


PART = "__sha string, part int, parts int, head long, tail_at array<long>, tail_n array<long>, n long, packed binary"


def _encode_chunks(chunks: DataFrame, make_encoder, make_total) -> DataFrame:
    """Encode each chunk from its first stable boundary to its end.

    head: that boundary's place in the text (null: none). tail_at, tail_n: the
    boundaries in the chunk's second half and the pieces before each.
    """

    def make():
        cache, total = Cache(make_encoder()), make_total()

        def work(batch: pa.RecordBatch) -> dict:
            sha, part, parts, start, body = (batch.column(i).to_pylist() for i in range(5))
            heads, ats, ns, counts, packs = [], [], [], [], []
            for k, at, text in zip(part, start, body, strict=True):
                pieces = split_pieces(text)
                place = at
                if k:  # what stands before the first boundary belongs to the chunk before
                    place += len(pieces[0])
                    pieces = pieces[1:]
                    # the edge itself may hide white space before it, so it is no boundary
                heads.append(place if pieces or not k else None)
                here, tail_at, tail_n = place, [], []
                half = at + len(text) // 2
                for i, p in enumerate(pieces):
                    if here >= half:
                        tail_at.append(here)
                        tail_n.append(i)
                    here += len(p)
                ats.append(tail_at)
                ns.append(tail_n)
                counts.append(len(pieces))
                packs.append(total.pack(cache.all(pieces)))
            return dict(zip(("__sha", "part", "parts", "head", "tail_at", "tail_n", "n", "packed"), (sha, part, parts, heads, ats, ns, counts, packs), strict=True))

        return work

    return map_rows(chunks, make, PART)


def _splice(parts: DataFrame, make_total, schema: str, names: list[str]) -> DataFrame:
    """One row per text from its chunks in order: (__sha, ok, schema columns)."""
    ordered = parts.repartition("__sha").sortWithinPartitions("__sha", "part")
    out_schema = f"__sha string, ok boolean, {schema}"
    target = to_arrow_schema(StructType.fromDDL(out_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = make_total()
        held: dict | None = None
        state = {"sha": None, "ok": True}

        def close(rows: list) -> None:
            if state["sha"] is None:
                return
            if held is not None and state["ok"]:
                total.add(total.unpack(held["packed"]))
            rows.append((state["sha"], state["ok"], *(total.result() if state["ok"] else (None,) * len(names))))

        for batch in batches:
            rows: list = []
            for small in pieces_of(batch, 64):
                for row in small.to_pylist():
                    if row["__sha"] != state["sha"]:
                        close(rows)
                        state = {"sha": row["__sha"], "ok": True}
                        held = row
                        total.start()
                        continue
                    if not state["ok"]:
                        continue
                    # Hand over at the later chunk's first boundary, if the earlier one has it too.
                    where = dict(zip(held["tail_at"], held["tail_n"], strict=True)).get(row["head"])
                    if row["head"] is None or where is None:
                        state["ok"] = False
                        continue
                    total.add(total.unpack(held["packed"])[:where])
                    held = row
            if rows:
                yield _batch(rows, target)
        rows = []
        close(rows)
        if rows:
            yield _batch(rows, target)

    return map_arrow(ordered, run, out_schema)


def _batch(rows: list, target: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
