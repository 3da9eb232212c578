"""Token counts with overlap resynchronisation for huge documents."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import CHUNK, OVERLAP, encode_whole

VOCABULARY = "byte_bpe_50k.json"


class Counts:
    """Running sums of bytes and tokens over a text's pieces."""

    def start(self) -> None:
        self.bytes, self.n = 0, 0

    def add(self, values: list[int]) -> None:
        # A value holds a piece's bytes above its tokens, 32 bits each.
        total = np.array(values, np.int64)
        self.bytes += int((total >> 32).sum())
        self.n += int((total & 0xFFFFFFFF).sum())

    def result(self) -> tuple:
        return self.bytes, self.n

    @staticmethod
    def pack(values: list[int]) -> bytes:
        return np.array(values, "<i8").tobytes()

    @staticmethod
    def unpack(packed: bytes) -> list[int]:
        return np.frombuffer(packed, "<i8").tolist()


def load_tokenizer(path: str):
    """The library's tokenizer, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_tokens(
    docs: DataFrame,
    limit: int = 1024,
    id_cols: list[str] | None = None,
    text_col: str = "text",
    path: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """id columns, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Counts are those of the tokenizers library without added special tokens;
    special strings inside a text count as the library's default has it, one
    token each (they hold no white space, so no boundary falls inside one).
    Null and empty texts have zero bytes and tokens; repeated rows stay
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)

    def make_encoder():
        tokenizer = load_tokenizer(path)

        def encode(pieces: list[str]) -> Iterable[int]:
            for start in range(0, len(pieces), 4096):
                part = pieces[start : start + 4096]
                for p, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    yield len(p.encode()) << 32 | len(e)

        return encode

    out = encode_whole(docs, make_encoder, Counts, "n_bytes long, n_tokens long", id_cols or ["doc_id"], text_col, chunk, overlap)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
