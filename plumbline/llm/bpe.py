"""Byte-level BPE encoding and decoding over overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.chunks import CHUNK, OVERLAP, encode_whole

RANKS = "byte_bpe_multi_50k.tiktoken"


def load_encoding(path: str):
    """tiktoken's encoder for a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Digests:
    """Running digests of a text's ids and of the bytes that they decode to."""

    def __init__(self, path: str, keep_ids: bool = False):
        self.encoding, self.keep_ids = load_encoding(path), keep_ids

    def start(self) -> None:
        self.n, self.ids, self.bytes, self.all = 0, hashlib.sha256(), hashlib.sha256(), []

    def add(self, values: list[bytes]) -> None:
        packed = b"".join(values)
        ids = np.frombuffer(packed, "<u4").tolist()
        self.n += len(ids)
        self.ids.update(packed)
        self.bytes.update(self.encoding.decode_bytes(ids))
        if self.keep_ids:
            self.all += ids

    def result(self) -> tuple:
        out = (self.n, self.ids.hexdigest(), self.bytes.hexdigest())
        return (*out, self.all) if self.keep_ids else out

    @staticmethod
    def pack(values: list[bytes]) -> bytes:
        return struct.pack(f"<I{len(values)}I", len(values), *map(len, values)) + b"".join(values)

    @staticmethod
    def unpack(packed: bytes) -> list[bytes]:
        (n,) = struct.unpack_from("<I", packed)
        ends = np.cumsum(np.frombuffer(packed, "<u4", n, 4)).tolist()
        base = 4 + 4 * n
        return [packed[base + a : base + b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_texts(
    docs: DataFrame,
    id_cols: list[str] | None = None,
    text_col: str = "text",
    path: str | None = None,
    keep_ids: bool = False,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """id columns, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, the ids.

    ids are those of the tiktoken library for the rank file, each match of the
    pattern by itself, without special tokens. ids_sha256 covers them as
    little-endian unsigned 32-bit integers, decoded_sha256 the bytes that they
    decode to, which are the text's. Null and empty texts have no tokens;
    repeated rows stay repeated; other columns are ignored; an empty table
    gives an empty result. Very long texts are cut into chunks (see chunks.py).
    """
    path = path or rank_path()

    def make_encoder():
        encoding = load_encoding(path)

        def encode(pieces: list[str]) -> Iterable[bytes]:
            return [np.array(encoding.encode_ordinary(p), "<u4").tobytes() for p in pieces]

        return encode

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return encode_whole(docs, make_encoder, lambda: Digests(path, keep_ids), schema, id_cols or ["doc_id"], text_col, chunk, overlap)
