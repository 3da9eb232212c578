"""Arrow batches of the exact set-similarity join: word runs of texts, counts of features, what is kept, comparison of tiles.

A feature is a hash of 64 bits. Forty mixed bits of it are its place: the first
ten name a bucket, the rest its value there. Places serve to leave out, never
to match: equal places of unlike features only let more through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a place, of them those that name its bucket; features that a task counts at once; bytes of text at once.
PLACE, BUCKET, CHUNK, SLICE = 40, 10, 2_000_000, 2_000_000
#: Features of a batch that are worked on at once.
PIECE = 400_000
#: Features are ranked as rare by how many of these numbers of sets they reach.
STEPS = (2, 4, 8, 16, 64, 256, 1024, 4096)
#: Bits of a map for each feature in it, and most bits of the first map and of the others (powers of 2).
SPARE, MOST, MOST_LATER = 8, 29, 27
#: Columns of a dense product at once; words of more bytes are hashed one by one.
COLUMNS, LONG_WORD = 4096, 256

_A, _B, _SEED = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True
#: bytes.split() takes two more for blanks; they become bytes that no UTF-8 has.
_OTHER_BLANKS = bytes.maketrans(b"\x0b\x0c", b"\xf8\xf9")


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def text_keys(texts: pa.Array) -> pa.Array:
    """MD5 of each text's words: equal for texts that differ in blanks alone."""
    split = (t.translate(_OTHER_BLANKS).split() for t in texts.cast(pa.binary()).fill_null(b"").to_pylist())
    return pa.array((hashlib.md5(b"\x01".join(w)).digest() for w in split), pa.binary())


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that each end in a blank, and how many each has."""
    inside = ~_BLANK[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, length = edge[::2], edge[1::2] - edge[::2]
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each on
    h = mixed(length.astype(np.uint64) ^ _SEED)
    some = np.flatnonzero(length <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        some = some[length[some] > at]
        if not len(some):
            break
        x = eight[start[some] + at]
        left = np.minimum(length[some] - at, 8).astype(np.uint64)
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        h[some] = mixed(h[some] ^ x)
    for k in np.flatnonzero(length > LONG_WORD):
        word = data[start[k] : start[k] + length[k]].tobytes()
        h[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    return h, np.diff(np.searchsorted(start, offsets))


def runs(w: np.ndarray, counts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of `gram` words of each text, one after another, and how many each has; fewer words are one run."""
    ends = np.cumsum(counts)
    k = np.where(counts > 0, np.maximum(counts - gram + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), k)
    first = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(ends - counts, k)
    h = np.full(len(text), _SEED, dtype=np.uint64)
    short = np.repeat(counts < gram, k)
    for at in range(gram):
        if short.any():
            in_text = first + at < ends[text]
            h[in_text] = mixed(h[in_text] ^ w[first[in_text] + at])
        else:
            h = mixed(h ^ w[first + at])
    low = 0
    for high in np.cumsum(k).tolist():
        h[low:high].sort()
        low = high
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[fresh].view(np.int64), np.bincount(text[fresh], minlength=len(counts))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int64()))


def text_runs(texts: pa.Array, gram: int) -> pa.Array:
    """The distinct runs of words of each text, as hashes."""
    out, low = [], 0
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SLICE, "right")))
        part = pc.binary_join_element_wise(texts.slice(low, high - low).cast(pa.large_binary()).fill_null(b""), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        out.append(lists(*runs(*word_hashes(data, offsets - offsets[0]), gram)))
        low = high
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The members of lists one after another, without nulls, and the list of each."""
    counts = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    owner, values = np.repeat(np.arange(len(column)), counts), column.flatten()
    if values.null_count:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        owner, values = owner[there], values.drop_null()
    return values.to_numpy(), owner


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PIECE features in `s`, or of one set."""
    for batch in batches:
        size, low = np.cumsum(pc.list_value_length(batch.column("s")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PIECE, "right")))
            yield batch.slice(low, high - low)
            low = high


def truth(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


def places(features: np.ndarray) -> np.ndarray:
    return mixed(features.view(np.uint64) ^ _SEED) >> np.uint64(64 - PLACE)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers under 2^32 as their differences, in as few bytes as the largest takes."""
    gaps = np.diff(values.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    cut = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    gaps = np.zeros((len(cut), 4), dtype=np.uint8)
    gaps[:, : blob[0]] = cut
    return np.cumsum(gaps.reshape(-1).view("<u4"), dtype=np.uint32)


TALLY = "bucket int, new boolean, places binary, many binary, times binary"


def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets (s, new): the places of their features by bucket and side, and how many sets hold those that several do."""
    mask, held, size = np.uint64((1 << (PLACE - BUCKET)) - 1), ([], []), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for side in (0, 1):
            if not held[side]:
                continue
            found, times = np.unique(np.concatenate(held[side]), return_counts=True)
            held[side].clear()
            cuts = np.searchsorted(found, np.arange((1 << BUCKET) + 1, dtype=np.uint64) << np.uint64(PLACE - BUCKET))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            parts = [(found[cuts[b] : cuts[b + 1]] & mask, times[cuts[b] : cuts[b + 1]]) for b in full]
            many = [np.flatnonzero(t > 1) for _, t in parts]
            columns = [full, [bool(side)] * len(full), [packed(p) for p, _ in parts], [m.astype("<u4").tobytes() for m in many], [t[m].astype("<u4").tobytes() for (_, t), m in zip(parts, many, strict=True)]]
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "new", "places", "many", "times"])

    for batch in pieces(batches):
        values, owner = flat(batch.column("s"))
        at, new = places(values), truth(batch.column("new"))[owner]
        for side in (0, 1):
            if len(part := at[new == bool(side)]):
                held[side].append(part)
        size += len(at)
        if size >= CHUNK:
            yield from flush()
            size = 0
    yield from flush()


LEVELS = "bucket int, level int, n long, places binary"


def levels(rows: pa.Table, apart: bool) -> pa.Table:
    """Of one bucket's tallies: the places that two sets hold (apart: one of each side), by each of STEPS that they reach."""
    keys = []
    for r in rows.to_pylist():
        low = unpacked(r["places"]).astype(np.uint64)
        times = np.ones(len(low), dtype=np.uint64)
        times[np.frombuffer(r["many"], "<u4")] = np.frombuffer(r["times"], "<u4")
        keys.append((low << np.uint64(32)) | np.uint64(int(r["new"]) << 31) | times)
    key = np.concatenate(keys)
    key.sort()
    value = (key >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    side, times = (key >> np.uint64(31)) & np.uint64(1), key & np.uint64(0x7FFFFFFF)
    total = np.add.reduceat(times, starts)
    held = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts) if apart else total > 1
    value, total = value[starts][held], total[held]
    parts = [value[total >= np.uint64(step)] for step in STEPS]
    there = [k for k, p in enumerate(parts) if len(p)]
    bucket = rows.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([bucket] * len(there), pa.int32()), "level": pa.array(there, pa.int32()), "n": pa.array([len(parts[k]) for k in there], pa.int64()), "places": pa.array([packed(parts[k]) for k in there], pa.binary())})


def map_bits(n: int, level: int) -> int:
    """Bits of a map (as a power of 2) for n features."""
    return min(max(int(n * SPARE - 1).bit_length(), BUCKET + 3), MOST_LATER if level else MOST)


def to_bits(bits: dict[int, int]):
    """(level, bucket, bits): the part of each level's map that a bucket fills."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                one = np.zeros(1 << (bits[r["level"]] - BUCKET), dtype=bool)
                one[unpacked(r["places"]) >> np.uint32(PLACE - bits[r["level"]])] = True
                yield pa.RecordBatch.from_arrays([pa.array([r["level"]], pa.int32()), pa.array([r["bucket"]], pa.int32()), pa.array([np.packbits(one).tobytes()], pa.binary())], names=["level", "bucket", "bits"])

    return run


def rarity(values: np.ndarray, maps: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """0 for features that one set alone holds, else how many of the maps have the feature: fewer are rarer."""
    out, at, some = np.zeros(len(values), dtype=np.int8), places(values), np.arange(len(values))
    for bits, held in maps:
        place = at >> np.uint64(PLACE - bits)
        hit = (held[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1
        some, at = some[hit], at[hit]
        out[some] += 1
    return out


def keep(least: float, maps):
    """Of sets (id, n, new, s): those whose features, rare ones first, can be common enough, and how many are the prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, owner = flat(batch.column("s"))
            rank = rarity(values, maps.value)
            n = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.bincount(owner[rank > 0], minlength=len(n))
            first = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
            stay = (held > 0) & (n - held < first)
            some = np.flatnonzero((rank > 0) & stay[owner])
            some = some[np.lexsort((values[some], rank[some], owner[some]))]
            prefix = np.minimum(first - (n - held), held)[stay]
            ids, new = (batch.column(c).filter(pa.array(stay)) for c in ("id", "new"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[stay], pa.int64()), new, pa.array(prefix, pa.int32()), lists(values[some], held[stay])], names=["id", "n", "new", "p", "held"])

    return run


def common(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members each left set shares with each right one."""
    found, code, times = np.unique(values, return_inverse=True, return_counts=True)
    several = times > 1
    column, on = np.cumsum(several) - 1, several[code]
    column, row = column[code[on]], owner[on]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for low in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        dense = np.zeros((int(owner[-1]) + 1, min(COLUMNS, int(several.sum()) - low)), dtype=np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        out += (dense[left] @ dense[right].T).astype(np.int64)
    return out


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of links that join what the links before left apart."""
    parent: dict = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            parent[b] = a
            out.append(k)
    return np.array(out, dtype=np.int64)


def compare(least: float, apart: bool, links: bool):
    """Of sets by pairs of tiles (t, u, right, id, n, new, held), in order: the pairs of a left and a right one that are similar enough.

    With t = u all are left. apart: pairs of an old and a new set alone. links:
    a forest of these pairs.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        rows = rows.combine_chunks().to_batches()[0]
        values, owner = flat(rows.column("held"))
        right, n, new = truth(rows.column("right")), rows.column("n").to_numpy(), truth(rows.column("new"))
        one = rows.column("t")[0] == rows.column("u")[0]
        a, b = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(~right), np.flatnonzero(right))
        if not len(a) or not len(b):
            return
        inter = common(values, owner, a, b)
        fit = (1 + least) * inter >= least * (n[a][:, None] + n[b][None, :]) - 1e-6
        if one:
            fit = np.triu(fit, 1)
        if apart:
            fit &= new[a][:, None] != new[b][None, :]
        i, j = np.nonzero(fit)
        x, y, inter = a[i], b[j], inter[i, j]
        if links and len(x):
            exact = inter / (n[x] + n[y] - inter) >= least  # as the join's last filter has it
            x, y, inter = x[exact], y[exact], inter[exact]
            some = forest(x, y)
            x, y, inter = x[some], y[some], inter[some]
        ids = rows.column("id")
        if len(x):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(inter, pa.int64()), pa.array(n[x] + n[y] - inter, pa.int64()), pa.array(new[x])], names=["x", "y", "inter", "uni", "new"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, u = batch.column("t").to_numpy(), batch.column("u").to_numpy()
            cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (u[1:] != u[:-1])) + 1).tolist(), len(t)]
            if rest and (rest[-1].column("t")[0].as_py(), rest[-1].column("u")[0].as_py()) != (t[0], u[0]):
                yield from pairs(pa.Table.from_batches(rest))
                rest = []
            for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield from pairs(pa.Table.from_batches([*rest, batch.slice(low, high - low)]))
                rest = []
            rest.append(batch.slice(cuts[-2]))
        if rest:
            yield from pairs(pa.Table.from_batches(rest))

    return run
