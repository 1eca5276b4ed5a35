"""Array code that the operators run inside tasks: words, shingles and hashes of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The lowest n bytes of a 64-bit word.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pow(n: int) -> list[np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64; only short rows of them are kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    rows = []
    for base in (_MULT, _INVERSE):
        row = np.full(max(n, 1 << 20), base, np.uint64)
        row[0] = 1
        rows.append(np.multiply.accumulate(row))
    if n <= 1 << 21:
        _powers = rows
    return rows


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column in UTF-8; nulls are empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def grouped(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together (or one longer text)."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of the sums of a power series."""
    powers, inverses = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which spans of ``data`` hold the same bytes as those of ``other`` in turn; both of a pair have one size."""
    mine, theirs = (np.ndarray(len(x) + 1, "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (data, other))
    equal = (mine[starts] ^ theirs[begins]) & _LOW_BYTES[np.minimum(sizes, 8)] == 0
    rest = np.flatnonzero(equal & (sizes > 8))
    if len(rest):
        starts, begins, sizes = starts[rest] + 8, begins[rest] + 8, sizes[rest] - 8
        kind = np.int32 if max(len(data), len(other)) < 1 << 31 else np.int64
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum()), dtype=kind)
        differ = data[at + np.repeat((starts - before).astype(kind), sizes)] != other[at + np.repeat((begins - before).astype(kind), sizes)]
        equal[rest] = ~np.logical_or.reduceat(differ, before)
    return equal


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span holds the same bytes as span number ``other``."""
    sizes = ends - starts
    if (sizes != sizes[other]).any():
        return False
    pairs = np.flatnonzero(other != np.arange(len(other)))
    return bool(equal_spans(data, starts[pairs], data, starts[other[pairs]], sizes[pairs]).all())


def distinct_spans(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct span each span of ``data`` (the bytes of ``raw``) is, and the first place of each."""
    codes, distinct = pd.factorize(span_hashes(data, starts, ends) if hashes is None else hashes)
    for _ in range(2):
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if same_bytes(data, starts, ends, first[codes]):
            return codes, first
        # Two spans have one hash: tell them apart by themselves.
        codes, distinct = pd.factorize(np.fromiter((raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), object, len(starts)))
    raise AssertionError("equal bytes differ")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case), and the number of words up to each text's end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    words = span_hashes(_LOWER[data], starts, ends)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, stops)


def shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    for lo, hi in grouped(texts):
        words, stops = word_hashes(texts[lo:hi])
        joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            joined += words[i : i + len(joined)] * U(pow(_MULT, 2 * i + 3, 1 << 64))
        joined = mix(joined)
        begin = 0
        for stop in stops.tolist():
            n = stop - begin
            if n >= width:
                found = np.sort(joined[begin : stop - width + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif n:
                whole = U(n)
                for w in words[begin:stop]:
                    whole = mix(np.array([whole ^ w]))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            begin = stop


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy arrays."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False)))
