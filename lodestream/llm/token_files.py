"""Token-id shards compressed by Re-Pair grammars, with random access to every document and to ids inside it.

A shard holds documents in ascending doc_id order. Frequent pairs of neighbouring symbols are replaced by nonterminals, round
by round and the most frequent ones first, until no pair occurs often enough to pay for its rule. Rules, how many ids each nonterminal
stands for, and each document's place are stored. A document is decoded without touching the others, and ids from one
place to another inside it without expanding what is before or after: the expansion lengths tell which symbols those are.
No rule reaches over a document's end.

File format (little endian): magic ``LSRP0002``; nine uint64: documents, documents without a doc_id (they come first), ids, letters
(distinct ids), rules, symbols, bits of a letter, of a symbol and of an expansion length; int64 doc_ids; uint32 ends of documents in
symbols; uint32 ends in ids; then packed to their bits, each filled up to whole bytes: letters, rules (left and right by turns),
expansion lengths, symbols. Symbols below the number of letters stand for letters, those above for rules.

Files are written under names of their own by each task attempt; only those that a finished task reports are listed in
the manifest, so a lost executor or a second attempt leaves nothing behind that is read.

Defined cases: null and empty texts are the end id alone; a document longer than a shard is a shard of its own; rows that
repeat a doc_id are documents of their own, side by side in the order of a hash of their texts; rows without a doc_id come first;
of pairs with equal counts the one that occurs first is numbered first; an empty table gives no files and an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import durable, in_tasks, new_path, release
from ._text import text_bytes
from ._tokens import encoder

MAGIC = b"LSRP0002"
#: Ids of a shard at least before a new one is begun, and replacements that pay for a rule: it takes two symbols and a length, and
#: more rules make all symbols wider. Files are larger with 4 and with 16.
SHARD_IDS, LEAST = 1 << 20, 8
_SLOTS = 18
_MANIFEST = "part int, shard int, path string, documents long, ids long, bytes long"


def pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers below ``1 << bits`` in so many bits each; eight of them fill whole bytes."""
    rows = np.zeros((-(-len(values) // 8), 8), np.uint64)
    rows.ravel()[: len(values)] = values
    out = np.zeros((len(rows), bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        shifted = rows[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (shifted >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def packed_size(many: int, bits: int) -> int:
    return -(-many // 8) * bits


def unpack(raw: bytes, bits: int, first: int, many: int) -> np.ndarray:
    """``many`` numbers from ``raw``, which begins with the byte that holds the first bit of number ``first``."""
    data = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    at = np.arange(first, first + many) * bits - first * bits // 8 * 8
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def re_pair(symbols: np.ndarray, letters: int, end: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) of a sequence of numbers below ``letters``; rule i is symbol ``letters + i``.

    Each round replaces the pairs that occur at least a thirty-second as often as the most frequent one, and ``least`` times. Of two
    occurrences that share a symbol that of the more frequent pair goes first; among equals those at even places of a run. A pair
    that is left with fewer than ``least`` replacements waits for a later round.
    """
    now, known, rules, waits = symbols.astype(np.uint32), letters, [], False
    # Pairs that are too rare stay so, as only new symbols make new pairs: a place is looked at again when a symbol there is new.
    live = np.ones(len(now), bool)
    live[:-1] &= (now[:-1] != end) & (now[1:] != end)
    live[-1:] = False
    while True:
        at = np.flatnonzero(live)
        left, right = now[at], now[at + 1]
        slots = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - _SLOTS)
        held = np.bincount(slots, minlength=1 << _SLOTS).astype(np.int32)
        size = held[slots]
        live[at[size < least]] = False
        # A pair's places are all in one slot, so the most frequent pair is no rarer than that of the fullest slot, and slots with
        # less than a round's limit hold none of its pairs.
        full = slots == held.argmax()
        most = np.unique(left[full].astype(np.uint64) << np.uint64(32) | right[full], return_counts=True)[1].max(initial=0)
        may = size >= (least if waits else max(least, int(most) // 32))
        at = at[may]
        kind, half = (np.uint32, 16) if known <= 1 << 16 else (np.uint64, 32)
        codes, pairs = pd.factorize(left[may].astype(kind) << kind(half) | right[may])
        counts = np.bincount(codes, minlength=1)
        live[at[counts[codes] < least]] = False
        limit = least if waits else max(least, int(counts.max()) // 32)
        if counts.max() < least:
            break
        keep = counts[codes] >= limit
        at, codes = at[keep], codes[keep]
        rank = counts[codes] << 1
        run = np.cumsum(np.r_[True, np.diff(at) > 1])
        head = np.r_[True, run[1:] != run[:-1]]
        rank += (np.arange(len(at)) - np.flatnonzero(head)[run - 1]) & 1 == 0
        wins = np.ones(len(at), bool)
        wins[1:] &= head[1:] | (rank[1:] > rank[:-1])
        wins[:-1] &= head[1:] | (rank[:-1] > rank[1:])
        at, codes = at[wins], codes[wins]
        paying = np.bincount(codes, minlength=len(pairs)) >= least
        if not paying.any():
            if limit == least:
                break
            waits = True  # one round of all pairs before giving up
            continue
        waits = False
        number = known + np.cumsum(paying) - 1
        won = paying[codes]
        at, codes = at[won], codes[won]
        rules.append(np.stack([pairs[paying] >> kind(half), pairs[paying] & kind((1 << half) - 1)], 1).astype(np.uint32))
        now[at] = number[codes]
        stay = np.ones(len(now), bool)
        stay[at + 1] = False
        state = live.view(np.uint8)
        state[at] |= 2
        stay = np.flatnonzero(stay)
        now, state, known = now[stay], state[stay], known + int(paying.sum())
        live, fresh = state & 1 != 0, state > 1
        fresh[:-1] |= fresh[1:]
        live |= fresh
        live[:-1] &= (now[:-1] != end) & (now[1:] != end)
        live[-1:] = False
    return now, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, letters: int) -> np.ndarray:
    """How many ids each nonterminal stands for; rules only refer to earlier ones."""
    lengths = np.zeros(len(rules), np.int64)
    open_ = np.arange(len(rules))
    while len(open_):
        parts = [np.where(rules[open_, i] < letters, 1, lengths[np.maximum(rules[open_, i].astype(np.int64) - letters, 0)]) for i in (0, 1)]
        ready = (parts[0] > 0) & (parts[1] > 0)
        lengths[open_[ready]] = (parts[0] + parts[1])[ready]
        open_ = open_[~ready]
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, letters: int) -> np.ndarray:
    """The letters that symbols stand for."""
    now = symbols.astype(np.int64)
    while True:
        inner = now >= letters
        if not inner.any():
            return now
        stops = np.cumsum(1 + inner)
        out = np.empty(stops[-1], np.int64)
        out[stops[~inner] - 1] = now[~inner]
        rule = rules[now[inner] - letters]
        out[stops[inner] - 2], out[stops[inner] - 1] = rule[:, 0], rule[:, 1]
        now = out


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_shard(path: str, doc_ids: np.ndarray, id_ends: np.ndarray, ids: np.ndarray, end_id: int, without_id: int = 0) -> int:
    """Write a shard; the first ``without_id`` documents have no doc_id. Returns the file's size."""
    letters = np.flatnonzero(np.bincount(ids, minlength=1))
    number = np.zeros(int(letters.max(initial=0)) + 1, np.uint32)
    number[letters] = np.arange(len(letters))
    end = int(number[end_id]) if end_id < len(number) and end_id in letters else -1
    symbols, rules = re_pair(number[ids], len(letters), end)
    lengths = expansion_lengths(rules, len(letters))
    ends = np.searchsorted(np.cumsum(np.concatenate([np.ones(len(letters), np.int64), lengths])[symbols]), id_ends) + 1
    bits = [max(1, int(x).bit_length()) for x in (letters.max(initial=0), len(letters) + len(rules), lengths.max(initial=0))]
    head = np.array([len(doc_ids), without_id, len(ids), len(letters), len(rules), len(symbols), *bits], "<u8")
    parts = [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<u4").tobytes(), id_ends.astype("<u4").tobytes()]
    parts += [pack(letters, bits[0]), pack(rules.ravel(), bits[1]), pack(lengths, bits[2]), pack(symbols, bits[1])]
    store, name = _store(path)
    with store.open_output_stream(name) as out:
        for part in parts:
            out.write(part)
    return sum(map(len, parts))


@dataclass
class Shard:
    """A shard's tables; documents are decoded on demand."""

    path: str

    def __post_init__(self) -> None:
        store, name = _store(self.path)
        self._file = store.open_input_file(name)
        if self._file.read(8) != MAGIC:
            raise ValueError(f"{self.path} is not a token shard")
        docs, self.without_id, self.n_ids, many, n, _, *bits = np.frombuffer(self._file.read(72), "<u8").astype(np.int64).tolist()
        self.doc_ids = np.frombuffer(self._file.read(8 * docs), "<i8")
        self.ends, self.id_ends = (np.concatenate(([0], np.frombuffer(self._file.read(4 * docs), "<u4").astype(np.int64))) for _ in range(2))
        self.letters = unpack(self._file.read(packed_size(many, bits[0])), bits[0], 0, many)
        self.rules = unpack(self._file.read(packed_size(2 * n, bits[1])), bits[1], 0, 2 * n).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(many, np.int64), unpack(self._file.read(packed_size(n, bits[2])), bits[2], 0, n)])
        self._bits, self._at = bits[1], self._file.tell()

    def _symbols(self, begin: int, stop: int) -> np.ndarray:
        first = begin * self._bits // 8
        self._file.seek(self._at + first)
        return unpack(self._file.read(-(-stop * self._bits // 8) - first), self._bits, begin, stop - begin)

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that all symbols stand for, in a row, and where each symbol's begin.

        A round's rules occur side by side and ``LEAST`` times each, so they are no more ids for each round than that part of the shard's.
        """
        spelled = expand(np.arange(len(self.lengths)), self.rules, len(self.letters))
        return self.letters[spelled].astype(np.uint32), np.cumsum(self.lengths) - self.lengths

    def documents(self, lo: int, hi: int) -> np.ndarray:
        """The ids of documents lo to hi - 1 of the shard; reads no symbol of another document."""
        return self.letters[expand(self._symbols(int(self.ends[lo]), int(self.ends[hi])), self.rules, len(self.letters))].astype(np.uint32)

    def scan(self, many: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
        """All documents in a row, ``many`` at a time: (lo, hi, the ids of documents lo to hi - 1). Rules are expanded once."""
        spelled, begins = self.spelled
        for lo in range(0, len(self.doc_ids), many):
            hi = min(lo + many, len(self.doc_ids))
            symbols = self._symbols(int(self.ends[lo]), int(self.ends[hi]))
            lengths = self.lengths[symbols]
            stops = np.cumsum(lengths)
            yield lo, hi, spelled[np.arange(int(self.id_ends[hi] - self.id_ends[lo])) + np.repeat(begins[symbols] - (stops - lengths), lengths)]

    def ids(self, document: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1 of a document; only the symbols that reach into them are expanded."""
        symbols = self._symbols(int(self.ends[document]), int(self.ends[document + 1]))
        stops = np.cumsum(self.lengths[symbols])
        hi = min(hi, int(stops[-1]))
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(stops, [lo, hi - 1], "right").tolist()
        skipped = lo - int(stops[first] - self.lengths[symbols[first]])
        found = expand(symbols[first : last + 1], self.rules, len(self.letters))[skipped : skipped + hi - lo]
        return self.letters[found].astype(np.uint32)


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, waiting, size = encoder(tokenizer), 0, [], 0
        part = None

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex[:8]}.lsrp"
            doc_ids, counts, ids, nameless = (np.concatenate([w[i] for w in waiting]) for i in range(4))
            size = write_shard(path, doc_ids, np.cumsum(counts), ids, end_id, int(nameless.sum()))
            return pa.record_batch([pa.array([x]) for x in (np.int32(part), np.int32(shard), path, len(doc_ids), len(ids), size)], ["part", "shard", "path", "documents", "ids", "bytes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("__part")[0].as_py()
            nameless = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
            flat, stops = encode(text_bytes(batch.column("text")))
            counts = np.diff(stops, prepend=0) + 1
            ids = np.insert(flat, stops, end_id)
            lo = 0
            while lo < len(counts):  # a shard ends with the document that fills it
                hi = lo + int(np.searchsorted(np.cumsum(counts[lo:]), SHARD_IDS - size)) + 1
                a, b = int(counts[:lo].sum()), int(counts[:hi].sum())
                waiting.append((doc_ids[lo:hi], counts[lo:hi], ids[a:b], nameless[lo:hi]))
                size += b - a
                lo = hi
                if size >= SHARD_IDS:
                    yield flush()
                    shard, waiting, size = shard + 1, [], 0
        if waiting:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards in ascending doc_id order; returns the manifest, a row per shard.

    Manifest: part, shard, path, documents, ids, bytes, first_id (the ids of all shards before).
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    store, name = _store(folder)
    store.create_dir(name, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"))
    placed = texts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    shards = durable(placed.transform(in_tasks, _write(folder, tokenizer, end_id), _MANIFEST), "manifest")
    # Shards are added up within their part, and parts, of which there are as many as shuffle partitions, among themselves.
    earlier = (Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*earlier)), F.lit(0))
    manifest = durable(shards.withColumn("__within", within).join(parts, "part").select(*shards.columns, (F.col("__within") + F.col("__base")).alias("first_id")), "manifest")
    release(shards)
    return manifest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
            shard = Shard(path)
            for lo, hi, ids in shard.scan():
                at = shard.id_ends[lo : hi + 1]
                lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids.view(np.int32)))
                doc_ids = pa.array(shard.doc_ids[lo:hi], mask=np.arange(lo, hi) < shard.without_id)
                yield pa.record_batch([doc_ids, pa.array(at[:-1] + first), pa.array(np.diff(at)), lists], ["doc_id", "start", "n_tokens", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        column = batch.column("ids")
        ids, ends = column.values.to_numpy(), column.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b].astype("<i4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the shards of a manifest, or ids_crc32 instead of ids."""
    spark = manifest.sparkSession
    dealt = manifest.select("path", "first_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    if digests:
        return dealt.transform(in_tasks, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return dealt.transform(in_tasks, _read, "doc_id long, start long, n_tokens long, ids array<int>")
