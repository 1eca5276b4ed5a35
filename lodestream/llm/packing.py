"""Best-fit-decreasing packing of token sequences into sequences of a fixed capacity.

Best-fit decreasing depends only on how many pieces there are of each length, of which there are ``capacity`` at most.
So Spark counts the lengths, the driver packs the counts (pieces of one length at a time, tightest open bins found in a
segment tree over remaining capacities), and every piece learns its place from its rank among the pieces of its length. The
result is that of packing all pieces one by one; the driver's work and the table of moves do not grow with the documents.

A piece's rank is its number among the pieces of its length that its task wrote, which the task counts as it writes, and how many
pieces of that length the tasks before it wrote. Those sums are a row for each task and length: up to ``BROADCAST`` of them are sent
to where the pieces lie, so that no ids are shuffled; beyond that pieces and sums are joined by task.

Defined cases: null and empty texts are the end id alone; a document longer than the capacity, however long, is cut so that its
first piece takes the remainder; rows that repeat a doc_id, or have none, are packed each for itself; among pieces of one length
the one that was written first takes the first place; an empty table gives an empty result; of other columns only those asked
for are carried along, and those named like a result column give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import durable, in_tasks
from ._text import text_bytes
from ._tokens import encoder

#: Rows of sums (a task and a length each) that are broadcast at most: some 30 MB.
BROADCAST = 500_000


class CapacityTree:
    """Segment tree over remaining capacities: finds the smallest one, at least as large as asked, that has open bins."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._open = [0] * (2 * self._leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self._leaves
        while at:
            self._open[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """In logarithmic time: up to the first subtree on the right that has bins, then down its left side."""
        at = least + self._leaves
        if not self._open[at]:
            while at & 1 or not self._open[at ^ 1]:
                at >>= 1
                if at <= 1:
                    return None
            at ^= 1
            while at < self._leaves:
                at *= 2
                if not self._open[at]:
                    at += 1
        return at - self._leaves


def best_fit_moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Moves ``(length, first rank, pieces, pieces per bin, first bin, offset)`` of best-fit decreasing.

    A bin that got a piece stays the tightest for the next piece of that length while it fits, so each run of bins with
    the same remaining capacity is filled at once.
    """
    tree = CapacityTree(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # first bin and number, by what remains
    moves, bins = [], 0

    def put(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            runs[remaining].append((first, number))
            tree.add(remaining, number)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, number = bins, -(-left // per)
                bins += number
            else:
                per = room // length
                first, number = runs[room].pop()
                tree.add(room, -number)
                needed = -(-left // per)
                if needed < number:
                    put(room, first + needed, number - needed)
                    number = needed
            placed = min(left, number * per)
            moves.append((length, rank, placed, per, first, capacity - room))
            full = placed // per
            put(room - per * length, first, full)
            if placed % per:
                put(room - placed % per * length, first + full, 1)
            left, rank = left - placed, rank + placed
    return moves


class _Numbers:
    """Numbers pieces among those of their length that this task has met."""

    def __init__(self):
        self._seen = np.zeros(1, np.int64)
        self._part = TaskContext.get().partitionId()

    def columns(self, lengths: np.ndarray) -> list[pa.Array]:
        """``__part`` and ``__nth``."""
        counts = np.bincount(lengths, minlength=len(self._seen))
        self._seen = np.concatenate([self._seen, np.zeros(len(counts) - len(self._seen), np.int64)])
        order = np.argsort(lengths, kind="stable")
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
        nth += self._seen[lengths]
        self._seen += counts
        return [pa.array(np.full(len(lengths), self._part, np.int32)), pa.array(nth)]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _Numbers()
    for batch in batches:
        yield pa.record_batch([*batch.columns, *numbers.columns(batch.column("length").to_numpy())], [*batch.schema.names, "__part", "__nth"])


def _cut(tokenizer: str, end_id: int, capacity: int, carried: list[str], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, numbers = encoder(tokenizer), _Numbers()
        for batch in batches:
            flat, stops = encode(text_bytes(batch.column("text")))
            rows, places, begin = [], [], 0
            owned: list[np.ndarray] = []
            for i, stop in enumerate(stops.tolist()):
                own = np.append(flat[begin:stop], end_id).astype("<u4")
                begin = stop
                head = len(own) % capacity or capacity
                bounds = [0, *range(head, len(own) + 1, capacity)]
                for k in range(len(bounds) - 1):
                    part = own[bounds[k] : bounds[k + 1]]
                    rows.append((k, bounds[k], len(part), zlib.crc32(part.tobytes())))
                    places.append(i)
                    if ids:
                        owned.append(part.view(np.int32))
            at = pa.array(places, pa.int64())
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            made += [pa.array(owned, pa.list_(pa.int32()))] if ids else []
            made += numbers.columns(np.array([r[2] for r in rows], np.int64))
            names = ["piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "__part", "__nth"]
            yield pa.record_batch([*(batch.column(c).take(at) for c in carried), *made], [*carried, *names])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, ids: bool = True, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows ``piece, start, length, ids_crc32`` (and ``ids``) of the token ids of each text with ``end_id`` after them.

    ``__part`` and ``__nth`` number the pieces of a length for ``best_fit_pack``; they hold for a written table.
    """
    made = ("piece", "start", "length", "ids_crc32", "ids", "__part", "__nth")
    carried = tuple(c for c in dict.fromkeys(("doc_id", *carried)) if c not in made)
    fields = [docs.schema[c] for c in carried]
    fields += [T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField("__part", T.IntegerType()), T.StructField("__nth", T.LongType())]
    return docs.select(*carried, *(["text"] if "text" not in carried else [])).transform(in_tasks, _cut(tokenizer, end_id, capacity, list(carried), ids), T.StructType(fields))


def _place(moves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, per, first, offset = moves.value
        keys = length * (1 << 50) + rank
        for batch in batches:
            size, own = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.searchsorted(keys, size * (1 << 50) + own, "right") - 1
            inner = own - rank[at]
            made = [pa.array(first[at] + inner // per[at]), pa.array(offset[at] + inner % per[at] * size)]
            names = [c for c in batch.schema.names if c != "__rank"]
            yield pa.record_batch([*(batch.column(c) for c in names), *made], [*names, "sequence_id", "offset"])

    return run


def best_fit_pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces(length, ...)`` with ``sequence_id`` and ``offset``; no length may be over ``capacity``.

    Pieces of ``token_pieces`` must come from a written table: they are read twice. Others are numbered and written here.
    """
    spark = pieces.sparkSession
    pieces = pieces.select([c for c in pieces.columns if c not in ("sequence_id", "offset")])
    if "__nth" not in pieces.columns:
        schema = T.StructType([*pieces.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__nth", T.LongType())])
        pieces = durable(pieces.withColumn("length", F.col("length").cast("long")).transform(in_tasks, _number, schema), "pieces")
    columns = [c for c in pieces.columns if c not in ("__part", "__nth")]
    counts = durable(pieces.groupBy("__part", "length").agg((F.max("__nth") + 1).alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    if any(not 0 < x <= capacity for x in total):
        raise ValueError("a piece is empty or longer than the capacity")
    moves = spark.sparkContext.broadcast(np.array(sorted(best_fit_moves(total, capacity)), np.int64).reshape(-1, 6).T)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    base = F.broadcast(base) if counts.count() <= BROADCAST else base.hint("shuffle_hash")
    ranked = pieces.join(base, ["__part", "length"]).select(*columns, (F.col("__nth") + F.col("__base")).alias("__rank"))
    fields = [pieces.schema[c] for c in columns]
    return ranked.transform(in_tasks, _place(moves), T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, ids: bool = True, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokenize, cut and pack whole texts: one row per piece with its place in a sequence."""
    return best_fit_pack(durable(token_pieces(docs, tokenizer, end_id, capacity, ids, carried), "pieces"), capacity)
