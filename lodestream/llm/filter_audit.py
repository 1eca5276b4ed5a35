"""How five filters of documents interact: what each removes, alone and after others, in every order.

A document fails A (under ``MIN_WORDS`` words), B (too few of its words are different), C (too many capitals), D (a character of ``MARKS``)
and E (a smaller doc_id has the same text). A to D follow from the text alone. For E all documents are dealt out by ranges of text
fingerprint and doc_id and sorted by fingerprint, whole text and doc_id; each is compared with the one before, and the first texts of a
partition with the last ones of others, of which a table has one row for each partition. So a text with any number of copies is spread over as many tasks as its rows need.
A document's failures are a mask of five bits; masks are counted for each part and label (counts that add up, so parts can be merged),
and every order's steps follow from the counts of the 32 masks.

Defined cases: null texts are empty and equal to empty ones; without words only A fails; very long texts count whole; rows of equal
doc_id and text are no duplicates of each other; rows without a doc_id are neither duplicates nor make others so, and have no labels; a
label counts if any row of its document has it; null lang values are the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import durable, in_tasks

FILTERS = "ABCDE"
#: Fewest words; least part of words that are different, and largest of capitals, in hundredths; characters that no text may have.
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 100, 80, 10, "#$%&*|"
_SPACE = r"[\x20\x09-\x0D]+"
_ROWS = "doc_id long, part string, mask int, key binary, first long"


def own_failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    many = F.size(words).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    failed = (many < MIN_WORDS, 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_SHARE * many, 100 * capitals > CAPITAL_SHARE * F.length(text).cast("long"), text.rlike(f"[{MARKS}]"))
    mask = F.lit(0)
    for i, f in enumerate(failed):
        mask = mask + F.when(f, 1 << i).otherwise(0)
    return mask.cast("int")


def _duplicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks with E, of rows sorted by (fingerprint, text, doc_id).

    Rows with the partition's first fingerprint have their text's digest as ``key``: earlier partitions may hold that text too. The last
    rows, without a mask, say which texts have the partition's last fingerprint (one, unless two texts share it), and their first doc_ids.
    """
    names = [f.split()[0] for f in _ROWS.split(", ")]
    opening = last = low = None  # the partition's first fingerprint, the text of the row before, and the first doc_id that has it
    closing: tuple[int | None, dict[bytes, int | None]] = None, {}

    def digest(text: str) -> bytes:
        return hashlib.sha256(text.encode()).digest()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        prints, texts = batch.column("print").to_numpy(), batch.column("text")
        same = np.zeros(n, bool)
        near = np.flatnonzero(prints[1:] == prints[:-1]) + 1
        if len(near):
            same[near] = pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        same[0] = last is not None and texts[0].as_py() == last
        group = np.cumsum(~same)  # 0: goes on from the batch before
        frame = pd.DataFrame({"g": group, "d": pd.array(batch.column("doc_id").to_pylist(), dtype="Int64")})
        lows = frame.groupby("g")["d"].min()
        if same[0] and low is not None:
            lows.loc[0] = low  # rows are in order, so the smallest came first
        firsts = lows.reindex(group).array
        again = (frame["d"].array > firsts).fillna(False).to_numpy(dtype=bool)
        mask = batch.column("mask").to_numpy() + np.where(again, 1 << 4, 0)
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        if opening is None:
            opening = prints[0]
        head = int(np.searchsorted(prints != opening, True))
        keys: list[bytes | None] = [None] * n
        for begin, end in zip(starts, [*starts[1:], n], strict=True):
            if begin >= head:
                break
            keys[begin:end] = [digest(texts[int(begin)].as_py())] * (end - begin)
        yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(mask.astype(np.int32)), pa.array(keys, pa.binary()), pa.nulls(n, pa.int64())], names)
        if closing[0] != prints[-1]:
            closing = prints[-1], {}
        for begin in starts[prints[starts] == prints[-1]].tolist():
            closing[1].setdefault(digest(texts[begin].as_py()), None if pd.isna(firsts[begin]) else int(firsts[begin]))
        last, low = texts[n - 1].as_py(), None if pd.isna(firsts[-1]) else int(firsts[-1])
    if closing[1]:
        n = len(closing[1])
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(list(closing[1]), pa.binary()), pa.array(list(closing[1].values()), pa.int64())], names)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs(doc_id, text, lang)``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("print"))
    # Ranges are of fingerprint and doc_id, so that no texts are sampled for them; the sample is taken before A to D are looked at.
    ranged = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id").withColumn("mask", own_failures(F.col("text")))
    found = durable(ranged.transform(in_tasks, _duplicates, _ROWS), "masks")
    # One row for each partition, as long as no two texts share a fingerprint.
    ends = found.where("mask is null").groupBy(F.col("key").alias("text_key")).agg(F.min("first").alias("low"))
    late = F.coalesce((F.col("doc_id") > F.col("low")) & (F.col("mask") < 16), F.lit(False))
    rows = found.where("mask is not null").join(F.broadcast(ends), F.col("key") == F.col("text_key"), "left")
    return rows.select("doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).cast("int").alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: how many documents of a part fail the same filters and have the same labels. Counters of tables add up."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    # Rows that repeat are one before the join, so that no doc_id is hot.
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}
    return rows.withColumns(zero).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counters: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of every order, from the counters."""
    # Filters as bits: what an order's earlier steps look at, and its own.
    steps = F.array(*(
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(1 << FILTERS.index(f) for f in order[:k])).alias("before"), F.lit(1 << FILTERS.index(order[k])).alias("own"))
        for order in permutations(FILTERS) for k in range(len(FILTERS))
    ))
    every = counters.select("part", "mask", "good", "toxic", "n", F.explode(steps).alias("s")).select("*", "s.*").drop("s")
    passed = F.col("mask").bitwiseAND(F.col("before")) == 0
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    # Of all orders those in which a filter comes before the others that a document fails are as many for each of these.
    orders = F.lit(120) / F.bit_count("mask")
    count = lambda when, n="n": F.sum(F.when(when, F.col(n) if isinstance(n, str) else n).otherwise(0)).cast("long")
    return every.groupBy("part", "filter_order", "step").agg(
        count(passed & ~fails).alias("kept"), count(passed & fails).alias("removed"), count(~passed & fails).alias("redundant"), count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(passed & fails & (F.col("good") == 1)).alias("good_lost"), count(passed & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
        count(fails, F.col("n") * orders.cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the documents' failures."""
    return interactions(part_counters(failures(docs), labels))
