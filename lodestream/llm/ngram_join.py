"""Exact n-gram Jaccard join with prefix filters under several global token orders.

A document is the set of its distinct word shingles, each a 64-bit hash. Two sets with Jaccard similarity of at
least t share, under *any* total order of tokens, one of their first ``n - ceil(t n) + 1`` tokens. Order 1 puts rare
tokens first (counts of all shingles in a count-min sketch of fixed size, ties by hash); orders 2 and 3 are keyed
hash orders. Candidates come from shared tokens of order 1 within the bounds on length and position, and are dropped
unless they share prefix tokens under the other orders too; what is left is verified on the whole sets.

Equal sets are one candidate. Links are first sought to one hub of each token (its document with the fewest rarer
tokens), then between documents that are still in different components: no linked pair across components is lost, and
a group of copies is never expanded into all its pairs. Joins on sets, tokens and hubs spread the keys with most rows over
tasks, and the documents of one token that are still apart are compared in blocks of ``BLOCK``.

Defined cases: null, empty or word-free texts have ``n_shingles`` 0 and are components of their own; texts with fewer
words than the width have their whole sequence as one shingle; very long texts count whole; tokens with equal counts are in the
order of their hashes, hubs that are alike in the order of their doc_ids; a similarity equal to the threshold is a link; rows that
repeat a doc_id count as one document for links (each keeps its own row and count); rows without a doc_id link with nothing and have no
component; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._counts import BLOCKS, blocks, total
from ._spark import connected_components, durable, in_tasks, release, spread_join
from ._text import U, lists, mix, shingles, text_bytes

#: Rows and slots of the sketch; its 4 MB do not depend on the input.
SKETCH_ROWS, SKETCH_BITS = 2, 19
#: Documents of a token that a task compares with as many others.
BLOCK = 2_000
_SEEDS = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25))
_PREPARED = "doc_id long, n_shingles long, set_hash binary, p1 array<bigint>, p2 array<int>, p3 array<int>"


def _slots(tokens: np.ndarray) -> list[np.ndarray]:
    keep = U((1 << SKETCH_BITS) - 1)
    return [((tokens >> U(7 + 24 * r)) & keep).astype(np.int64) for r in range(SKETCH_ROWS)]


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        waiting, size = [], 0

        def add() -> None:
            for r, slots in enumerate(_slots(np.concatenate(waiting))):
                sketch[r] += np.bincount(slots, minlength=1 << SKETCH_BITS)

        for batch in batches:
            for found in shingles(text_bytes(batch.column(0)), width):
                waiting.append(found)
                size += len(found)
                if size > 1 << 20:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        yield from blocks(sketch)

    return run


def token_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of how many documents hold each shingle, over all documents. 4 MB at any size of input."""
    return total(docs.select("text").transform(in_tasks, _count(width), BLOCKS), (SKETCH_ROWS, 1 << SKETCH_BITS))


def _prefix_length(n: int, limit: Fraction) -> int:
    return n + 1 + (-n * limit.numerator // limit.denominator) if n else 0


def _prepare(width: int, limit: Fraction, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            sizes, marks, prefixes = [], [], ([], [], [])
            for found in shingles(text_bytes(batch.column(1)), width):
                n, p = len(found), _prefix_length(len(found), limit)
                sizes.append(n)
                marks.append(b"".join(np.sum(mix(found ^ s), keepdims=True).tobytes() for s in _SEEDS) if n else None)
                seen = np.min([counts[r][x] for r, x in enumerate(_slots(found))], axis=0)
                prefixes[0].append(found[np.argsort(seen, kind="stable")[:p]])
                for out, seed in zip(prefixes[1:], _SEEDS, strict=True):
                    order = mix(found ^ seed)
                    out.append((np.partition(order, p - 1)[:p] if n else order).astype(np.uint32).view(np.int32))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists([x.view(np.int64) for x in prefixes[0]], pa.int64()), *(lists(x, pa.int32()) for x in prefixes[1:])],
                ["doc_id", "n_shingles", "set_hash", "p1", "p2", "p3"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in shingles(text_bytes(batch.column(1)), width)]
            yield pa.record_batch([batch.column(0), lists(found, pa.int64())], ["id", "tokens"])

    return run


def _with_sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a written table with the columns of ``table(id, ...)`` for either side; ids in many pairs are spread."""
    out = pairs
    for side in "ab":
        one = table.select([F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in table.columns])
        out = spread_join(out, one.join(pairs.groupBy(side).agg(F.count("*").alias("__n")), side), [side], "__n")
    return out


def ngram_components(docs: DataFrame, width: int = 5, threshold: float | str = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that a document reaches by links, a link being a Jaccard similarity of at
    least ``threshold`` of the sets of ``width``-word shingles.
    """
    limit = Fraction(str(threshold))
    num, den = limit.numerator, limit.denominator
    if not 0 < limit <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = spark.sparkContext.broadcast(token_sketch(texts, width))
    prepared = durable(texts.transform(in_tasks, _prepare(width, limit, sketch), _PREPARED), "prefixes")

    full = prepared.where("n_shingles > 0 and doc_id is not null")
    classes = durable(full.groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    chosen = full.join(classes.select(F.col("id").alias("doc_id"), "n_shingles", "set_hash"), ["doc_id", "n_shingles", "set_hash"], "left_semi")
    postings = chosen.select(F.posexplode("p1").alias("pos", "token"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    hubs = durable(postings.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs")
    shared = durable(spread_join(postings, hubs, ["token"], "m"), "postings")
    release(hubs)

    def bounded(a: str, b: str) -> F.Column:
        """Bounds on length, and on what can still overlap after a first common token at these positions."""
        col = F.col
        least, most = F.least(col(f"{a}.n"), col(f"{b}.n")), F.greatest(col(f"{a}.n"), col(f"{b}.n"))
        rest = F.least(col(f"{a}.n") - col(f"{a}.pos"), col(f"{b}.n") - col(f"{b}.pos"))
        return (least * den >= most * num) & (rest * (num + den) >= (col(f"{a}.n") + col(f"{b}.n")) * num)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are links: prefixes under the other orders first, whole sets of the documents that are left then."""
        orders = chosen.select(F.col("doc_id").alias("id"), "p2", "p3")
        pairs = durable(pairs.distinct(), "pairs")
        near = _with_sides(pairs, orders).where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
        near = durable(near.select("a", "b").distinct(), "candidates")
        release(pairs)
        wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        own = texts.withColumnRenamed("doc_id", "id").join(wanted.hint("merge"), "id", "left_semi")  # the same plan at every size
        sets = durable(own.transform(in_tasks, _sets(width), "id long, tokens array<bigint>"), "sets")
        both = _with_sides(near, sets)
        common, total = F.size(F.array_intersect("tokens_a", "tokens_b")), F.size("tokens_a") + F.size("tokens_b")
        both = both.select("a", "b", common.cast("long").alias("common"), total.cast("long").alias("total"))
        links = durable(both.where(F.col("common") * den >= (F.col("total") - F.col("common")) * num).select("a", "b").distinct(), "links")
        release(near, sets)
        return links

    to_hub = shared.select(F.struct("id", "n", "pos").alias("x"), F.col("hub").alias("y")).where("x.id <> y.id").where(bounded("x", "y"))
    first = verified(to_hub.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")))
    parts = durable(connected_components(first), "components")

    placed = shared.drop("hub").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("token").agg((F.min("component") < F.max("component")).alias("open"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    open_ = durable(placed.join(split.where("open").drop("open"), "token"), "open")
    release(shared)
    # Block i of a token's documents meets block j in a task of their own.
    own, every = F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x, y = open_.withColumn("i", own).withColumn("j", every).alias("x"), open_.withColumn("j", own).withColumn("i", every).alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    across = x.join(y, met & (F.col("x.component") < F.col("y.component")) & bounded("x", "y"))
    second = verified(across.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")))
    release(open_, parts)
    parts = durable(connected_components(first.unionByName(second)), "components")
    release(first, second)

    named = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select("n_shingles", "set_hash", "copies", F.coalesce("component", "id").alias("component_id"))
    rows = spread_join(full.select("doc_id", "n_shingles", "set_hash"), durable(named, "named"), ["n_shingles", "set_hash"], "copies")
    rest = prepared.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id").unionByName(rest)


def keep_one(docs: DataFrame, width: int = 5, threshold: float | str = 0.8) -> DataFrame:
    """``docs`` without the documents that are not the first of their component; all columns, and rows without a doc_id, stay."""
    copies = ngram_components(docs, width, threshold).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
