"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Cells alone would miss pairs on either side of a border, so of each two cells one takes the other's vectors near the border (the
plane between the two centres) as guests: all that lie as near as two linked vectors can be apart, sqrt(2 - 2 t). A pair of two cells
is compared in that one cell and counts for both of its vectors, so the result is that of comparing all pairs. Centres are
fitted on a sample of at most ``SAMPLE`` vectors; where they lie decides how much work there is, not what is found.

Equal vectors are one class with a number of its own, whatever their vec_ids; rows find their class by 128 bits of a hash of the
vector, so vectors are shuffled once to make the classes and then only as members of cells. A cell is dealt out by blocks of at most ``BLOCK`` of its own vectors and ``OTHERS`` that
they are compared with, so a group with a third of all rows is spread over many tasks; a task returns each row's number of links and a
spanning forest of the links it saw, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (n_links 0, their own
component); vectors of each length are compared among themselves, as those of different lengths have no cosine; rows that repeat a vec_id are vectors of their own, each with its
own links, and a component is named by the smallest vec_id of its rows; rows without a vec_id link with nothing and have no
component; a cosine equal to the threshold is a link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import connected_components, durable, in_tasks, release, spread_join

#: Vectors that centres are fitted on, vectors that a cell should have, cells at most (beyond so many times ``CELL`` vectors cells have more
#: of them), and vectors of a task on either side.
SAMPLE, CELL, MOST_CELLS, BLOCK, OTHERS = 16_384, 4_096, 2_048, 4_096, 32_768
_TILE = 1_024


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        sizes = np.linalg.norm(sums, axis=1)
        centres = sums[sizes > 1e-12] / sizes[sizes > 1e-12, None]
    return centres


def _unit(column: pa.Array) -> np.ndarray:
    rows = column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _hosts(k: int) -> np.ndarray:
    """Whether cell b (column) takes guests from cell a (row): of each two cells one does, and each cell from about half of the others."""
    ahead = (np.arange(k)[None, :] - np.arange(k)[:, None]) % k
    return (ahead > 0) & (2 * ahead < k) | (2 * ahead == k) & (np.arange(k)[:, None] < np.arange(k)[None, :])


def _assign(centres: np.ndarray, threshold: float):
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T) + 1e-12)  # rounded up: a little too far only adds guests
    hosts, itself = _hosts(len(centres)), np.eye(len(centres), dtype=bool)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            rows = _unit(column)
            for begin in range(0, len(rows), 512):
                near = rows[begin : begin + 512] @ centres.T
                home = np.argmax(near, axis=1)
                best = near[np.arange(len(near)), home]
                at, cell = np.nonzero((best[:, None] - near <= reach * apart[home] + 1e-12) & hosts[home] | itself[home])
                for lo in range(0, len(at), 20_000):
                    part = slice(lo, lo + 20_000)
                    index = pa.array(begin + at[part])
                    yield pa.record_batch(
                        [pa.array(cell[part].astype(np.int32)), pa.array(home[at[part]] == cell[part]), batch.column("id").take(index), batch.column("m").take(index), column.take(index)],
                        ["cell", "home", "id", "m", "vector"],
                    )

    return run


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # places are in the order of ids
        ids, m, at_home, home = (table.column(c).to_numpy() for c in ("id", "m", "as_own", "home"))
        own, other = np.flatnonzero(at_home), np.flatnonzero(table.column("as_other").to_numpy())
        rows = _unit(table.column("vector").combine_chunks())
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for lo in range(0, len(own), _TILE):
            left = own[lo : lo + _TILE]
            for at in range(0, len(other), _TILE):
                right = other[at : at + _TILE]
                a, b = np.nonzero(rows[left] @ rows[right].T >= threshold)
                a, b = left[a], right[b]
                differ = a != b
                a, b = a[differ], b[differ]
                links += np.bincount(a, m[b], len(ids)).astype(np.int64)
                guests = ~home[b]  # a pair of one cell is met from either side, one with a guest only here
                links += np.bincount(b[guests], m[a[guests]], len(ids)).astype(np.int64)
                root = _united(root, a, b)
        keep = (links > 0) | (root != np.arange(len(ids)))
        return pa.table({"id": ids[keep], "links": links[keep], "root": ids[root][keep]})

    return run


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first member of each tree after the trees of a and b are joined pair by pair."""
    x, y = root[a], root[b]
    pairs = np.unique(x[x != y] * len(root) + y[x != y])
    x, y = pairs // len(root), pairs % len(root)
    top = np.arange(len(root))
    while (top[x] != top[y]).any():
        low = np.minimum(top[x], top[y])
        np.minimum.at(top, x, low)
        np.minimum.at(top, y, low)
    return top[root]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = every.where(F.coalesce(usable & fine, F.lit(False)))
    # A row for each length; as a rule there is one.
    widths = [r["n"] for r in good.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").collect()]
    out = every.where(~F.coalesce(usable & fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for width in widths:
        out = out.unionByName(_of_one_width(good if len(widths) == 1 else good.where(F.size("embedding") == width), width, kind, threshold))
    return out


def _of_one_width(good: DataFrame, width: int, kind: str, threshold: float) -> DataFrame:
    """``near_duplicates`` of ``(vec_id, embedding)`` whose vectors all have ``width`` numbers and can be compared."""
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    good = good.withColumns({f"h{i}": F.xxhash64(F.lit(i), "embedding") for i in (1, 2)})
    classes = good.groupBy("h1", "h2", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    rows = _unit(pa.array(sample.to_pylist(), pa.list_(pa.float64())))
    k = int(np.clip(classes.count() // CELL, 1, min(MOST_CELLS, len(rows))))
    centres = spherical_kmeans(rows, k)
    placed = durable(classes.transform(in_tasks, _assign(centres, threshold), f"cell int, home boolean, id long, m long, vector array<{kind}>"), "cells")

    # Cells are few (MOST_CELLS at most), and so are these counts.
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("own"), F.ceil(F.count("*") / OTHERS).cast("int").alias("all"))
    dealt = placed.join(F.broadcast(sizes), "cell").where("own > 0").withColumns({"i": F.pmod(F.xxhash64("id"), "own"), "j": F.pmod(F.xxhash64("id"), "all")})
    # A task holds one block of a cell's own vectors (i) and one of all of its vectors (j). A vector goes to all tasks of its block j,
    # and if it is at home here to those of its block i; where both meet it is one row.
    every_i, every_j = F.sequence(F.lit(0), F.col("own") - 1), F.sequence(F.lit(0), F.col("all") - 1)
    as_other = F.transform(every_i, lambda i: F.struct(i.alias("i"), F.col("j").cast("int").alias("j"), (F.col("home") & (i == F.col("i"))).alias("as_own"), F.lit(True).alias("as_other")))
    as_own = F.transform(F.filter(every_j, lambda j: F.col("home") & (j != F.col("j"))), lambda j: F.struct(F.col("i").cast("int").alias("i"), j.alias("j"), F.lit(True).alias("as_own"), F.lit(False).alias("as_other")))
    tiles = dealt.select("cell", "home", "id", "m", "vector", F.explode(F.concat(as_other, as_own)).alias("t")).select("cell", "t.*", "home", "id", "m", "vector")
    found = durable(tiles.groupBy("cell", "i", "j").applyInArrow(_tile(threshold), "id long, links long, root long"), "links")

    parts = durable(connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "components")
    release(placed)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "id", "low", "m").join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    lowest = named.where("component is not null").groupBy("component").agg(F.min("low").alias("lowest"), F.count("*").alias("n"))
    linked = spread_join(named.where("component is not null"), lowest, ["component"], "n")
    named = linked.unionByName(named.where("component is null").withColumn("lowest", F.col("low")))
    named = durable(named.select("h1", "h2", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id")), "named")
    release(found, parts)
    full = spread_join(good.select("vec_id", "h1", "h2"), named, ["h1", "h2"], "m")
    return full.select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
