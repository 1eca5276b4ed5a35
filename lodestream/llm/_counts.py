"""Tables of counts of a fixed size, added up over all tasks block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import in_tasks

BLOCK = 1 << 13
#: What tasks give to ``total``.
BLOCKS = "block int, counts binary"


def _packed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        packed = [np.minimum(b, 0xFFFFFFFF).astype("<u4").tobytes() for b in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts as rows of ``BLOCKS``; blocks without any are left out."""
    yield from _packed({i: b for i, b in enumerate(counts.reshape(-1, BLOCK)) if b.any()})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(counts, "<u4").astype(np.int64)
            sums[block] = sums[block] + more if block in sums else more
    yield from _packed(sums)


def total(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' counts: ``shape`` numbers of four bytes, at any size of input."""
    rows = parts.repartition(16, "block").transform(in_tasks, _sum, BLOCKS).collect()
    out = np.zeros(shape, np.uint32)
    for row in rows:
        out.reshape(-1, BLOCK)[row["block"]] = np.frombuffer(row["counts"], "<u4")
    return out
