"""Helpers of the operators that touch the session: durable tables and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine that has none, as in tests, gets a folder of its own.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lodestream-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lodestream/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of 8 MB at most, so that long texts don't add up in a worker's memory.

    The setting is read when a plan runs, so it stays; a smaller one is left alone.
    """
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(conf)
    if now in ("67108864", "67108864b", "64m", "64mb", "-1", "-1b"):
        spark.conf.set(conf, "8m")


def _tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Give memory that a task has freed back to the system: a worker that waits for its next task holds none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size, for ``df.transform(in_tasks, run, schema)``."""
    small_batches(df.sparkSession)
    return df.mapInArrow(_tidy(run), schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before; nothing is left to ask
            return


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work doesn't depend on executors' disks.

    ``release`` deletes the table once what is made of it has been written; at the latest the driver does when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    conf, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        before = spark.conf.get(conf)
        spark.conf.set(conf, "true")  # what was shuffled on the way has served its turn
        df.write.parquet(path)
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._lodestream_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that no plan still to be run reads."""
    for table in tables:
        path = table.__dict__.pop("_lodestream_path", None)
        if path is not None:
            remove(table.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


#: Rows of one key that one task gets in ``spread_join``, and keys that are spread at most.
SHARE, HOT_KEYS = 2_000, 1_000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key and says in ``count`` how many rows of ``many`` have it.

    The keys with most rows (``HOT_KEYS`` at most, so any other has less than that part of all rows) are spread: their row of
    ``one`` is copied, and each row of ``many`` goes to one copy. Only those keys and their numbers of copies are broadcast.
    """
    hot = one.where(F.col(count) > SHARE).select(*keys, count).orderBy(F.desc(count), *keys).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col(count) / SHARE).cast("int").alias("__copies")))
    # Rows of a hot key are dealt out by a hash of all of their columns.
    salt = F.when(F.col("__copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), "__copies")).cast("int")
    left = many.join(hot, keys, "left").withColumn("__salt", salt).drop("__copies")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))
    right = one.join(hot, keys, "left").withColumn("__salt", copies).drop("__copies", count)
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Alternates the large-star and small-star steps: each node's neighbours are tied to the smallest of them.
    Every step is a grouped minimum (taken before the shuffle as far as it can be, so hubs are no hot group) and an equi-join of
    pairs of numbers, in which adaptive execution splits a hub that is too large for one task; each round is written to the shared
    folder. Self-loops keep lone nodes.
    """

    def both(df: DataFrame) -> DataFrame:
        return df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(df.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(df: DataFrame, large: bool) -> DataFrame:
        near = both(df) if large else df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        tied = near.join(low, "u")
        if large:
            out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    nodes = durable(edges.select("a", "b").distinct(), "edges")
    now, before, last = nodes.where("a <> b"), None, None
    for _ in range(max_rounds):
        df = durable(star(star(now, True), False), "stars")
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last is not None:
            release(last)
        last = now = df
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    every = both(nodes).select(F.col("u").alias("node")).distinct()
    return every.join(roots, "node", "left").select("node", F.least("node", F.coalesce("low", "node")).alias("component"))
