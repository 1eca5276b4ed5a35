"""Tables that are written on the way: a plan that uses one several times reads it, and what is lost with an executor isn't worked out anew."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_staged: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a folder of its own only for a session on one machine that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lodestream-"))
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver ends, at the latest."""
    path = f"{shared_folder(spark)}/lodestream/{name}-{uuid.uuid4().hex[:12]}"
    if not _staged:
        atexit.register(_clean)
    _staged.append((spark, path))
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written here goes as soon as the table is there, and not when the driver happens to collect its garbage."""
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "true")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def stage(rows: DataFrame, name: str = "staged") -> DataFrame:
    """``rows`` written under a name of their own, and read back; ``release`` deletes them."""
    path = scratch(rows.sparkSession, name)
    with tidy(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table._lodestream_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``stage`` that no plan still to be run reads."""
    for table in tables:
        path = table.__dict__.pop("_lodestream_path", None)
        if path is not None:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _staged[:] = [x for x in _staged if x[1] != path]


def _clean() -> None:
    for spark, path in list(_staged):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return
