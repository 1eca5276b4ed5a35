"""Reading a folder again and again: new files by the file stream; new, overwritten and moved ones by comparing listings."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import FILES, checksum, load_state, needs_reindex, save_state, scan
from ..staging import stage

#: What is known of a file without reading it.
LISTING = "path string, modificationTime timestamp, length long"
LOG = logging.getLogger(__name__)


def watch(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame], None], once: bool = False, pattern: str = "*") -> StreamingQuery:
    """Hand the new files of a folder to ``ingest`` as ``(path, content, checksum)``, micro-batch by micro-batch.

    A batch that ``ingest`` can't take is logged and left, and the stream goes on (for an engine: ``Engine.reindex``).
    The stream's checkpoint keeps what was seen, so a restart goes on where the last batch ended. It knows files by
    their paths: for overwritten ones see ``watch_changes``.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    files = files.withColumn("checksum", checksum(F.col("content")))

    def each(batch: DataFrame, number: int) -> None:
        try:
            ingest(batch)
        except Exception:  # noqa: BLE001  one bad batch must not end the watch
            LOG.exception("batch %d could not be ingested", number)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def changed_files(spark: SparkSession, folder: str, state_path: str, pattern: str | None = None) -> DataFrame:
    """The files of a folder whose checksum is new or differs from the recorded one."""
    return needs_reindex(scan(spark, folder, pattern), load_state(spark, state_path)).where("changed").drop("changed")


def watch_changes(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame], None], once: bool = False, pattern: str = "*", every: str = "10 seconds") -> StreamingQuery:
    """Hand files of a folder that are new, overwritten or moved there to ``ingest``, as ``watch`` does, and go on doing so.

    A clock drives the stream. At each turn the folder's listing (paths, times and lengths: no content is read) is compared with the one that
    was kept under the checkpoint, and the contents of what differs are read. The listing is kept as versions of a table, written once
    ``ingest`` is through: after a restart, or a turn that was broken off, what had not been handed on to its end is handed on again. A batch
    that ``ingest`` refuses is logged and left until the file changes again.
    """
    known = f"{checkpoint.rstrip('/')}/listing"
    reader = lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)

    def turn(_: DataFrame, number: int) -> None:
        now = stage(reader().select("path", "modificationTime", "length"), "listing")
        before = load_state(spark, known, LISTING)
        # In whole milliseconds: that is what file systems' listings have.
        changed = now.join(before, ["path", "modificationTime", "length"], "left_anti")
        span = changed.agg(F.count("*"), F.min("modificationTime"), F.max("modificationTime"), F.min("length"), F.max("length")).first()
        if not span[0] and now.count() == before.count():
            return
        if span[0]:
            # Times and lengths are pushed down to the listing, so that most contents are not even opened.
            some = reader().where(F.col("modificationTime").between(span[1], span[2]) & F.col("length").between(span[3], span[4]))
            batch = some.join(changed.select("path"), "path", "left_semi").withColumn("checksum", checksum(F.col("content")))
            try:
                ingest(batch)
            except Exception:  # noqa: BLE001  one bad batch must not end the watch
                LOG.exception("turn %d could not be ingested", number)
        save_state(now, known)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.foreachBatch(turn).option("checkpointLocation", f"{checkpoint.rstrip('/')}/clock")
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()
