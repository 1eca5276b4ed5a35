"""Files as tables, what is known of them, and what has to be read again."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_EXTENSIONS
from ..functions.chunking import table_markdown, table_summary
from ..operators.recognition import recognised_blocks

LOG = logging.getLogger(__name__)
EXTENSIONS = ["pdf", *IMAGE_EXTENSIONS]
STATE = "path string, checksum string"
FILES = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content, checksum`` of the files in a folder."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(folder).withColumn("checksum", checksum(F.col("content")))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def kind(path: Column) -> Column:
    """``pdf``, ``image`` or null for other extensions."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(extension == "pdf", "pdf").when(extension.isin(IMAGE_EXTENSIONS), "image")


def load_state(spark: SparkSession, path: str, schema: str = STATE) -> DataFrame:
    """Checksums of files that were read before: the latest version that can be read to its end; none if there is no such version."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    for version in sorted(_versions(spark, path), reverse=True):
        rows = spark.read.schema(schema).parquet(f"{path}/v{version}")
        try:
            # Broken files show when they are read, so every value is.
            rows.select(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).collect()
        except (PySparkException, Py4JJavaError):
            LOG.warning("version %d of the state under %s can't be read", version, path)
            continue
        return rows
    return spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the state that were written to the end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")) or []
    return [int(f.getPath().getParent().getName()[1:]) for f in found]


def save_state(state: DataFrame, path: str) -> None:
    """Write a new version beside the older ones; it counts when it is whole. Of the older ones the last is kept."""
    spark = state.sparkSession
    held = sorted(_versions(spark, path))
    state.write.mode("overwrite").parquet(f"{path}/v{held[-1] + 1 if held else 0}")
    for version in held[:-1]:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def needs_reindex(files: DataFrame, state: DataFrame) -> DataFrame:
    """``files(path, checksum, ...)`` with ``changed``: their checksum is not the recorded one."""
    known = state.select("path", F.col("checksum").alias("__known"))
    return files.join(known, "path", "left").withColumn("changed", ~F.col("checksum").eqNullSafe(F.col("__known"))).drop("__known")


def skip_unchanged(files: DataFrame, state: DataFrame, counts: DataFrame, force: bool = False, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """``files`` with ``skipped_reason``: unchanged and in the index (``counts(path, n)``), or without a readable extension."""
    rows = needs_reindex(files, state).join(counts.select("path", F.col("n").alias("__n")), "path", "left")
    same = ~F.col("changed") & (F.coalesce("__n", F.lit(0)) > 0) & F.lit(not force)
    readable = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(extensions)
    return rows.withColumn("skipped_reason", F.when(same, "no_changes_detected").when(~readable, "unsupported_extension")).drop("__n", "changed")


def mark_indexed(state: DataFrame, files: DataFrame) -> DataFrame:
    """The state with the checksums of ``files`` in place of older ones."""
    new = files.select("path", "checksum")
    return state.join(new.select("path"), "path", "left_anti").unionByName(new)


def purge_missing(state: DataFrame, files: DataFrame) -> DataFrame:
    """The state of files that are still there."""
    return state.join(files.select("path"), "path", "left_semi")


BLOCKS = "source string, path string, page int, modality string, block_no int, content string, columns array<string>, rows array<array<string>>, image binary"


def extract_blocks(files: DataFrame, parser: Callable[[bytes], list[tuple]]) -> DataFrame:
    """``BLOCKS`` of files by ``parser``, which gives (page, modality, what is there) of a file's bytes.

    What is there: a text; for ``tables`` also a pair of column names and rows; for ``images`` also the image's bytes. A file that
    the parser can't read gives no rows; blank texts are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.binary())
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = parser(content)
                except Exception:  # noqa: BLE001  a broken file must not end the job
                    found = []
                for i, (page, modality, what) in enumerate(found):
                    row = [path.rpartition("/")[2], path, page, modality, i, None, None, None, None]
                    if isinstance(what, bytes):
                        row[8] = what
                    elif isinstance(what, tuple):
                        row[6], row[7] = [str(c) for c in what[0]], [[None if c is None else str(c) for c in r] for r in what[1]]
                    elif what and what.strip():
                        row[5] = what
                    else:
                        continue
                    out.append(row)
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in BLOCKS.split(", ")])

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def with_tables(blocks: DataFrame) -> DataFrame:
    """Tables as text: their content between bars, and a summary."""
    table = F.col("columns").isNotNull()
    content = F.when(table, table_markdown(F.col("columns"), F.col("rows"))).otherwise(F.col("content"))
    return blocks.withColumns({"content": content, "table_summary": F.when(table, table_summary(F.col("columns"), F.col("rows")))}).drop("columns", "rows")


def with_recognised(blocks: DataFrame, recogniser: Callable[[bytes, str | None], list[tuple[str, str, float]]] | None, hint: str | None = None) -> DataFrame:
    """The text of images by ``recogniser``, which gives (engine, text, confidence) of an image and a language hint.

    Of several results one is chosen as ``recognition.arbitrate`` does; images without text, or without a recogniser, are left out.
    """
    rest = blocks.where("image is null").drop("image").withColumns({"ocr_confidence": F.lit(None).cast("double"), "language": F.lit(None).cast("string")})
    if recogniser is None:
        return rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = list(zip(*(batch.column(c).to_pylist() for c in ("path", "page", "block_no")), strict=True)), []
            for (path, page, block), image in zip(keys, batch.column("image").to_pylist(), strict=True):
                try:
                    found = recogniser(image, hint)
                except Exception:  # noqa: BLE001  an image that can't be read has no text
                    found = []
                out += [(f"{path}\n{page}\n{block}", engine, i, text, confidence, hint) for i, (engine, text, confidence) in enumerate(found)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["image_id", "engine", "candidate", "text", "confidence", "hint"])

    images = blocks.where("image is not null")
    results = images.select("path", "page", "block_no", "image").mapInArrow(run, "image_id string, engine string, candidate int, text string, confidence double, hint string")
    read = recognised_blocks(results).select("image_id", "content", F.col("confidence").alias("ocr_confidence"), "language")
    name = F.concat_ws("\n", "path", F.coalesce(F.col("page").cast("string"), F.lit("None")), F.col("block_no").cast("string"))
    return rest.unionByName(images.drop("image", "content").withColumn("image_id", name).join(read, "image_id").drop("image_id"))


def text_parser(content: bytes) -> list[tuple]:
    """Plain text; form feeds divide pages."""
    return [(i, "text", page) for i, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1)]
