"""What is kept so that it isn't made twice: vectors of texts, and results of queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import embed_column, of_width
from ..staging import stage

VECTORS = "digest string, vector array<float>"


def digest(text: Column) -> Column:
    """The address of a text: of null as of an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], schema)


class VectorStore:
    """Vectors by the digest of their text, under a name for the model. Texts that are known don't go to the model again."""

    def __init__(self, spark: SparkSession, path: str, model: Callable[[list[str]], list[list[float]]] | None = None, name: str = "default", width: int | None = None):
        self._spark, self._model, self._width, self._path = spark, model, width, f"{path.rstrip('/')}/model={name}"

    def read(self) -> DataFrame:
        return _read(self._spark, self._path, VECTORS)

    def embed(self, rows: DataFrame, text: str, vector: str) -> DataFrame:
        """``rows`` (of a written table) with the vectors of a text column.

        Each different text that is not known is embedded once and added; then all are joined by digest. Two writers may both add a
        text; readers take one of the two.
        """
        named = rows.withColumn("__digest", digest(F.col(text)))
        known = self.read().select("digest")
        new = named.select(F.col("__digest").alias("digest"), F.coalesce(text, F.lit("")).alias("text")).join(known, "digest", "left_anti").dropDuplicates(["digest"])
        new = embed_column(new, "text", "vector", self._model)
        if self._width is not None:
            new = new.withColumn("vector", of_width(F.col("vector"), self._width))
        new = stage(new.select("digest", "vector"), "vectors")
        new.write.mode("append").parquet(self._path)
        held = self.read().dropDuplicates(["digest"]).select(F.col("digest").alias("__digest"), F.col("vector").alias(vector))
        return named.drop(*([vector] if vector in rows.columns else [])).join(held, "__digest", "left").drop("__digest")


class ResultCache:
    """Results of queries by the digest of their text and settings, and by the version of the index that they come from.

    A result counts for ``seconds`` and for that version only, so results of an index that has changed go stale by themselves.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self._spark, self._path, self._seconds, self._clock = spark, path, seconds, clock

    def _held(self, version: int, now: datetime) -> DataFrame | None:
        """``digest, made, hits`` that count now; None if nothing has been kept yet."""
        try:
            rows = self._spark.read.parquet(self._path)
        except AnalysisException:
            return None
        return rows.where((F.col("version") == version) & self._fresh(now)).select("digest", "made", "hits")

    def _fresh(self, now: datetime) -> Column:
        return F.col("made") > F.lit(now - timedelta(seconds=self._seconds))

    def answer(self, queries: DataFrame, version: int, find: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
        """What ``find`` gives for ``queries(query_id, query)``: rows with a query_id. It is only asked what is not kept, each different query once.

        A query's hits are gathered to be kept, as many as ``find`` gives for one; a query without hits is kept too.
        """
        named = digest(F.concat(F.lit(settings), F.lit("\n"), F.coalesce("query", F.lit(""))))
        asked, now = stage(queries.select("query_id", "query", named.alias("digest")), "asked"), self._clock()
        held = self._held(version, now)
        missing = asked if held is None else asked.join(held.select("digest"), "digest", "left_anti")
        missing = stage(missing.groupBy("digest").agg(F.min(F.struct("query_id", "query")).alias("q")).select("digest", "q.query_id", "q.query"), "missing")
        if held is None or not missing.isEmpty():
            found = find(missing.select("query_id", "query"))
            kept = found.groupBy("query_id").agg(F.collect_list(F.struct(*(c for c in found.columns if c != "query_id"))).alias("hits"))
            rows = missing.join(kept, "query_id", "left").select("digest", F.lit(version).cast("long").alias("version"), F.lit(now).alias("made"), F.coalesce("hits", F.array().cast(kept.schema["hits"].dataType)).alias("hits"))
            rows.write.mode("append").parquet(self._path)
            held = self._held(version, now)
        latest = held.groupBy("digest").agg(F.max_by("hits", "made").alias("hits"))
        return asked.join(latest, "digest").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*")

    def forget(self, version: int) -> None:
        """Write the table anew without what is of older versions or has expired."""
        rows = self._spark.read.parquet(self._path)
        keep = rows.where((F.col("version") >= version) & self._fresh(self._clock()))
        stage(keep, "kept").write.mode("overwrite").parquet(self._path)
