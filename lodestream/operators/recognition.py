"""Choosing between results of text recognition, which come as a table: no recognition model is part of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_language, devanagari_ratio, language_hint, latin_ratio, strip, text_quality


def best_candidate(results: DataFrame) -> DataFrame:
    """Of ``results(image_id, engine, candidate, text, confidence)`` the surest one of each image and engine; the first if equal."""
    order = Window.partitionBy("image_id", "engine").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "candidate")
    return results.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def merge_results(results: DataFrame) -> DataFrame:
    """Of ``results(image_id, candidate, text, confidence, language)`` the best by 0.6 confidence + 0.4 text quality; lone ones as they are."""
    score = F.round(0.6 * F.col("confidence") + 0.4 * text_quality(F.col("text")), 6)
    order = Window.partitionBy("image_id").orderBy(F.desc(score), "candidate")
    return results.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def mean_confidence(pieces: DataFrame) -> DataFrame:
    """``image_id, confidence``: the mean of the pieces that have one, else 0."""
    return pieces.groupBy("image_id").agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"))


def arbitrate(results: DataFrame) -> DataFrame:
    """``image_id, engine, text, language, confidence`` of images with a result of the engines ``en`` and ``dev`` and a hint.

    A hint decides; else the script that prevails in its own engine's text; else the surer result, the English one if equal.
    """
    best = best_candidate(results)
    en = best.where("engine = 'en'").select("image_id", "hint", F.col("text").alias("en_text"), F.col("confidence").alias("en_conf"))
    dev = best.where("engine = 'dev'").select("image_id", F.col("text").alias("dev_text"), F.col("confidence").alias("dev_conf"))
    both = en.join(dev, "image_id", "full_outer").withColumns({"hint": language_hint(F.col("hint")), "dr": devanagari_ratio(F.col("dev_text")), "er": latin_ratio(F.col("en_text"))})
    dev_wins = (
        F.when(F.col("hint").isin("mr", "hi"), True).when(F.col("hint") == "en", False)
        .when((F.col("dr") > 0.1) & (F.col("dr") > F.col("er")), True).when(F.col("er") > F.col("dr"), False)
        .otherwise(F.coalesce(F.col("dev_conf"), F.lit(0.0)) > F.coalesce(F.col("en_conf"), F.lit(0.0)))
    )
    found = detect_language(F.col("dev_text"))
    language = F.when(~dev_wins, "en").when(F.col("hint").isNotNull(), F.col("hint")).when(found.isin("mr", "hi"), found).otherwise("mr")
    rows = both.withColumn("d", dev_wins)
    pick = lambda a, b: F.when(F.col("d"), F.col(a)).otherwise(F.col(b))
    return rows.select("image_id", F.when(F.col("d"), "dev").otherwise("en").alias("engine"), pick("dev_text", "en_text").alias("text"), language.alias("language"), pick("dev_conf", "en_conf").alias("confidence"))


def recognised_blocks(results: DataFrame) -> DataFrame:
    """Arbitrated results that have text, as blocks for chunking; blank ones are left out."""
    return arbitrate(results).where(F.coalesce(strip(F.col("text")), F.lit("")) != "").withColumnRenamed("text", "content")
