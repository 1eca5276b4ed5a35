"""Languages by n-gram profiles: probabilities against plain counting, and held-out documents."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lodestream.operators import language_model
from lodestream.plans.engine import Engine

TEXTS = [("the cat sat on the mat", "en"), ("the hat", "en"), ("le chat et le chapeau", "fr"), ("मांजर बसले आहे", "mr"), (None, "fr"), ("no language", None)]


def grams(text):
    low = f" {text.lower()} "
    return [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)]


def test_probabilities_against_plain_counts(spark):
    """N-grams counted by name; of these few none share a bucket."""
    model = language_model.fit(spark.createDataFrame(TEXTS, "text string, lang string"))
    assert model.languages == ["en", "fr", "mr"]
    named = {g: int(b) for text, _ in TEXTS if text for g, b in zip(grams(text), language_model.buckets(text), strict=True)}
    assert len(set(named.values())) >= len(named) - 2
    profiles = {lang: Counter(named[g] for text, own in TEXTS if own == lang and text for g in grams(text)) for lang in model.languages}
    size = 1 << language_model.BITS
    for text in ("the cat", "le chat", "chat on the mat", "t"):
        logs = [sum(math.log((profiles[lang][b] + 1) / (sum(profiles[lang].values()) + size)) for b in language_model.buckets(text).tolist()) for lang in model.languages]
        likely = [math.exp(x - max(logs)) for x in logs]
        assert all(abs(p - x / sum(likely)) < 1e-9 for p, x in zip(model.posteriors(text), likely, strict=True))
    rows = spark.createDataFrame([(1, "the mat"), (2, "le chapeau"), (3, " "), (4, None), (5, "मांजर"), (6, "x" * 100_000)], "id int, text string")
    found = {r["id"]: r["d"] for r in rows.select("id", model.detect(F.col("text")).alias("d")).collect()}
    assert [found[i]["language"] for i in range(1, 6)] == ["en", "unknown", "unknown", "unknown", "mr"]  # French is not supported
    assert found[3]["probability"] == found[4]["probability"] == 0 and found[1]["probability"] > 0.5
    nothing = language_model.fit(spark.createDataFrame([], "text string, lang string"))
    assert rows.select(nothing.detect(F.col("text"))["language"].alias("l")).distinct().collect()[0]["l"] == "unknown"


def test_held_out_documents(spark):
    from lodestream.queries import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = queries()["language_model"](spark, "/root/testdata/sf0.01").where(held).join(docs, "doc_id").collect()
    assert len(rows) > 200 and sum(r["language"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_engine_with_a_model(spark, tmp_path):
    model = language_model.fit(spark.createDataFrame(TEXTS, "text string, lang string"))
    engine = Engine(spark, str(tmp_path / "engine"), language_model=model)
    engine.ingest_blocks(spark.createDataFrame([("s", 1, "text", 0, "मांजर बसले आहे " * 20), ("s", 2, "text", 0, "the cat sat on the mat " * 20)], "source string, page int, modality string, block_no int, content string"))
    assert {r["page"]: r["language"] for r in engine.store.read().collect()} == {1: "mr", 2: "en"}
