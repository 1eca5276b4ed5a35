"""Text functions on fixed cases."""

import pytest
from pyspark.sql import functions as F

from lodestream.functions import chunking, text

CLEAN = [
    ("en", "The corner  store ,open", "The comer store, open"), ("en", "cleanup the vvorld", "deanup the world"), ("en", "l am here 0range x 5 b", "I am here Orange 5"),
    ("en", "a\n\n\n\nb ok\n\n\n\nend", "a\n\nok\n\nend"), ("en", "wait.... what,,, now", "wait... what, now"), ("en", "line one\n. line two", "line one. line two"),
    ("en", "bell\x07 tab\there\x7f", "bell tab here"), ("en", "e.g. http://x.io/a:b 3.14", "e. g. http: //x. io/a: 3.14"), ("en", "rnrn internrn", "rnm internm"),
    ("en", "naïvern éclat", "naïvem édat"), ("en", "   ", ""), ("en", None, ""), ("hi", "राम।।घर 10 l", "राम। घर 1० ।"), ("mr", "क ट अ बर", "क अ बर"), ("hi", "हि ंदी", "हिंदी"),
]
QUALITY = [("", 0), ("short", 0.5), ("A proper sentence.", 1.0), ("a b c d e f g h", 0.5), ("!!!###$$$%%%", 0.0), ("Hi.", 0.366667), ("नमस्ते दुनिया।", 0.628571), ("a b c d e f word.", 0.628571)]
SIMILAR = [("the quick brown fox", "the quick red fox", 0.602975), ("same text", "same text", 1.0), ("alpha beta", "gamma delta", 0.0), ("a b c", "d e f", 0.0), ("", "x", 0.0), ("go go stop", "go stop stop", 0.8)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("language", "given", "want"), CLEAN)
def test_clean(spark, language, given, want):
    assert one(spark, text.clean(F.lit(given).cast("string"), language)) == want


@pytest.mark.parametrize(("given", "want"), QUALITY)
def test_quality(spark, given, want):
    assert one(spark, F.round(text.text_quality(F.lit(given)), 6)) == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize(("a", "b", "want"), SIMILAR)
def test_similarity(spark, a, b, want):
    assert one(spark, text.text_similarity(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("given", "want"), [("", "unknown"), ("the cat is on the mat and it was here", "en"), ("यह एक वाक्य है और वह भी", "hi"), ("हे पुस्तक आहे आणि ती पण", "mr"), ("lorem ipsum dolor", "unknown")])
def test_language(spark, given, want):
    assert one(spark, text.detect_language(F.lit(given))) == want


def test_language_hint(spark):
    assert [one(spark, text.language_hint(F.lit(h).cast("string"))) for h in (" HI ", "auto", "", None, "fr", "en")] == ["hi", None, None, None, None, "en"]


def test_ratios_and_stopwords(spark):
    assert one(spark, text.latin_ratio(F.lit("abcé"))) == 0.75 and one(spark, text.devanagari_ratio(F.lit("कखab"))) == 0.5
    assert "cat" in one(spark, text.without_stopwords(text.tok_word(F.lit("The cat over the hat"))))


@pytest.mark.parametrize(("given", "size", "overlap", "want"), [
    ("aaa bbb ccc ddd eee", 10, 4, ["aaa bbb", "bbb ccc", "ccc ddd", "ddd eee"]), ("One. Two. Three. Four.", 12, 5, ["One. Two", ". Two. Three", ". Four."]), ("x" * 1000, 800, 200, ["x" * 1000]),
])
def test_split(given, size, overlap, want):
    assert list(chunking.split_text(given, size, overlap, chunking.SEPARATORS)) == want


def test_chunks(spark):
    assert [len(x) for x in chunking.split_text("word " * 400, 800, 200, chunking.SEPARATORS)] == [799, 799, 799, 199]
    blocks = spark.createDataFrame([("f.pdf", 1, "word " * 400), ("g.pdf", None, "Short text."), ("h.pdf", 2, None)], "source string, page int, content string")
    rows = chunking.chunk_blocks(blocks).withColumn("id", chunking.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("content"))).collect()
    assert [(r["source"], r["chunk_index"], r["total_chunks"]) for r in rows] == [("f.pdf", i, 4) for i in range(4)]
    assert rows[0]["id"] == "f.pdf:p1:c0:0666047a"


def test_chunk_totals(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    chunks = chunking.chunk_blocks(docs)
    row = chunks.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.max(F.length("content")).alias("m")).first()
    assert (row["n"], docs.count() - row["d"], row["m"]) == (933, 7, 800)


def test_similarities_of_a_table(spark):
    rows = [(1, 1, "a red fish swims", "the red fish"), (1, 2, "red", None), (2, 1, "", "x"), (2, 2, "same words same", "same words same"), (3, 1, "one two", "three four")]
    pairs = spark.createDataFrame(rows, "conv long, turn long, a string, b string").repartition(3, "conv")
    found = text.text_similarities(pairs, ["conv", "turn"], "a", "b")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the one of the input
    want = pairs.select("conv", "turn", text.text_similarity(F.col("a"), F.col("b")).alias("s"))
    assert {(r[0], r[1]): r[2] for r in found.collect()} == {(r[0], r[1]): pytest.approx(r[2], abs=1e-9) for r in want.collect()}


def test_strip_takes_all_white_space_and_no_other(spark):
    spaces = text._SPACES
    rows = [(spaces + "a" + spaces + "b" + spaces,), ("​x​",), (spaces,), ("",), (None,), ("x \n",), ("\ny",)]
    got = spark.createDataFrame(rows, "t string").select("t", text.strip(F.col("t")).alias("s"), F.regexp_replace("t", f"^{text.WS}+|{text.WS}+$", "").alias("want"))
    assert "regexp" not in got.select("s")._jdf.queryExecution().optimizedPlan().toString()  # looking at every character took a fifth of the cleaning
    assert all(r["s"] == r["want"] for r in got.collect())
    assert spark.range(1).select(F.lit(spaces).rlike(f"^{text.WS}+$")).first()[0]
