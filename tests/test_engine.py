"""Links, keywords, fusion, selection, state and the whole engine on small cases."""

import pytest
from pyspark.sql import functions as F

from lodestream.config import EngineConfig
from lodestream.operators import ask, fusion, keywords, linking, recognition, search
from lodestream.plans.engine import Engine
from lodestream.sources import files
from lodestream.streaming.watch import changed_files, watch


def test_links(spark):
    rows = [("s", 1, "text", 0, 0, "a0"), ("s", 1, "text", 0, 1, "a1"), ("s", 1, "tables", 0, 0, "t0"), ("s", 2, "images", 0, 0, "i0"), ("s", 4, "text", 0, 0, "d0"), ("p", None, "images", 0, 0, "lone")]
    got = {r["chunk_id"]: r for r in linking.link_chunks(spark.createDataFrame(rows, "source string, page int, modality string, block_no int, chunk_index int, chunk_id string")).collect()}
    want = {"a0": (["a1", "t0"], ["i0"], True, False, 3), "a1": (["a0", "t0"], ["i0"], True, False, 3), "t0": (["a0", "a1"], ["i0"], True, False, 3), "i0": ([], ["a0", "a1", "t0"], False, True, 1), "d0": ([], [], False, False, 1), "lone": ([], [], False, False, 0)}
    assert {k: (r["sibling_chunk_ids"], r["adjacent_chunk_ids"], r["has_table_on_page"], r["has_image_on_page"], r["page_chunk_count"]) for k, r in got.items()} == want
    assert sum(r["n_links"] for r in got.values()) == 12


def test_keywords(spark):
    rows = [(1, "a", "spark window join window"), (1, "b", "spark stream join"), (1, "c", "spark vector index"), (2, "d", "only one")]
    got = keywords.tfidf_keywords(spark.createDataFrame(rows, "batch int, chunk_id string, content string"), ["batch"], stopwords=["the", "is", "a", "of", "and"]).orderBy("chunk_id", "rank").collect()
    lists = {}
    for r in got:
        lists.setdefault(r["chunk_id"], []).append((r["keyword"], r["weight"]))
    assert lists["a"] == [("window", 0.726509), ("window join", 0.363255), ("spark window", 0.363255), ("join window", 0.363255), ("join", 0.276265)]
    assert lists["b"] == [("stream join", 0.528635), ("stream", 0.528635), ("spark stream", 0.528635), ("join", 0.40204)]
    assert "d" not in lists


def test_rrf(spark):
    hits = lambda names: spark.createDataFrame([(1, c, i) for i, c in enumerate(names, 1)], "query_id int, chunk_id string, rank int")
    got = fusion.rrf(hits("ABC"), hits("BDA"), ["query_id", "chunk_id"]).collect()
    assert {r["chunk_id"]: r["score"] for r in got} == {"B": 0.01626124, "A": 0.01613323, "D": 0.00806452, "C": 0.00793651}
    swapped = fusion.rrf(hits("BDA"), hits("ABC"), ["query_id", "chunk_id"], alpha=0.5).collect()
    assert {r["chunk_id"]: r["score"] for r in got} == {r["chunk_id"]: r["score"] for r in swapped}


@pytest.mark.parametrize(("query", "content", "words", "kind", "table", "image", "page", "want"), [
    ("tax rate", "The Tax Rate is 5", ["tax", "Rate", "tax rate"], "pdf_text", True, True, 1, 1.545), ("vegetable", "x", [], "pdf_table", False, False, 7, 1.15),
    ("tax", "x", [], "pdf_image", False, True, None, 1.02), ("tax", "x", ["tax"], "pdf_text", False, False, 5, 1.175), ("data", "x", [], "pdf_text", False, False, 0, 1.05), ("", "x", [], "image", False, False, None, 1.2),
])
def test_boost(spark, query, content, words, kind, table, image, page, want):
    df = spark.createDataFrame([(query, content, words, kind, table, image, page)], "q string, c string, w array<string>, k string, t boolean, i boolean, p int")
    assert df.select(F.round(fusion.boost(*map(F.col, "qcwktip")), 6)).first()[0] == want


def test_coverage_and_pages(spark):
    rows = [(1, f"k{i}", s, x) for i, (s, x) in enumerate([(0.35, "text"), (0.35, "text"), (0.016, "text"), (0.012, "tables"), (0.008, "images"), (0.007, "text")], 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, score double, source_index string")
    order = lambda k: [r["chunk_id"] for r in fusion.cover_indexes(df, k).orderBy("rank").collect()]
    assert order(10) == ["k1", "k4", "k5", "k2", "k3", "k6"] and order(4) == ["k1", "k4", "k5", "k2"] and order(2) == ["k1", "k4"]
    same = df.withColumns({"source": F.lit("s"), "page": F.lit(1), "rerank_score": F.lit(0.0)})
    assert fusion.diversify(same, ["query_id"], 6).count() == 6
    assert [r["chunk_id"] for r in fusion.diversify(same.withColumn("page", F.when(F.col("chunk_id") < "k4", 1).otherwise(2)), ["query_id"], 3, 2).orderBy("rank").collect()] == ["k1", "k2", "k4"]


def test_link_expansion(spark):
    chunks = spark.createDataFrame([("a", ["b", "c", "d", "e", "f", "g"], ["x"]), ("b", ["a"], []), *((c, [], []) for c in "cdefgx")], "chunk_id string, sibling_chunk_ids array<string>, adjacent_chunk_ids array<string>")
    hits = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.02)], "q int, chunk_id string, score double")
    got = fusion.expand_links(hits, chunks, ["q"], 3, 3).collect()
    assert sorted((r["chunk_id"], r["score"]) for r in got) == [("a", 0.01), ("b", 0.02), ("c", 0.35), ("d", 0.35), ("e", 0.35), ("x", 0.35)]


def test_variants(spark):
    answer = "- Tax Rate\n• tax percentage\n* Tax Percentage\n1. levy rate\n-- ab\n- rate of tax\n- fifth one"
    got = ask.parse_variants(spark.createDataFrame([(1, "tax rate", answer), (2, "q", None)], "query_id int, query string, answer string")).orderBy("query_id", "variant_no").collect()
    assert [r["variant"] for r in got] == ["tax rate", "tax percentage", "1. levy rate", "rate of tax", "q"]
    failing = ask.expand_queries(spark.createDataFrame([(1, "tax")], "query_id int, query string"), lambda q: 1 / 0)
    assert [r["variant"] for r in failing.collect()] == ["tax"]


def brute_phrase(text, query, slop):
    """Every choice of one position a word, no position twice: the occurrences that begin at s count by their smallest spread."""
    from itertools import product

    words, asked = text.lower().split(), query.lower().split()
    places = [[i for i, w in enumerate(words) if w == a] for a in asked]
    best = {}
    for choice in product(*places):
        begins = [c - k for k, c in enumerate(choice)]
        if len(set(choice)) == len(choice) and max(begins) - min(begins) <= slop:
            best[min(begins)] = min(best.get(min(begins), 99), max(begins) - min(begins))
    return round(sum(1 / (1 + d) for d in best.values()), 6)


def test_phrases_against_every_choice(spark):
    import random

    draw = random.Random(4)
    texts = [" ".join(draw.choice("alpha beta gamma x y".split()) for _ in range(14)) for _ in range(60)]
    texts += ["alpha x x beta gamma", "beta alpha", "alpha beta gamma", "gamma x x x alpha beta"]
    asked = ["alpha beta", "alpha beta gamma", "gamma beta", "alpha"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    terms = search.index_terms(chunks, by=[])
    found = search.phrase_matches(terms, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), []).collect()
    want = {(q, f"c{i}"): brute_phrase(t, a, 2) for q, a in enumerate(asked) for i, t in enumerate(texts)}
    assert {(r["query_id"], r["chunk_id"]): r["freq"] for r in found} == {k: v for k, v in want.items() if v}
    assert want[1, "c60"] > 0 and want[1, "c63"] == 0 and want[0, "c61"] > 0


def test_full_text_takes_the_best_field_and_phrases(spark):
    rows = [("a", "solar power plants", ["tax rate"], None, "x.txt"), ("b", "plants and power and other solar things far away from it", [], "Table with solar power", "solar.txt"), ("c", "nothing of it", ["solar power"], None, "y.txt"), ("d", "solr panels", [], None, "z.txt")]
    chunks = spark.createDataFrame([("text", *r) for r in rows], "source_index string, chunk_id string, content string, keywords array<string>, table_summary string, source string")
    terms = search.index_terms(chunks)
    ask = spark.createDataFrame([(1, "solar power")], "query_id int, query string")
    found = {r["chunk_id"]: r["score"] for r in search.full_text(terms, ask).collect()}
    assert set(found) == {"a", "b", "c", "d"} and max(found, key=found.get) == "a"
    plain = {r["chunk_id"] for r in search.full_text(terms, ask, fuzzy=False).collect()}
    assert plain == {"a", "b", "c"}


def test_cells_find_nine_tenths_and_all_of_them_everything(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("content_vector"))
    asked = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content_vector").alias("vector"))
    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = pairs(search.knn(vectors, asked))
    assert len(exact & pairs(search.cell_knn(vectors, asked, share=0.6))) >= 0.9 * len(exact)
    assert pairs(search.cell_knn(vectors, asked, share=1.0)) == exact
    few = search.cell_knn(vectors, asked, share=0.001).groupBy("query_id").count().collect()
    assert all(r["count"] == 30 for r in few)


def test_fuzzy_terms(spark):
    terms = spark.createDataFrame([("spark",), ("retrieval",), ("ab",)], "term string")
    words = spark.createDataFrame([("sparks",), ("spork",), ("sprk",), ("spo",), ("retreival",), ("retrieve",), ("abc",), ("ab",)], "word string")
    assert {(r["term"], r["match"]) for r in search.fuzzy_terms(terms, words).collect()} == {("spark", "sparks"), ("spark", "spork"), ("spark", "sprk"), ("retrieval", "retreival"), ("retrieval", "retrieve"), ("ab", "ab")}


def test_knn_blocks_of_queries(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(50)] + [(99, None), (98, [0.0, 0.0, 0.0])], "chunk_id long, content_vector array<double>")
    asked = vectors.where("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), F.col("content_vector").alias("vector"))
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    want = key(search.knn(vectors, asked, 5))
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert key(search.knn(vectors, asked, 5)) == want and len(want) == 45


def test_recognition(spark):
    rows = [(1, "en", 0, "hello there", 0.5, None), (1, "dev", 0, "क", 0.9, None), (2, "en", 0, "x", 0.1, "hi"), (2, "dev", 0, "यह है और", 0.0, "hi"), (3, "en", 0, "12", 0.2, None), (3, "en", 1, "13", 0.2, None), (3, "dev", 0, "१२", 0.3, "auto"), (4, "en", 0, " ", 0.2, None), (4, "dev", 0, "", 0.1, None)]
    df = spark.createDataFrame(rows, "image_id int, engine string, candidate int, text string, confidence double, hint string")
    got = {r["image_id"]: (r["engine"], r["language"], r["text"]) for r in recognition.arbitrate(df).collect()}
    assert got == {1: ("dev", "hi", "क"), 2: ("dev", "hi", "यह है और"), 3: ("dev", "mr", "१२"), 4: ("en", "en", " ")}
    assert {r["image_id"] for r in recognition.recognised_blocks(df).collect()} == {1, 2, 3}


def test_engine_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Solar panels turn light into power. " * 40 + "\f" + "Wind turbines need wind. " * 40)
    (folder / "b.txt").write_text("Tax rates are set by law. " * 40)
    (folder / "c.bin").write_text("x")
    engine = Engine(spark, str(tmp_path / "engine"), EngineConfig())
    scan = lambda: files.scan(spark, str(folder))
    report = {r["path"].rpartition("/")[2]: r["skipped_reason"] for r in engine.ingest(scan()).collect()}
    assert report == {"a.txt": None, "b.txt": None, "c.bin": "unsupported_extension"}
    many = engine.store.read().count()
    assert many > 3
    report = {r["path"].rpartition("/")[2]: r["skipped_reason"] for r in engine.ingest(scan()).collect()}
    assert report["a.txt"] == report["b.txt"] == "no_changes_detected"
    engine.ingest(scan(), force=True)
    assert engine.store.read().count() == many
    queries = spark.createDataFrame([(1, "solar panels power"), (2, "tax rates")], "query_id long, query string")
    found = engine.retrieve(queries).where("rank = 1").collect()
    assert {r["query_id"]: r["source"] for r in found} == {1: "a.txt", 2: "b.txt"}
    answers = {r["query_id"]: r["answer"] for r in engine.ask(queries).collect()}
    assert "Source: a.txt" in answers[1] and "Source: b.txt" in answers[2]
    assert engine.delete("a.txt") > 0 and {r["source"] for r in engine.store.read().select("source").distinct().collect()} == {"b.txt"}
    assert engine.status()["sources"] == 1
    (folder / "b.txt").write_text(" ")
    engine.ingest(scan())
    assert engine.store.read().where("source = 'b.txt'").count() == engine.store.read_terms().where("source = 'b.txt'").count() == 0
    breakdown = found[0]["score_breakdown"]
    assert breakdown["bm25_rrf"] > 0 or breakdown["knn_rrf"] > 0


def test_tables_and_images_are_indexed_and_replaced(spark, tmp_path):
    def parser(content):
        if content == b"later":
            return [(1, "text", "Only text is left on this page now. " * 10)]
        return [(1, "text", "Words about rivers and lakes. " * 10), (1, "tables", (["name", "depth"], [["lake", 9], ["pond", None]] * 12)), (2, "images", b"dark"), (2, "images", b"clear")]

    def recogniser(image, hint):
        return [] if image == b"dark" else [("en", "Recognised words of a scanned page. " * 6, 0.8), ("dev", "", 0.1)]

    engine = Engine(spark, str(tmp_path / "engine"), EngineConfig(), parser=parser, recogniser=recogniser, extensions=["pdf"])
    scan = lambda text: spark.createDataFrame([("/in/r.pdf", text, f"sum {text}"), ("/in/t.txt", b"x", "t")], "path string, content binary, checksum string")
    engine.ingest(scan(b"first"))
    rows = engine.store.read().collect()
    assert {r["source_index"] for r in rows} == {"text", "tables", "images"} and {r["content_type"] for r in rows} == {"pdf_text", "pdf_table", "pdf_image"}
    assert all(r["document_id"].startswith("doc_r_") for r in rows) and {r["ocr_confidence"] for r in rows if r["source_index"] == "images"} == {0.8}
    table = next(r for r in rows if r["source_index"] == "tables")
    assert table["table_summary"] == "Table with 24 rows and columns: name, depth" and table["content"].startswith("| name | depth |") and table["has_image_on_page"] is False
    engine.ingest(scan(b"later"))
    assert {r["source_index"] for r in engine.store.read().collect()} == {"text"} == {r["source_index"] for r in engine.store.read_terms().collect()}
    engine.reindex(scan(b"first"))
    assert engine.status() == {"status": "ready", "chunks": {"text": 1, "tables": 1, "images": 1}, "sources": 1}


def test_vectors_of_another_width_are_refused(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"), EngineConfig(), embedder=lambda texts: [[1.0] * 4 for _ in texts])
    assert engine.width == 4
    engine._embedder = lambda texts: [[1.0] * 5 for _ in texts]
    with pytest.raises(Exception, match="a vector of 4 numbers was expected, not 5"):
        engine.ingest_blocks(spark.createDataFrame([("s", 1, "text", 0, "some words here " * 20)], "source string, page int, modality string, block_no int, content string"))


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    for i in range(3):
        files.save_state(spark.createDataFrame([("a", str(i))], files.STATE), path)
        assert [tuple(r) for r in files.load_state(spark, path).collect()] == [("a", str(i))]
    (tmp_path / "state" / "v2" / "_SUCCESS").unlink()  # as if the write had been cut off
    assert [tuple(r) for r in files.load_state(spark, path).collect()] == [("a", "1")]


def test_watch_sees_new_files_and_state_sees_changed_ones(spark, tmp_path):
    folder, seen = tmp_path / "w", []
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    state = str(tmp_path / "state")

    def ingest(batch):
        rows = batch.select("path", "checksum").collect()
        seen.extend(r["path"].rpartition("/")[2] for r in rows)
        if len(seen) == 1:
            raise ValueError("a batch that fails does not end the watch")

    def turn():
        watch(spark, str(folder), str(tmp_path / "cp"), ingest, once=True, pattern="*.txt").awaitTermination()

    turn()
    (folder / "b.txt").write_text("two")
    turn()
    assert sorted(seen) == ["a.txt", "b.txt"]
    files.save_state(files.scan(spark, str(folder)).select("path", "checksum"), state)
    assert changed_files(spark, str(folder), state).count() == 0
    (folder / "a.txt").write_text("changed")
    assert [r["path"].rpartition("/")[2] for r in changed_files(spark, str(folder), state).select("path").collect()] == ["a.txt"]


def test_watch_sees_overwritten_and_moved_files(spark, tmp_path):
    import os

    from lodestream.streaming.watch import watch_changes

    folder, seen = tmp_path / "w", []
    folder.mkdir()
    (folder / "a.txt").write_text("one")

    def ingest(batch):
        rows = sorted((r["path"].rpartition("/")[2], bytes(r["content"]).decode()) for r in batch.select("path", "content").collect())
        seen.append(rows)
        if len(seen) == 1:
            raise ValueError("a batch that fails does not end the watch")

    def turn():
        watch_changes(spark, str(folder), str(tmp_path / "cp"), ingest, once=True, pattern="*.txt").awaitTermination()
        return seen.pop() if len(seen) > 1 else None

    turn()
    assert seen == [[("a.txt", "one")]] and turn() is None
    (folder / "b.txt").write_text("two")
    assert turn() == [("b.txt", "two")]
    (folder / "a.txt").write_text("one, overwritten")
    assert turn() == [("a.txt", "one, overwritten")]
    (tmp_path / "old.txt").write_text("moved here with an old time")
    os.utime(tmp_path / "old.txt", (1, 1))
    os.rename(tmp_path / "old.txt", folder / "c.txt")
    os.rename(folder / "b.txt", folder / "d.txt")
    assert turn() == [("c.txt", "moved here with an old time"), ("d.txt", "two")]
    (folder / "a.txt").unlink()
    assert turn() is None
    (folder / "a.txt").write_text("again")
    assert turn() == [("a.txt", "again")]


def test_broken_state_falls_back(spark, tmp_path):
    path = tmp_path / "state"
    for i in range(2):
        files.save_state(spark.createDataFrame([("a", str(i))], files.STATE), str(path))
    for part in (path / "v1").glob("*.parquet"):
        part.write_bytes(b"PAR1 not any more")
    for crc in (path / "v1").glob(".*.crc"):
        crc.unlink()
    assert [tuple(r) for r in files.load_state(spark, str(path)).collect()] == [("a", "0")]
    files.save_state(files.load_state(spark, str(path)), str(path))
    assert [tuple(r) for r in files.load_state(spark, str(path)).collect()] == [("a", "0")]


def counting(log):
    """A model that writes down what it was asked."""

    def embed(texts):
        with open(log, "a") as out:
            out.writelines(f"{len(t)}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_texts_are_embedded_once(spark, tmp_path):
    from lodestream.sources.remembered import VectorStore

    log = tmp_path / "log"
    store = VectorStore(spark, str(tmp_path / "vectors"), counting(log))
    rows = spark.createDataFrame([(1, "one"), (2, "three"), (3, None), (4, "one"), (5, "")], "id int, text string")
    want = {1: [3.0, 1.0], 2: [5.0, 1.0], 3: [0.0, 1.0], 4: [3.0, 1.0], 5: [0.0, 1.0]}
    for _ in range(2):
        assert {r["id"]: r["v"] for r in store.embed(rows, "text", "v").collect()} == want
        assert sorted(log.read_text().split()) == ["0", "3", "5"]
    store.embed(rows.limit(1).withColumn("text", F.lit("seven77")), "text", "v").collect()
    assert sorted(log.read_text().split()) == ["0", "3", "5", "7"]
    with pytest.raises(Exception, match="a vector of 3 numbers was expected, not 2"):
        VectorStore(spark, str(tmp_path / "vectors"), counting(log), "other", 3).embed(rows, "text", "v").collect()
    assert VectorStore(spark, str(tmp_path / "vectors"), name="other").read().count() == 0


def test_a_second_ingest_asks_the_model_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Solar panels turn light into power. " * 30)
    log = tmp_path / "log"
    engine = Engine(spark, str(tmp_path / "engine"), EngineConfig(), embedder=counting(log))
    engine.ingest(files.scan(spark, str(tmp_path / "in")))
    asked = log.read_text()
    engine.ingest(files.scan(spark, str(tmp_path / "in")), force=True)
    assert log.read_text() == asked and engine.store.read().where("content_vector is null").count() == 0


def test_results_are_kept_for_a_version_and_a_time(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from lodestream.sources.remembered import ResultCache

    now, asked = [datetime(2026, 1, 1, tzinfo=timezone.utc)], []

    def find(queries):
        rows = queries.collect()
        asked.append(sorted(r["query"] for r in rows))
        return spark.createDataFrame([(r["query_id"], f"{r['query']} {i}", i) for r in rows for i in range(0 if r["query"] == "none" else 2)], "query_id long, hit string, rank int")

    cache = ResultCache(spark, str(tmp_path / "results"), 60, lambda: now[0])
    queries = lambda *q: spark.createDataFrame(list(enumerate(q)), "query_id long, query string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    want = [(0, "a 0", 0), (0, "a 1", 1), (1, "b 0", 0), (1, "b 1", 1), (3, "a 0", 0), (3, "a 1", 1)]
    assert got(cache.answer(queries("a", "b", "none", "a"), 1, find)) == want and asked.pop() == ["a", "b", "none"]
    assert got(cache.answer(queries("a", "b", "none", "a"), 1, find)) == want and not asked
    assert got(cache.answer(queries("c", "a"), 1, find)) == [(0, "c 0", 0), (0, "c 1", 1), (1, "a 0", 0), (1, "a 1", 1)] and asked.pop() == ["c"]
    cache.answer(queries("a"), 2, find)
    assert asked.pop() == ["a"]  # the index has changed
    cache.answer(queries("a"), 1, find, "other settings")
    assert asked.pop() == ["a"]
    now[0] += timedelta(seconds=61)
    assert got(cache.answer(queries("a"), 1, find)) == want[:2] and asked.pop() == ["a"]  # the kept result has expired
    cache.forget(2)
    assert spark.read.parquet(str(tmp_path / "results")).count() == 0


def test_engine_keeps_results(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"), EngineConfig())
    block = lambda text: spark.createDataFrame([("s", 1, "text", 0, text * 20)], "source string, page int, modality string, block_no int, content string")
    engine.ingest_blocks(block("solar power "))
    queries = spark.createDataFrame([(1, "solar")], "query_id long, query string")
    first = engine.retrieve_kept(queries).select("content", "score").collect()
    assert engine.retrieve_kept(queries).select("content", "score").collect() == first and first[0]["content"].startswith("solar")
    engine.ingest_blocks(block("solar wind "))
    assert "wind" in engine.retrieve_kept(queries).first()["content"]


def test_asking_rewrites_once(spark, tmp_path):
    """A model that never says the same twice: the prompt names the phrasings that were searched."""
    log = tmp_path / "log"

    def rewrite(text):
        with open(log, "a") as out:
            out.write(f"{text}\n")
        return f"solar energy {len(log.read_text())}"

    engine = Engine(spark, str(tmp_path / "engine"), EngineConfig(), rewrite=rewrite, model=lambda prompt: prompt)
    engine.ingest_blocks(spark.createDataFrame([("s", 1, "text", 0, "solar power " * 20)], "source string, page int, modality string, block_no int, content string"))
    answer = engine.ask(spark.createDataFrame([(1, "solar")], "query_id long, query string")).first()["answer"]
    assert log.read_text() == "solar\n" and "Other phrasings: solar, solar energy" in answer and "solar power" in answer
