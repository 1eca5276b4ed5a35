"""Operators on vectors and pages, and the pipeline, against brute force."""

import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import embed_dedup, warc


def brute_links(rows, limit):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= limit
    np.fill_diagonal(linked, False)
    label = np.array([i for i, _ in good])
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(axis=1))
        if (low == label).all():
            break
        label = low
    out = {i: (0, i, True) for i, _ in rows}
    for k, (i, _) in enumerate(good):
        out[i] = (int(linked[k].sum()), int(label[k]), bool(label[k] == i))
    return out


@pytest.mark.parametrize("limit", [0.95, 0.6])
def test_near_duplicate_vectors(spark, monkeypatch, limit):
    monkeypatch.setattr(embed_dedup, "CELL", 60)
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(5)
    group = [(20_000 + i, (np.ones(64) + rng.normal(0, 0.25, 64)).tolist()) for i in range(150)]
    odd = [(10_001, None), (10_002, [0.0] * 64), (10_003, [float("nan")] + [1.0] * 63), (10_004, [None] + [1.0] * 63), (10_005, [1e-30] * 64), (10_006, [1e30] * 64), (10_007, [1.0]), (10_008, []), (10_009, [1e30] * 64)]
    df = df.unionByName(spark.createDataFrame(odd + group, df.schema)).withColumn("n_links", F.lit("x"))
    want = brute_links([(r["vec_id"], r["embedding"]) for r in df.collect()], limit)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, limit).collect()}
    assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_missing_vec_ids(spark):
    """Vectors that share a vec_id have links of their own, and a row without one has none."""
    base = np.eye(64)
    near = [(base[i] + 0.05 * base[i + 1]).tolist() for i in range(8)]
    rows = [(5, base[0].tolist()), (5, base[4].tolist()), (6, near[0]), (7, near[4]), (None, base[0].tolist()), (None, None), (9, near[6]), (9, near[6]), (3, near[6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in embed_dedup.near_duplicates(df).collect())
    assert got == Counter([(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (None, 0, None, True), (None, 0, None, True), (9, 2, 3, False), (9, 2, 3, False), (3, 2, 3, True)])


def test_hot_vectors_are_spread(spark, monkeypatch):
    from lodestream.llm import _spark

    monkeypatch.setattr(_spark, "SHARE", 10)
    one = np.eye(64)[0].tolist()
    df = spark.createDataFrame([(i, one) for i in range(100)] + [(100 + i, np.eye(64)[1 + i % 9].tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == 150 and all(got[i] == (99, 0) for i in range(100)) and all(got[100 + i][1] == 100 + i % 9 for i in range(50))


def test_links_over_borders_along_the_line_of_centres(spark, monkeypatch):
    """Vectors that vary in two directions only: differences point straight across the borders."""
    monkeypatch.setattr(embed_dedup, "CELL", 60)
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    angles = np.random.default_rng(6).uniform(0, 2 * np.pi, 600)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows + [(1000 + i, v) for i, v in rows[:9]], "vec_id long, embedding array<double>")
    want = brute_links([(r["vec_id"], r["embedding"]) for r in df.collect()], 0.95)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()} == want


def test_vectors_of_all_lengths_are_compared(spark):
    """Those with as many numbers, however few have so many."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0, 0.01]), (6, [2.0]), (7, [1.0]), (8, [-1.0]), (9, [0.0, 1.0, 0.1])]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {1: (1, 1), 5: (1, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 9: (2, 3), 6: (1, 6), 7: (1, 6), 8: (0, 8)} and len(found) == 9


@pytest.mark.parametrize("packed", [False, True])
def test_warc_round_trip(spark, tmp_path, packed):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    odd = [(9001, None, None), (9002, "a\r\nb", "x" * 100), (9003, "", "x" * 100), (9004, "", "y" * 99), (9005, "", "y" * 99), (9000, "", "x" * 100), (9006, "u", "é" * 3_000_000), (9002, "a\r\nb", "x" * 100)]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("digest", F.lit("clash"))
    folder = warc.write_pages(pages, str(tmp_path / "warc"), gzip=packed)
    rows = [(r["page_id"], r["html"]) for r in pages.collect()]
    first = {}
    for i, h in rows:
        first[h] = min(i, first.get(h, i))
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        refers = first[h] if len(raw) >= 100 and first[h] != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [tuple(r) for r in warc.read_pages(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    read = warc.read_warc(spark, folder)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()} == {i: h or "" for i, h in rows if first[h] == i or len(h or "") < 100}
    assert read.where("page_id in (9002, 9003) and refers_to = 9000").count() == 3
    for manifest in (tmp_path / "warc").glob(f"{warc.MANIFEST}*"):
        manifest.unlink()  # without a manifest files are read whole
    assert sorted((tuple(r) for r in warc.read_pages(spark, folder).collect()), key=str) == sorted(want, key=str)
    revisit = next((tmp_path / "warc").glob("*.warc*"))
    raw = b"".join((gzip.decompress(f.read_bytes()) if packed else f.read_bytes()) for f in (tmp_path / "warc").glob("*.warc*"))
    ids = set(re.findall(rb"WARC-Record-ID: (\S+)", raw))
    assert revisit and ids >= set(re.findall(rb"WARC-Refers-To: (\S+)", raw)) != set()
    empty = warc.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_pages(spark, empty).count() == 0


def test_warc_files_of_later_jobs_are_added(spark, tmp_path):
    page = lambda i: spark.createDataFrame([(i, "u", f"page {i}")], "page_id long, url string, html string")
    folder = warc.write_pages(page(1), str(tmp_path / "w"))
    warc.write_pages(page(2), folder)
    assert sorted(r["page_id"] for r in warc.read_pages(spark, folder).collect()) == [1, 2]


def foreign(headers: bytes, block: bytes) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: response\r\n" + headers + b"Content-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_warc_files_of_others(spark, tmp_path):
    """A header in Latin-1, numbers that are none, and bodies that aren't coded as they say."""
    records = [
        foreign("WARC-Target-URI: http://é\r\nWARC-Page-ID: x1\r\n".encode("latin-1"), b"HTTP/1.1 200 OK\r\n\r\nplain"),
        foreign("WARC-Target-URI: http://é\r\nWARC-Page-ID: 2\r\n".encode(), b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip"),
        foreign(b"WARC-Page-ID: 3\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nno chunks"),
        foreign(b"WARC-Page-ID: 4\r\nWARC-Payload-Length: 99999999999999999999\r\n", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"fine", mtime=0)[:-4]),
        foreign(b"WARC-Page-ID: 5\r\n", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"fine")),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r["page_id"], bytes(r["payload"]), r["bad_coding"]) for r in got] == [(None, b"plain", False), (2, b"not gzip", True), (3, b"zz\r\nno chunks", True), (4, gzip.compress(b"fine", mtime=0)[:-4], True), (5, b"fine", False)]
    assert got[0]["target_uri"] == got[1]["target_uri"] == "http://é"


def test_warc_files_of_others_in_parts(spark, tmp_path, monkeypatch):
    """Payloads that look like records don't lead astray."""
    inner = foreign(b"WARC-Page-ID: 999\r\n", b"HTTP/1.1 200 OK\r\n\r\ninner")
    records = [foreign(b"WARC-Page-ID: %d\r\n" % i, b"HTTP/1.1 200 OK\r\n\r\n" + inner * (i % 4) + b"x" * (i * 37)) for i in range(40)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:3])))
    want = sorted((r["page_id"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect())
    monkeypatch.setattr(warc, "STRETCH", 2_000)
    assert warc.index_archives(spark, str(tmp_path)) == 2
    assert len(warc.WarcReader({"path": str(tmp_path)}).partitions()) > 10
    assert sorted((r["page_id"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect()) == want and len(want) == 43


def test_warc_many_equal_pages(spark, tmp_path):
    """Equal pages of two sizes, without ids too, and ids that repeat."""
    rows = [(i, "u", "same " * 40) for i in range(50)] + [(i, "u", "") for i in range(50, 90)] + [(None, "u", "same " * 40)] * 3 + [(None, "u", None)] * 2 + [(7, "v", "same " * 40), (7, "w", "other " * 40), (3, "x", "other " * 40)]
    folder = warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), str(tmp_path / "w"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, folder).collect()), key=str)
    want = [(i, 200, *(("response", None) if i == 0 else ("revisit", 0))) for i in [*range(50), 7]] + [(i, 0, "response", None) for i in range(50, 90)] + [(None, 200, "response", None)] * 3 + [(None, 0, "response", None)] * 2 + [(7, 240, "revisit", 3), (3, 240, "response", None)]
    assert got == sorted(want, key=str)


def test_warc_bodies_as_servers_send_them():
    page, http = b"<p>some page</p>" * 9, {"content-type": "application/http; msgtype=response"}
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    for coding, body in (("gzip", gzip.compress(page)), ("deflate", zlib.compress(page)), ("deflate", raw), ("identity", page)):
        chunks = b"".join(b"%x;x=y\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
        top = f"HTTP/1.1 200 OK\r\ncontent-encoding: {coding}\r\n".encode()
        assert warc._decode(top + b"\r\n" + body, http) == page
        assert warc._decode(top + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, http) == page
    assert warc._decode(page, {"content-type": "text/html"}) == page


def test_warc_skips_unwanted_payloads(spark, tmp_path, monkeypatch):
    folder = warc.write_pages(spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    decoded = []
    monkeypatch.setattr(warc, "_decode", lambda block, head: decoded.append(head) or b"")
    reader = warc.WarcReader({"path": folder})
    assert list(reader.pushFilters([warc.EqualTo(("page_id",), 7), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == 1 and len(decoded) == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_documents import brute_components, brute_repeats

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and 0.5 * docs.count() < clean.count() <= docs.count()
    clean.write.parquet(str(tmp_path / "clean"))
    clean = spark.read.parquet(str(tmp_path / "clean"))
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    kept = stages["ngram_jaccard_join"](spark, clean, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in brute_components(rows, 5, 8, 10).items() if c == d)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    cut = stages["suffix_array_dedup"](spark, kept, sf)
    want = brute_repeats(rows)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {d: w[3].decode("utf-8", "replace") for d, w in want.items()}
    packed = stages["best_fit_packing"](spark, cut, sf)
    assert_packed(packed.collect(), [(r["doc_id"], r["text"]) for r in cut.collect()], 1024)
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))


def assert_packed(got, rows, capacity):
    """Pieces are those of the tokenizer's ids, sequences have no gaps, and there are as many as best-fit decreasing makes piece by piece."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want.update((d, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and p[-1][0] + p[-1][1] <= capacity and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:]))
    bins = []
    for n in sorted((len(k[3]) for k in want.elements()), reverse=True):
        fit = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    assert len(places) == len(bins)


def test_pipeline_stages_on_messy_documents(spark):
    """Nulls, empty and very long texts, repeated rows, rows without a doc_id and clashing columns go through every stage."""
    import corpus_pipeline
    from tests.llm.test_documents import LONG, brute_components, brute_repeats

    sf = "/root/testdata/sf0.001"
    passage = " ".join(f"shared{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, "one two"), (4, LONG), (5, "x " + passage), (6, passage + " y"), (6, passage + " y"), (7, "The cat sat on the mat today. " * 30), (8, "the CAT sat on the mat today. " * 30), (None, "nobody " * 40)]
    docs = spark.createDataFrame([(i, t, None, "s", 1, 0.5, "l", "k") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, score double, length string, kept string")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    kept = stages["ngram_jaccard_join"](spark, docs, sf)
    first = {d for d, (_, c) in brute_components([x for x in texts if x[0] is not None], 5, 8, 10).items() if d == c}
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(d) for d, _ in texts if d is None or d in first])
    cut = stages["suffix_array_dedup"](spark, kept, sf)
    want = brute_repeats([x for x in texts if x[0] in first])
    rows = cut.collect()
    assert cut.columns == docs.columns
    assert all((r["text"] or "") == (want[r["doc_id"]][3].decode() if r["doc_id"] is not None else "nobody " * 40) for r in rows)
    packed = stages["best_fit_packing"](spark, cut, sf)
    assert_packed(packed.collect(), [(r["doc_id"], r["text"]) for r in rows], 1024)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), sf).count() == 0
