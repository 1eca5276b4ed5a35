"""Operators on documents against brute force, and the cases that their docstrings define."""

import hashlib
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import fingerprint, merge_dropout, ngram_join, packing, suffix_dedup, token_counts, token_files, toxicity
from lodestream.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, score double, n_bytes long, ids string, length string, id long, kept string"
LONG = " ".join(f"word{i % 9973}" for i in range(150_000))


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    texts = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two"), (6, LONG), (7, "a" * 500), (8, "ab" * 300), (9, "The cat sat. " * 30), (10, "the CAT sat. " * 30), (None, "nobody " * 40), (11, "été ☃ 漢字 " * 30), (12, "nobody " * 40), (4, "one"), (13, "x▁y  z\n\n\tq ")]
    return spark.createDataFrame([(i, t, None, 0.5, 7, "i", "l", 3, "k") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, sf=None):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_components(rows, width, num, den):
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for d, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(d)
    for d, s in sets.items():
        for e, k in Counter(e for g in s for e in held[g] if e < d).items():
            if k * den >= num * (len(s) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("width", "limit", "num", "den"), [(3, "0.9", 9, 10), (5, 0.8, 8, 10), (2, "0.5", 1, 2)])
def test_ngram_components(spark, width, limit, num, den):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    want = brute_components(rows_of(docs), width, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, width, limit).collect()}
    assert got == want


def test_ngram_components_chain(spark):
    """A chain of near copies is one component though its ends are apart, and a large group stays one."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join([f"x{j}" for j in range(i)] + words[i:])))
    docs = spark.createDataFrame([*rows, *((100 + i, rows[3][1]) for i in range(50))], "doc_id long, text string")
    want = brute_components(rows_of(docs), 3, 9, 10)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, 3, "0.9").collect()}
    assert got == want


def test_ngram_edges(messy, none):
    want = brute_components(rows_of(messy), 3, 9, 10)
    got = ngram_join.ngram_components(messy, 3, "0.9").collect()
    assert len(got) == messy.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert ngram_join.ngram_components(none, 3, "0.9").count() == 0
    kept = ngram_join.keep_one(messy, 3, "0.9")
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 11, 12, 13, None])


def brute_repeats(rows, length=100):
    seen, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, gone, strict=True) if not c)
        out[d] = (len(b), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone))), kept)
    return out


@pytest.mark.parametrize("hot", [200_000, 1])
def test_suffix_repeats(spark, messy, sf, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(messy.where("doc_id is not null and doc_id <> 6").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    want = brute_repeats(rows_of(docs))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert all(want[r["doc_id"]] == (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)


def test_suffix_edges(messy, none):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(messy).collect()}
    assert got[None]["n_removed"] == 0 and got[12]["n_removed"] == brute_repeats([(12, "nobody " * 40)])[12][1]
    assert got[6]["n_removed"] == brute_repeats([(6, LONG)])[6][1] > 0
    assert got[1]["kept"] == b"" and got[4]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    cut = suffix_dedup.without_repeats(messy.select("doc_id", "text", "lang"))
    assert cut.columns == ["doc_id", "text", "lang"] and cut.count() == messy.count()


@pytest.mark.parametrize("hot", [200_000, 1])
def test_suffix_repeated_rows_keep_one_copy(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    one, two = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(1, one)] * 2 + [(2, "before " + one + " after")] + [(3, two)] * 5 + [(4, "a" * 300)] * 2 + [(5, two + one)] * 3
    want = brute_repeats(rows)
    assert want[1][1] == want[3][1] == 0 < want[4][1]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter((d, *want[d]) for d, _ in rows)
    parts = [(1, 0, 301, two.encode()[:400]), (1, 0, 301, two.encode()[:400]), (2, 7, 301, two.encode()[:400])]
    assert suffix_dedup.repeated(parts, 100) == [(2, 7, 400)]


def segments_of_one_route(many, windows):
    """Arrow batches of segments of one minimizer in ascending places; every tenth is followed by one that ends with its bytes."""
    rng = np.random.default_rng(11)
    parts = [rng.integers(97, 123, windows + 99).astype(np.uint8).tobytes() for _ in range(many)]
    parts = [p if i % 10 != 1 else b"-" + parts[i - 1][1:] for i, p in enumerate(parts)]
    columns = ([7] * many, list(range(many)), [0] * many, [3] * many, [windows] * many, parts)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["route", "doc_id", "tag", "place", "n", "part"])
    return table.to_batches(max_chunksize=1_000)


def test_suffix_sort_of_one_minimizer_is_bounded_in_memory():
    batches, want = segments_of_one_route(6_000, 200), [(i, 4, 298) for i in range(1, 6_000, 10)]  # 1.2 million windows
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(suffix_dedup._sort(100)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(zip(*(out.column(c).to_pylist() for c in ("doc_id", "place", "bytes")), strict=True)) == want
    assert peak < 90_000_000


def test_suffix_sort_in_portions_finds_the_same(monkeypatch):
    rng = np.random.default_rng(12)
    text = np.concatenate([rng.integers(97, 99, 400), np.full(300, 97), rng.integers(97, 123, 200)] * 2).astype(np.uint8).tobytes()
    parts = [(int(rng.integers(1, 4)), at, n, text[at : at + n + 99]) for at, n in zip(range(0, 1_500, 7), rng.integers(1, 90, 215).tolist(), strict=True)]
    parts += [(4, at, n, part) for _, at, n, part in parts[::5]]
    keys = [int(x) for x in rng.integers(0, 2, len(parts))]
    for own in (None, keys):
        want = suffix_dedup.repeated(parts, 100, own)
        for at_once in (1, 50, 1_000):
            with monkeypatch.context() as m:
                m.setattr(suffix_dedup, "SORTED_AT_ONCE", at_once)
                assert suffix_dedup.repeated(parts, 100, own) == want
    starts = np.arange(1_500)
    data = np.frombuffer(text + bytes(16), np.uint8)
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 100)
    found = list(suffix_dedup._portions(data, starts, 100))
    assert len(found) == 15 and sorted(np.concatenate(found).tolist()) == starts.tolist()
    where = {}
    for k, portion in enumerate(found):
        assert (np.diff(portion) > 0).all()
        assert all(where.setdefault(text[i : i + 100], k) == k for i in portion.tolist())


def test_deep_shallow_groups():
    rng = np.random.default_rng(3)
    for length in (32, 40, 100):
        data = np.concatenate([rng.integers(97, 99, 300), rng.integers(97, 123, 200)] * 2 + [np.full(150, 97)]).astype(np.uint8)
        starts = np.arange(len(data) - length)
        want = {}
        for i in starts:
            want.setdefault(data[i : i + length].tobytes(), []).append(int(i))
        got = suffix_dedup.deep_shallow(np.concatenate([data, np.zeros(16, np.uint8)]), starts, length)
        assert sorted(sorted(g.tolist()) for g in got) == sorted(v for v in want.values() if len(v) > 1)


def test_suffix_order_is_that_of_sorting():
    rng = np.random.default_rng(5)
    for length, shallow in ((32, 24), (40, 8), (100, 24), (100, 100), (33, 0)):
        data = np.concatenate([rng.integers(97, 99, 300), rng.integers(97, 123, 200)] * 2 + [np.full(150, 97), rng.integers(0, 256, 200)]).astype(np.uint8)
        starts = rng.permutation(len(data) - length)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        text = [data[i : i + length].tobytes() for i in starts]
        order, equal = suffix_dedup.suffix_order(padded, starts, length, shallow)
        assert order.tolist() == sorted(range(len(starts)), key=lambda i: (text[i], i))
        assert equal.tolist() == [False] + [text[a] == text[b] for a, b in zip(order[1:], order[:-1], strict=True)]
        group = rng.integers(-5, 5, len(starts))
        order, equal = suffix_dedup.suffix_order(padded, starts, length, shallow, group)
        assert order.tolist() == sorted(range(len(starts)), key=lambda i: (group[i], text[i], i))
        assert equal.tolist() == [False] + [(group[a], text[a]) == (group[b], text[b]) for a, b in zip(order[1:], order[:-1], strict=True)]
    assert [len(x) for x in suffix_dedup.suffix_order(padded, starts[:0], 100)] == [0, 0]


def test_best_fit_is_that_of_single_pieces():
    def brute(lengths, capacity):
        bins = []
        for length in sorted(lengths, reverse=True):
            fit = [(r, i) for i, r in enumerate(bins) if r >= length]
            if fit:
                bins[min(fit)[1]] -= length
            else:
                bins.append(capacity - length)
        return sorted(bins)

    rng = np.random.default_rng(1)
    for capacity in (7, 10, 64, 100):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 300)).tolist()
            used = {}
            for length, _, pieces, per, first, offset in packing.best_fit_moves(Counter(lengths), capacity):
                for j in range(pieces):
                    used.setdefault(first + j // per, []).append((offset + j % per * length, length))
            for b in used.values():
                b.sort()
                assert b[0][0] == 0 and b[-1][0] + b[-1][1] <= capacity and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False))
            assert sorted(capacity - sum(x[1] for x in b) for b in used.values()) == brute(lengths, capacity)


def encodings(rows, name, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for _, t in rows]


def test_packing(messy, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(messy, path, 2, 64).collect()
    rows = rows_of(messy)
    want = Counter()
    for (d, _), ids in zip(rows, encodings(rows, "byte_bpe_50k.json", 2), strict=True):
        bounds = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k in range(len(bounds) - 1):
            part = ids[bounds[k] : bounds[k + 1]]
            want[d, k, bounds[k], len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and sum(x[1] for x in p) <= 64 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:], strict=False))
    assert packing.pack_documents(none, path, 2, 64).count() == 0


def test_packing_numbers_pieces_over_tasks(spark, messy, monkeypatch):
    """Sums that are joined instead of broadcast, tables from elsewhere, and columns with clashing names."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "BROADCAST", 0)
    got = packing.pack_documents(messy.repartition(5), path, 2, 64, carried=("doc_id", "length", "score", "ids")).collect()
    assert set(got[0].asDict()) == {"doc_id", "score", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    lengths = [int(x) for x in np.random.default_rng(9).integers(1, 65, 400)]
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, offset string").repartition(3)
    for placed in (got, packing.best_fit_pack(rows, 64).collect()):
        places = {}
        for r in placed:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for p in places.values():
            p.sort()
            assert p[0][0] == 0 and p[-1][0] + p[-1][1] <= 64 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:], strict=False))
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(bins) if r >= n]
        bins.append(64 - n) if not fit else bins.__setitem__(min(fit)[1], min(fit)[0] - n)
    assert len(placed) == 400 and len(places) == len(bins)
    with pytest.raises(ValueError, match="longer than the capacity"):
        packing.best_fit_pack(rows, 32)


def test_token_files(spark, messy, none, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 2_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(messy, path, 1)
    assert manifest.count() > 1
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    rows = sorted(rows_of(messy), key=lambda r: -1 if r[0] is None else r[0])
    want = encodings(rows, "word_bpe_49k.json", 1)
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert [r["ids"] for r in got] == want
    assert [r["start"] for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]
    digests = token_files.read_token_files(manifest, digests=True).orderBy("start").collect()
    assert [r["ids_crc32"] for r in digests] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert token_files.read_token_files(token_files.write_token_files(none, path, 1)).count() == 0


def test_re_pair_round_trip(tmp_path):
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 400, 5000):
        ids = np.append(rng.integers(0, 9, n), 1).astype(np.uint32)
        symbols, rules = token_files.re_pair(ids, 9, 1)
        assert (token_files.expand(symbols, rules, 9) == ids).all()
        assert token_files.expansion_lengths(rules, 9).tolist() == [len(token_files.expand(np.array([9 + i]), rules, 9)) for i in range(len(rules))]
        # Worked to the end: no pair outside of an end is left that would pay for its rule.
        left = Counter()
        k = 0
        while k + 1 < len(symbols):
            pair = (int(symbols[k]), int(symbols[k + 1]))
            left[pair] += 1
            k += 1
        assert n < 5000 or len(symbols) < 0.66 * n and max((c for p, c in left.items() if 1 not in p), default=0) < 3 * token_files.LEAST
        ids = (ids * 5000).astype(np.uint32)
        ends = np.flatnonzero(ids == 5000) + 1
        size = token_files.write_shard(str(tmp_path / f"s{n}"), np.arange(len(ends)), ends, ids, 5000, min(1, n))
        assert size == (tmp_path / f"s{n}").stat().st_size
        shard = token_files.Shard(str(tmp_path / f"s{n}"))
        assert shard.without_id == min(1, n)
        for i in range(len(ends)):
            own = ids[(ends[i - 1] if i else 0) : ends[i]]
            assert (shard.documents(i, i + 1) == own).all()
            for lo, hi in ((0, 1), (0, len(own)), (len(own) // 3, len(own) // 2 + 1), (len(own) - 1, len(own) + 5), (3, 3)):
                assert (shard.ids(i, lo, hi) == own[lo:hi]).all()


def test_bit_packing():
    rng = np.random.default_rng(4)
    for bits in (1, 3, 8, 14, 17, 32):
        values = rng.integers(0, 1 << bits, 1003)
        raw = token_files.pack(values, bits)
        assert len(raw) == token_files.packed_size(1003, bits)
        for lo, hi in ((0, 1003), (5, 6), (999, 1003), (8, 8)):
            assert (token_files.unpack(raw[lo * bits // 8 : -(-hi * bits // 8)], bits, lo, hi - lo) == values[lo:hi]).all()


def test_fingerprints(spark, messy, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(rows_of(docs), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    seen = {}
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert len(set(seen.values())) == len(seen)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9
    rows = sorted(rows_of(messy), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for k, (d, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprint_documents(messy).collect()) == want
    assert fingerprint.fingerprint_documents(none).count() == 0


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([("one.\ntwo.\nthree.", "three.\none.\ntwo.", "one.\nthree.", "two.")], "a string, b string, c string, p string")
    df = df.select("p", *(fingerprint.paragraph_hashes(F.col(c)).alias(c) for c in "abc")).select("p", *(fingerprint.fingerprint(F.col(c)).alias(c) for c in "abc"))
    one = fingerprint.paragraph_fingerprint(F.col("p"))
    row = df.select("a", "b", "c", fingerprint.subtract(F.col("a"), one).alias("less"), fingerprint.add(F.col("c"), one).alias("more")).first()
    assert row["a"] == row["b"] == row["more"] and row["less"] == row["c"] != row["a"]


def test_next_document_over_range_borders(spark):
    docs = spark.range(1000).select((F.col("id") * 7 - 300).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r["doc_id"]: int(r["next_text"]) for r in fingerprint.with_next(docs, "text").collect()}
    assert got == {i * 7 - 300: (i - 1) % 1000 for i in range(1000)}


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    rows = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))).select("toxic", "text"), model).collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == c] for c in (1, 0))
    assert np.mean([b > g for b in bad for g in good[:200]]) > 0.95
    assert np.mean([g >= 0.5 for g in good]) < 0.01


def test_toxicity_features_are_those_of_the_text_alone():
    texts = ["", "first text", "", "A second öne", "x", "first text", "FIRST TEXT", "aaaaaaaaaaaa"]
    found = [set(x.tolist()) for x in toxicity._features([t.encode() for t in texts])]
    alone = [set(next(iter(toxicity._features([t.encode()]))).tolist()) for t in texts]
    assert found == alone and found[0] == set() and found[1] == found[5] == found[6]
    # As many buckets as there are distinct n-grams of characters, begin and end included.
    for text, own in zip(texts, found, strict=True):
        padded = f"\0{text.lower()}\0"
        grams = {padded[i : i + n] for n in toxicity.LENGTHS for i in range(len(padded) - n + 1)} if text else set()
        assert len(own) == len(grams)


def test_toxicity_scores_are_those_of_plain_dictionaries():
    """Log-count ratios and the same descent on dictionaries of n-grams, bucket by bucket."""
    rng = np.random.default_rng(8)
    words = ["good", "bad", "vile", "tree", "sky", "ugly", "river", "stone"]
    texts = [" ".join(rng.choice(words, 12)) + (" vile ugly" if i % 3 == 0 else "") for i in range(30)]
    toxic = np.array([float(i % 3 == 0) for i in range(30)])
    toxic[4] = 1
    shares = (2.5, 1.0)
    model = toxicity.fit_rows(list(toxicity._features([t.encode() for t in texts])), toxic, shares, rounds=12)
    rows = [set(x.tolist()) for x in toxicity._features([t.encode() for t in texts])]
    many = [shares[c] * sum(toxic == c) for c in (0, 1)]
    ratio = {}
    for b in set().union(*rows):
        held = [sum(shares[c] / many[c] for r, t in zip(rows, toxic, strict=True) if t == c and b in r) + toxicity.SMOOTHING / min(many) for c in (0, 1)]
        ratio[b] = np.log(held[1] / held[0])
    weight = np.array([shares[int(t)] for t in toxic])
    weight /= weight.sum()
    share = float((weight * toxic).sum())
    v, vb = dict(ratio), 1.0
    for _ in range(8):
        size = np.sqrt(sum(x * x for x in v.values()) + vb * vb)
        u = weight * np.array([(sum(ratio[b] * v[b] for b in r) + vb) / size for r in rows])
        v, vb = {b: ratio[b] * sum(x for x, r in zip(u, rows, strict=True) if b in r) for b in ratio}, u.sum()
    step = 1 / (0.3 * np.sqrt(sum(x * x for x in v.values()) + vb * vb) + 1e-3)
    beta, bias, t = dict.fromkeys(ratio, 0.0), np.log(share / (1 - share)), 1.0
    ahead, ahead_bias = dict(beta), bias
    for _ in range(12):
        miss = weight * (np.array([1 / (1 + np.exp(-sum(ratio[b] * ahead[b] for b in r) - ahead_bias)) for r in rows]) - toxic)
        new = {b: ahead[b] - step * (ratio[b] * sum(m for m, r in zip(miss, rows, strict=True) if b in r) + 1e-3 * ahead[b]) for b in ratio}
        new_bias, following = ahead_bias - step * miss.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = {b: new[b] + (t - 1) / following * (new[b] - beta[b]) for b in ratio}
        ahead_bias = new_bias + (t - 1) / following * (new_bias - bias)
        beta, bias, t = new, new_bias, following
    want = [1 / (1 + np.exp(-sum(ratio[b] * beta[b] for b in r) - bias)) for r in rows]
    assert np.allclose(model.scores([t.encode() for t in texts]), want, atol=1e-6)


def test_toxicity_edges(spark, messy, none):
    labels = spark.createDataFrame([(9, 1), (10, 1), (11, 0), (6, 0), (4, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(messy, labels)
    got = toxicity.score(messy, model)
    assert got.count() == messy.count() and got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert {r["predicted"] for r in toxicity.score(messy, toxicity.fit(messy, labels.where("toxic = 0"))).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(messy, toxicity.fit(messy, labels.limit(0))).collect()} == {0}


def test_toxicity_is_fitted_outside_the_driver(spark, monkeypatch):
    """A task gets the features and the driver the weights; they are those of fitting on all labelled texts."""
    texts = [f"{'vile ugly words' if i % 3 == 0 else 'a river and a tree'} number {i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int")
    real, driver = toxicity.fit_rows, os.getpid()

    def elsewhere(*args):
        if os.getpid() == driver:
            raise AssertionError("fitted in the driver")
        return real(*args)

    monkeypatch.setattr(toxicity, "fit_rows", elsewhere)
    model = toxicity.fit(docs, labels)
    want = real(list(toxicity._features([t.encode() for t in texts])), np.array([float(i % 3 == 0) for i in range(30)]), (1.0, 1.0))
    assert np.allclose(model.weights, want.weights, atol=1e-6) and abs(model.bias - want.bias) < 1e-6 and model.weights.any()


def test_merge_dropout(spark, messy, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = merge_dropout.encode(messy, path)
    back = merge_dropout.decode(encoded, path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t or "") for d, t in rows_of(messy))
    again = {(r["doc_id"], tuple(r["ids"])) for r in merge_dropout.encode(messy.repartition(3), path).collect()}
    assert again == {(r["doc_id"], tuple(r["ids"])) for r in back}
    assert again != {(r["doc_id"], tuple(r["ids"])) for r in merge_dropout.encode(messy, path, seed=2).collect()}
    assert merge_dropout.round_trip(none, path).count() == 0


def test_merge_dropout_draws_for_every_occurrence():
    path, word = public_tokenizers.path("piece_bpe_32k.model"), b"internationalization"
    encoder = merge_dropout.DropoutEncoder(path, 0.1, 1)
    ids = encoder.encode([word] * 500, list(range(500)))
    assert all(encoder.model.decode(x.tolist()) == word for x in ids) and len({x.tobytes() for x in ids}) > 4
    ids = encoder.encode([b" ".join([word] * 500)], [7])[0]
    ends = np.flatnonzero([b" " in encoder.model.bytes[i][:1] for i in ids])
    assert len({x.tobytes() for x in np.split(ids, ends)}) > 4


def naive_agenda(model, scores, word, key, limit):
    """All candidates of a word looked at in every step; those that were skipped are remembered by place and size."""
    parts, skipped = [(i, c) for i, c in enumerate(word)], set()
    while True:
        found = [(-scores[a + b], i, a + b) for (i, a), (_, b) in zip(parts, parts[1:]) if a + b in scores and (i, a, b) not in skipped]
        if not found:
            return [p for _, p in parts]
        _, place, piece = min(found)
        x = key ^ (place << 32 | len(piece))
        at = next(k for k, (i, _) in enumerate(parts) if i == place)
        if (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) < limit:
            skipped.add((place, parts[at][1], parts[at + 1][1]))
        else:
            parts[at : at + 2] = [(place, piece)]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_merge_dropout_is_that_of_a_naive_agenda(sf, spark, dropout):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    scores = {p: model.get_score(i) for p, i in ids.items()}
    texts = [t for _, t in sorted(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))[:40]] + ["été ☃ 漢字漢字  q", "a" * 90, "x" * 33 + "internationalization" * 4, "\n\n \t don't"]
    encoder, limit, mask = merge_dropout.DropoutEncoder(path, dropout, 3), min((1 << 64) - 1, int(dropout * (1 << 64))), (1 << 64) - 1
    for doc, (text, got) in enumerate(zip(texts, encoder.encode([t.encode() for t in texts], list(range(-5, len(texts) - 5))), strict=True), -5):
        want = []
        for k, word in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text)):
            key = merge_dropout.mix(merge_dropout.mix(np.array([doc & mask], np.uint64)) ^ merge_dropout.mix(np.array([k + 3], np.uint64)))
            for part in naive_agenda(model, scores, word.replace(" ", "▁"), int(key[0]), limit):
                want += [ids[part]] if part in ids else [encoder.model.byte_ids[x] for x in part.encode()]
        assert got.tolist() == want


def test_no_dropout_is_the_models_own_encoding(sf, spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = SentencePieceProcessor(model_file=path)
    texts = dict(rows_of(docs))
    got = {r["doc_id"]: r["ids"] for r in merge_dropout.encode(docs, path, dropout=0.0).collect()}
    assert got == {d: model.encode(t, num_threads=1) for d, t in texts.items()}


def test_round_trip_query(spark, sf):
    texts = dict(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))
    got = queries()["op2_merge_dropout"](spark, sf).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}


def test_token_counts(spark, messy, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, byte = token_counts.zipf_scores(path)

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            found = [(best[-1][0] + n * byte, -best[-1][1] - n)]
            found += [(best[b][0] + scores[word[b:end]], -best[b][1] - 1) for b in range(max(0, end - 16), end) if word[b:end] in scores]
            top = max(found)
            best.append((top[0], -top[1]))
        return best[-1][1]

    held = {}
    for d, t in rows_of(messy):
        words = re.findall("[^ \t\n\r\x0b\x0c]+", t or "")
        held[d] = (len(words), sum(brute("▁" + w) for w in words))
    got = token_counts.count_tokens(messy, path).collect()
    assert len(got) == messy.count() and all((r["n_words"], r["n_tokens"]) == held[r["doc_id"]] for r in got)
    assert token_counts.count_tokens(none, path).count() == 0
    counts = {r["pretoken"]: (r["n_tokens"], r["occurrences"]) for r in token_counts.pretoken_counts(messy, path).collect()}
    assert counts["sat."] == (brute("▁sat."), 60) and counts["nobody"][1] == 80
