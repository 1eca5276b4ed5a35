"""Conversation repair, the audit of filters and language by codes, against brute force and on their defined cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestream.llm import conversation_repair, filter_audit, fingerprint, language_id
from lodestream.llm.queries import queries

CONVERSATIONS = "conv_id long, turn long, role string, text string, place int, audit string, copies string, costs string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """The least (cost, letters, lines) of all ways to edit rows (role, text, must go, cut off), by trying every edit."""
    known = {}

    def best(i, state, inserted):
        key = i, state, inserted
        if key not in known:
            ways = []
            role, to = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))[state]
            if inserted < 3:
                c, a, t = best(i, to, inserted + 1)
                ways.append((c + 2, "I" + a, (f"{role}:", *t)))
            if i == len(rows):
                if state in (0, 3):
                    ways.append((0, "", ()))
            else:
                own, text, gone, cut = rows[i]
                c, a, t = best(i + 1, state, 0)
                ways.append((c + 3, "D" + a, t))
                if not gone:
                    c, a, t = best(i + 1, to, 0)
                    ways.append((c + 2 + cut, "R" + a, (f"{role}:{text}", *t)))
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, own[:1]))
                    if kept is not None:
                        c, a, t = best(i + 1, kept, 0)
                        ways.append((c + cut, "K" + a, (f"{own}:{text}", *t)))
            known[key] = min(ways, default=(1 << 40, "", ()))
        return known[key]

    for i in range(len(rows), -1, -1):  # from the end on, so that no call goes deep
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def brute_repair(rows):
    every = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    groups = {}
    for conv, *rest in damaged(rows):
        groups.setdefault(conv, []).append(rest)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        counts, seen, judged = [0, 0, 0], set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, fault in (0, 1), int(fault == 2)))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        turns = {t for t, *_ in own if t is not None}
        cost, audit, lines = cheapest(judged)
        every[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return every


def got_repair(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.fixture(scope="module")
def talks():
    """Random conversations with all kinds of roles, equal texts, ties of turns, nulls, and one with most of the rows."""
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage"]
    texts = ["Yes.", "No", "Why?", "", " \t", "Again and again.", "Ending", None, "é ☃."]
    rows = []
    for conv in range(40):
        for turn in range(draw.randrange(9)):
            text = draw.choice(texts) if draw.random() < 0.5 else f"Text {conv} {turn}{draw.choice(['.', '', ' ! '])}"
            rows.append((conv, None if draw.random() < 0.05 else turn + draw.randrange(2), draw.choice(roles), text))
    rows += [(77, t, draw.choice(roles[:5]), draw.choice(texts) if draw.random() < 0.4 else f"long {t}.") for t in range(400)]
    rows += [(78, t // 2, draw.choice(roles[:5]), f"Text {t % 7}.") for t in range(60)]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hello."), (79, None, None, None), (80, 0, "user", "word " * 30_000 + "."), *[(81, 3, "user", "same.")] * 30]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "c", "k") for r in rows], CONVERSATIONS)


def test_repair_against_every_edit(spark, talks):
    assert got_repair(conversation_repair.repaired_summary(table(spark, talks))) == brute_repair(talks)


def test_repair_over_many_tasks(spark, talks):
    """With more partitions than conversations, those with many rows are cut into segments."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = table(spark, talks).repartition(7)
        found = conversation_repair.repair(conversation_repair.damage(df))
        assert found._segments.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 10
        assert got_repair(conversation_repair.repaired_summary(df)) == brute_repair(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_have_the_structure(spark, talks):
    rows = conversation_repair.repair(table(spark, talks).drop("copies")).rows().collect()
    held = {}
    for r in rows:
        held.setdefault(r["conv_id"], []).append((r["place"], r["role"]))
    for own in held.values():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in own))


def test_repair_of_nothing_and_of_the_query(spark, sf):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.repaired_summary(empty).collect() == []
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_repair(queries()["op11_conversation_repair"](spark, sf)) == brute_repair(rows)


def test_automaton_table_is_small():
    automaton, draw = conversation_repair.Automaton(), random.Random(1)
    symbols = bytes(draw.randrange(9) for _ in range(20_000))
    automaton.scan(symbols, [1] * len(symbols), automaton.END)
    assert len(automaton.vectors) < 60 and len(automaton._table) < 400


DOCUMENTS = "doc_id long, text string, lang string, mask int, part string, good string, print string, key string, lang_pred double, n long"


def brute_audit(rows, labels):
    smallest, counts = {}, {}
    for doc, text, _ in rows:
        if doc is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc), doc)
    parts = {}
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), doc is not None and smallest[text] < doc), strict=True) if bad}
        marks = labels.get(doc, (0, 0)) if doc is not None else (0, 0)
        parts.setdefault(lang or "", []).append((fails, *marks))
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            for k, f in enumerate(order):
                before = set(order[:k])
                row = [0] * 6
                for fails, good, toxic in docs:
                    gone = bool(fails & before)
                    if f in fails:
                        row[2 if gone else 1] += 1
                        row[4] += good and not gone
                        row[5] += toxic and not gone
                    elif not gone:
                        row[0] += 1
                    row[3] += fails == {f}
                shapley[f] += row[1]
                counts[part, order, k + 1] = row
        for (p, order, step), row in counts.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return counts


def got_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


@pytest.fixture(scope="module")
def papers():
    draw = random.Random(3)
    texts = [None, "", " ", "one two", "word " * 120, "UPPER CASE " * 60, " ".join(f"w{i}" for i in range(120)), " ".join(f"x{i}" for i in range(150)) + " 5%", "été ☃ " * 80, " ".join(f"v{i % 90}" for i in range(110)), " ".join(f"long{i}" for i in range(60_000))]
    rows = [(i, draw.choice(texts) if draw.random() < 0.7 else " ".join(f"t{i}w{k}" for k in range(draw.choice((20, 130)))), draw.choice(["en", "fr", None, ""])) for i in range(300)]
    rows += [(None, "word " * 120, "en"), (None, None, None), *[(500 + i, "copy of all " * 3, "en") for i in range(150)], (20, "repeated row", "fr"), (20, "repeated row", "fr"), (21, "repeated row", "fr")]
    labels = [(i, i % 3 == 0 and 1 or 0, 1 if i % 5 == 0 else None) for i in range(0, 400, 2)] + [(4, 1, 1), (None, 1, 1), (9_999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("partitions", ["4", "53"])
def test_audit_against_brute_force(spark, papers, partitions):
    rows, labels = papers
    marks = {}
    for doc, good, toxic in labels:
        held = marks.get(doc, (0, 0))
        marks[doc] = (max(held[0], good or 0), max(held[1], toxic or 0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        if partitions != "4":
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame([(*r, 1, "p", "g", "f", "k", 0.5, 9) for r in rows], DOCUMENTS).repartition(5)
        found = got_audit(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute_audit(rows, marks)
    assert len(found) == 600 * 3


def test_audit_counters_add_up_and_nothing_gives_nothing(spark, papers):
    rows, labels = papers
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = filter_audit.failures(docs)
    halves = [filter_audit.part_counters(masks.where(F.col("part") == p), marks) for p in ("en", "fr")]
    whole = got_audit(filter_audit.audit(docs, marks))
    assert {k: v for k, v in whole.items() if k[0]} == got_audit(filter_audit.interactions(halves[0].unionByName(halves[1])))
    empty = spark.createDataFrame([], DOCUMENTS)
    assert filter_audit.audit(empty, marks).collect() == []


def test_codewords():
    for languages in (2, 3, 4, 5, 6, 9, 40):
        code = language_id.codewords(languages)
        assert code.shape[0] == languages and set(np.unique(code)) == {-1.0, 1.0}
        splits = {tuple(c * c[0]) for c in code.T}
        assert len(splits) == code.shape[1]
        least = min((code[i] != code[j]).sum() for i in range(languages) for j in range(i))
        assert least >= (1 << languages) // 4 if languages <= 6 else least >= 4 + np.log2(languages)
    assert language_id.codewords(0).shape == (0, 0) and language_id.codewords(1).shape == (1, 0)


def plain_grams(text):
    low = "\0" + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) + "\0"
    return {low[i : i + n] for n in language_id.LENGTHS for i in range(len(low) - n + 1)} if text else set()


def test_language_model_against_plain_sums(spark):
    """Margins, losses and scores by loops over each text's buckets; as many buckets as there are different n-grams, less collisions."""
    texts = ["the cat and the hat", "le chat et le chapeau", "die katze und der hut", "THE END", "x"]
    packed, known = [], np.array([0, 1, 2, 0, 1])
    for buckets in language_id._features([t.encode() for t in texts], language_id.BITS, language_id.LENGTHS):
        row = np.zeros(1 << language_id.BITS, bool)
        row[buckets] = True
        packed.append(np.packbits(row))
        assert len(buckets) <= len(plain_grams(texts[len(packed) - 1])) <= len(buckets) + 3
    code = language_id.codewords(3)
    weights, bias = language_id.fit_rows(np.array(packed), known, code)
    model = language_id.Model(["en", "fr", "de"], code, weights, bias)
    losses = model.losses([t.encode() for t in texts])
    for i, row in enumerate(packed):
        held = np.flatnonzero(np.unpackbits(row))
        margins = [sum(float(weights[b, k]) for b in held) / len(held) ** 0.5 + bias[k] for k in range(code.shape[1])]
        want = [sum(np.log1p(np.exp(-m * code[lang, k])) for k, m in enumerate(margins)) for lang in range(3)]
        assert np.allclose(losses[i], want)
    assert np.argmin(losses, axis=1).tolist() == known.tolist()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.predict(docs, model).collect():
        own = losses[r["doc_id"]]
        near = np.exp(-own) / np.exp(-own).sum()
        assert r["lang_pred"] == model.languages[int(np.argmin(own))] and abs(r["score"] - near.max()) < 1e-9
        assert r["ambiguous"] == bool(np.sort(own)[1] - np.sort(own)[0] < language_id.CLOSE)


def test_language_of_held_out_documents(spark):
    found = queries()["op13_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, many = found.join(docs, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert many > 200 and right >= 0.98 * many


def test_language_of_messy_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 % ☃ 34", "fr"), (4, "Then the hen went", "en"), (5, "Puis la poule est partie", "fr"), (None, "the end", None), (4, "Then the hen went", "en"), (6, "word " * 200_000, None), (7, "漢", "fr")]
    docs = spark.createDataFrame([(*r, 1.5, "x", True) for r in rows], "doc_id long, text string, lang string, score double, lang_pred string, ambiguous boolean")
    model = language_id.fit(docs)
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(rows) and model.languages == ["en", "fr"]
    by = {(r["doc_id"], r["text"]): r for r in found}
    assert {by[k]["lang_pred"] for k in ((1, None), (2, ""), (3, "12 % ☃ 34"))} == {"und"} and by[1, None]["score"] == 0
    assert by[4, "Then the hen went"]["lang_pred"] == "en" and by[5, "Puis la poule est partie"]["lang_pred"] == "fr" and by[7, "漢"]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = language_id.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in language_id.predict(docs, one).collect()} == {"und", "fr"}
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_language_sample_is_bounded(spark):
    """However often one row is there, no more than the sample is learned from."""
    rows = [(1, "the same text", "en")] * 3_000 + [(i, f"autre texte {i}", "fr") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    real = language_id.fit_rows
    try:
        language_id.fit_rows = lambda held, known, code: sizes.append(np.bincount(known).tolist()) or real(held, known, code, rounds=2)
        language_id.fit(docs, sample=40)
    finally:
        language_id.fit_rows = real
    assert sizes[0][1] == 40 and sizes[0][0] <= 40


def plain_lanes(text):
    """How many paragraphs there are, and of each bit of their hashes that is a lane the ones less the zeros."""
    found = re.findall(r"[^\n]{1,256}?(?:[.?!](?= )|(?=\n)|\Z)|[^\n]{256}", text)
    ones = [0] * 120
    for p in found:
        for i in range(4):
            h = xxhash.xxh64(p.encode(), xxhash.xxh64(i.to_bytes(4, "little"), 42).intdigest()).intdigest()
            for s in range(10):
                for j in range(3):
                    ones[(i * 10 + s) * 3 + j] += h >> s >> 20 * j & 1
    return len(found), [2 * x - len(found) for x in ones]


def plain_likeness(a, b):
    (n, x), (m, y) = plain_lanes(a), plain_lanes(b)
    if (n, x) == (m, y):
        return 1.0
    size = (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / size)) if size else 0.0


def test_likeness_of_fingerprints_against_plain_lanes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "One. Two? Three! é☃\n\nfour"), (10_003, "x" * 700)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in fingerprint.fingerprint_documents(docs).collect():
        own, other = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - plain_likeness(own, edited)) < 1e-9 and abs(r["near_next"] - plain_likeness(own, other)) < 1e-9, r["doc_id"]
