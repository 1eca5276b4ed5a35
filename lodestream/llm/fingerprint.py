"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph's vector has 3 * 4 * 10 narrow lanes (a bit of four independent 64-bit hashes each) and four wide ones (60 bits of one
hash each). A document's fingerprint is the sum of its paragraphs' vectors, kept in 60-bit words modulo 2**60 with three narrow lanes
of 20 bits to a word, and the number of paragraphs. So it does not depend on their order, and paragraphs can be added to or taken from a fingerprint
without the text. Equal multisets have equal fingerprints. Narrow lanes also tell how alike two multisets are: with a lane's bit
read as +1 or -1, the products of two documents' lanes estimate their common paragraphs.

Paragraphs are what stands between line ends, divided further after sentence ends and every 256 characters, so that an
edit in a text without line ends leaves the rest of its fingerprint alone. Empty paragraphs do not count. From 2**20 paragraphs on a
narrow lane runs over into the next one of its word: sums, differences and equality stay exact, likeness becomes rough.

Defined cases: null and empty texts have the fingerprint of no paragraph; two such are alike (1), one such and another are
not (0); very long texts count whole; rows that repeat a doc_id are each fingerprinted, in the order of a hash of their texts and then of
the texts; rows without a doc_id come after all others, in the same order; a single row's next document is itself; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES, SHIFTS, BITS, LANES_IN_WORD = 4, 10, 20, 3
_WORD = (1 << BITS * LANES_IN_WORD) - 1
_SPREAD = sum(1 << BITS * i for i in range(LANES_IN_WORD))
_LANE = (1 << BITS) - 1
_WIDE = 4
#: A paragraph ends at a line end, after a full stop, question or exclamation mark before a space, or when it is 256 characters long.
PARAGRAPH = r"[^\n]{1,256}?(?:[.?!](?= )|(?=\n)|\z)|[^\n]{256}"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))


def _vector(hashes: list[Column]) -> Column:
    """The words of one paragraph: its count, the wide lanes, and the narrow lanes three to a word."""
    wide = [h.bitwiseAND(_long(_WORD)) for h in hashes[:_WIDE]]
    narrow = [F.shiftrightunsigned(h, s).bitwiseAND(_long(_SPREAD)) for h in hashes for s in range(SHIFTS)]
    return F.array(_long(1), *wide, *narrow)


def _hashes(paragraph: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), paragraph) for i in range(HASHES)]


def add(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of the union of two multisets."""
    return F.zip_with(fingerprint, other, lambda a, b: (a + b).bitwiseAND(_long(_WORD)))


def subtract(fingerprint: Column, other: Column) -> Column:
    """The fingerprint without the paragraphs of ``other``."""
    return F.zip_with(fingerprint, other, lambda a, b: (a - b + _long(_WORD) + 1).bitwiseAND(_long(_WORD)))


def paragraph_hashes(text: Column) -> Column:
    """What ``fingerprint`` sums up. Put it in a column of its own: it is read once for each word of the fingerprint."""
    return F.transform(paragraphs(text), lambda p: F.struct(*(h.alias(f"h{i}") for i, h in enumerate(_hashes(p)))))


def fingerprint(hashes: Column) -> Column:
    """The fingerprint of a text from its ``paragraph_hashes``, an array of longs.

    Each word adds up numbers under 2**60 and is cut after every step.
    """

    def word(term) -> Column:
        return F.aggregate(hashes, _long(0), lambda a, h: (a + term(h)).bitwiseAND(_long(_WORD)))

    narrow = [word(lambda h, i=i, s=s: F.shiftrightunsigned(h[f"h{i}"], s).bitwiseAND(_long(_SPREAD))) for i in range(HASHES) for s in range(SHIFTS)]
    wide = [word(lambda h, i=i: h[f"h{i}"].bitwiseAND(_long(_WORD))) for i in range(_WIDE)]
    return F.array(F.size(hashes).cast("long"), *wide, *narrow)


def paragraph_fingerprint(paragraph: Column) -> Column:
    """The fingerprint of one paragraph, to be added or subtracted."""
    return _vector(_hashes(paragraph))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda w: F.lpad(F.lower(F.hex(w)), 15, "0")), "")


def lanes(fingerprint: Column) -> Column:
    """Each narrow lane's ones less its zeros. Put it in a column of its own before it is compared."""
    words = F.slice(fingerprint, 2 + _WIDE, HASHES * SHIFTS)

    def at(shift: int) -> Column:
        return F.transform(words, lambda w: (F.shiftrightunsigned(w, shift).bitwiseAND(_long(_LANE)) * 2 - fingerprint[0]).cast("double"))

    return F.concat(*(at(BITS * i) for i in range(LANES_IN_WORD)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def likeness(same: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Cosine of two multisets of paragraphs, 0 to 1, from the products of their lanes; 1 if ``same`` says that the fingerprints are equal."""
    size = F.sqrt(xx * yy)
    return F.when(same, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), xy / size))).otherwise(0.0)


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next document by descending doc_id; after the last comes the first.

    Documents are dealt into ranges, and the first document of each range also follows the last one of the range before it. Ranges go
    by doc_id and, among rows that share one or have none, by a hash of the text, so no doc_id is a range of its own. Their borders,
    four for each shuffle partition, are found by an approximate percentile: nothing is ordered as a whole.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / float(1 << 53)
    # Never decreases from one row to the next in ascending order: all doc_ids are above -1e19, and sums are rounded in order.
    docs = docs.withColumn("__tie", tie).withColumn("__key", F.when(F.col("doc_id").isNull(), F.col("__tie") * 1e17 - 1e19).otherwise(F.col("doc_id").cast("double") + F.col("__tie")))
    tops = docs.agg(F.percentile_approx("__key", [i / n for i in range(1, n)] + [1.0], 20 * n)).first()[0]
    tops = sorted(set(tops or []))
    if not tops:
        return docs.drop("__tie", "__key").select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    # The range of a key is the number of borders below it: first of whole blocks of borders, then in the block that it falls into.
    step = max(1, round(len(tops) ** 0.5))
    key, borders = F.col("__key"), F.array(*map(F.lit, tops))
    block = F.size(F.filter(F.array(*map(F.lit, tops[step - 1 :: step])), lambda t: t < key))
    place = block * step + F.size(F.filter(F.slice(borders, block * step + 1, F.lit(step)), lambda t: t < key))
    docs = docs.withColumn("__range", place)
    # A border itself is the first, in descending order, of its range.
    real = F.struct(F.col("__range").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(((F.col("__range") + 1) % len(tops)).alias("range"), F.lit(True).alias("ghost"))
    copies = F.when(F.get(borders, F.col("__range")) == key, F.array(real, ghost)).otherwise(F.array(real))
    order = Window.partitionBy("__at.range").orderBy("__at.ghost", F.desc("doc_id"), F.desc("__tie"), F.desc("text"))
    rows = docs.withColumn("__at", F.explode(copies))
    rows = rows.select("*", *(F.lead(F.struct(c)).over(order)[c].alias(f"next_{c}") for c in columns))
    return rows.where(~F.col("__at.ghost")).drop("__at", "__range", "__key", "__tie")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by as many characters of the start of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts, and how alike they and the next document's are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = texts.withColumn("hashes", paragraph_hashes(F.col("text"))).select("doc_id", "text", fingerprint(F.col("hashes")).alias("fp"))
    rows = with_next(own, "text", "fp").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", paragraph_hashes(F.col("edited")).alias("hashes"))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("hashes")))
    rows = rows.withColumns({"x": lanes(F.col("fp")), "y": lanes(F.col("edited_fp")), "z": lanes(F.col("next_fp"))})
    rows = rows.withColumns({p: dot(F.col(p[0]), F.col(p[1])) for p in ("xx", "yy", "zz", "xy", "xz")})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp") == F.col("edited_fp"), *map(F.col, ("xy", "xx", "yy"))).alias("near_edited"), likeness(F.col("fp") == F.col("next_fp"), *map(F.col, ("xz", "xx", "zz"))).alias("near_next"),
    )
