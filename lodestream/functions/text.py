"""Cleaning, measuring and tokenising text: native Column functions only.

Java's ``\\w`` and ``\\s`` are ASCII; the classes below are the Unicode ones, without combining marks in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEVANAGARI_STOPWORDS, ENGLISH_STOPWORDS, MARATHI_WORDS

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same characters one by one.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]"
# Confusions of text recognition, in the order in which they are put right.
DEVANAGARI_CONFUSIONS = [("।।", "।"), ("0", "०"), ("l", "।")]
ENGLISH_CONFUSIONS = [("rn", "m"), ("cl", "d"), ("vv", "w")]
DEVANAGARI_SINGLES = "। ॥ अ आ इ ई उ ऊ ए ऐ ओ औ क ख ग घ व य".split()


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def tok_word(text: Column) -> Column:
    """Lower-case words of two characters or more, split at combining marks: for keywords and similarity."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def tok_std(text: Column) -> Column:
    """Lower-case words that keep their combining marks: for full-text search."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def normalize_whitespace(text: Column) -> Column:
    out = F.regexp_replace(text, " +", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, " +([।,.!?:;])", "$1")
    return F.regexp_replace(out, f"([।,.!?:;])([^{WS[1:-1]}।,.!?:;0-9])", "$1 $2")


def remove_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def fix_devanagari(text: Column) -> Column:
    for wrong, right in DEVANAGARI_CONFUSIONS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = F.regexp_replace(text, f"(़){WS}+", "$1")
    for sign in "ँंः":
        text = F.regexp_replace(text, f"{WS}+({sign})", "$1")
    return text


def fix_english(text: Column) -> Column:
    """The last confusion of each kind in each word; a lone l is I, a 0 before a letter at a word's start is O."""
    for wrong, right in ENGLISH_CONFUSIONS:
        # A pair after which the word holds no other one; only where its first letter stands is anything looked at.
        text = F.regexp_replace(text, f"{wrong[0]}(?!{WORD}*{wrong}){wrong[1]}", right)
    text = F.regexp_replace(text, f"(?<!{WORD})l(?!{WORD})", "I")
    return F.regexp_replace(text, f"(?<!{WORD})0([a-zA-Z])", "O$1")


def fix_punctuation(text: Column) -> Column:
    out = F.regexp_replace(text, r"\.{2,}", "...")
    out = F.regexp_replace(out, ",{2,}", ",")
    return F.regexp_replace(out, f"{WS}+([.,])", "$1")


def remove_noise(text: Column, devanagari: bool = False) -> Column:
    """Drop single characters that are no words of the language; lines stay lines."""

    def keep(w: Column) -> Column:
        if devanagari:
            return (F.length(w) > 1) | w.isin(DEVANAGARI_SINGLES)
        return (F.length(w) > 1) | F.lower(w).isin("i", "a", "o") | w.rlike(r"^\p{Nd}$")

    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.array_join(F.filter(words(line), keep), " ")), "\n")


def clean(text: Column, language: str = "en") -> Column:
    """The whole cleaning of recognised text; blank and null texts become empty."""
    devanagari = language in ("mr", "hi")
    out = remove_control_chars(normalize_whitespace(text))
    out = fix_devanagari(out) if devanagari else fix_english(out)
    out = strip(remove_noise(fix_punctuation(out), devanagari))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "").otherwise(out)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_quality(text: Column) -> Column:
    """0 to 1: short, special-ridden and scattered texts lose, a closing full stop gains."""
    size = F.length(text)
    special = _count(text, rf"[^\p{{L}}\p{{N}}{WS[1:-1]}]++") / F.greatest(size, F.lit(1))
    # An array of one, so that the text is cut once.
    single = F.transform(F.array(words(text)), lambda found: F.size(F.filter(found, lambda w: F.length(w) == 1)) / F.greatest(F.size(found), F.lit(1)))[0]
    score = F.when(size < 10, 0.5).otherwise(1.0)
    score = score * F.when(special > 0.3, 1 - special).otherwise(1.0)
    score = score * F.when(single > 0.5, 1 - single * 0.5).otherwise(1.0)
    score = score * F.when(strip(text).rlike(r"[.।]\z"), 1.1).otherwise(1.0)
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def script_ratio(text: Column, letters: str) -> Column:
    """Share of a range of letters among all letters; 0 without letters."""
    every = _count(text, r"\p{L}")
    return F.when(every > 0, _count(text, letters) / every).otherwise(0.0)


def devanagari_ratio(text: Column) -> Column:
    return script_ratio(text, r"[\x{0900}-\x{097F}&&\p{L}]")


def latin_ratio(text: Column) -> Column:
    return script_ratio(text, "[A-Za-z]")


def without_stopwords(tokens: Column, language: str = "en") -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, DEVANAGARI_STOPWORDS if language in ("mr", "hi") else ENGLISH_STOPWORDS)))


def detect_language(text: Column) -> Column:
    """``en``, ``mr``, ``hi`` or ``unknown``, by script and then by how many words are common ones of the language."""
    found = words(F.lower(text))

    def share(common: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(common))) / F.greatest(F.size(found), F.lit(1))

    hindi = [w for w in DEVANAGARI_STOPWORDS if w not in MARATHI_WORDS]
    return (
        F.when(F.coalesce(strip(text), F.lit("")) == "", "unknown")
        .when(devanagari_ratio(text) > 0.5, F.when(share(MARATHI_WORDS) > share(hindi), "mr").otherwise("hi"))
        .when((latin_ratio(text) > 0.9) & (share(ENGLISH_STOPWORDS) >= 0.1), "en")
        .otherwise("unknown")
    )


def language_hint(hint: Column) -> Column:
    """A hint that names a supported language, or null."""
    name = F.lower(strip(hint))
    return F.when(name.isin("en", "mr", "hi"), name)


def text_similarity(a: Column, b: Column) -> Column:
    """Cosine of two texts' TF-IDF vectors, the two being the whole collection; 0 without a common word.

    A word of both texts has idf 1, one of a single text ln(1.5) + 1.
    """
    idf = F.lit(1.4054651081081644)
    x, y = tok_word(F.coalesce(a, F.lit(""))), tok_word(F.coalesce(b, F.lit("")))
    dx, dy = F.array_distinct(x), F.array_distinct(y)

    def times(tokens: Column, word: Column) -> Column:
        return F.size(F.filter(tokens, lambda t: t == word)).cast("double")

    def norm(own: Column, distinct: Column, other: Column) -> Column:
        def term(w: Column) -> Column:
            weight = times(own, w) * F.when(F.array_contains(other, w), 1.0).otherwise(idf)
            return weight * weight

        return F.aggregate(distinct, F.lit(0.0), lambda s, w: s + term(w))

    common = F.aggregate(F.array_intersect(dx, dy), F.lit(0.0), lambda s, w: s + times(x, w) * times(y, w))
    size = F.sqrt(norm(x, dx, dy) * norm(y, dy, dx))
    return F.when(size > 0, common / size).otherwise(0.0)


def text_similarities(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """``by, similarity`` of rows ``(by, a, b)``, of which ``by`` names one each: ``text_similarity``, with words counted by grouping.

    If rows are dealt out by a column of ``by`` already, nothing is shuffled.
    """
    none = F.array(F.struct(F.lit("").alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))  # keeps rows without words

    def side(column: str, x: float) -> Column:
        return F.transform(tok_word(F.coalesce(column, F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(x).alias("x"), F.lit(1 - x).alias("y")))

    each = pairs.select(*by, F.explode(F.concat(none, side(a, 1.0), side(b, 0.0))).alias("t")).select(*by, "t.*")
    counts = each.groupBy(*by, "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    idf = F.lit(1.4054651081081644)
    x, y = F.col("x") * F.when(F.col("y") > 0, 1.0).otherwise(idf), F.col("y") * F.when(F.col("x") > 0, 1.0).otherwise(idf)
    sums = counts.groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("common"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    size = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(*by, F.when(size > 0, F.col("common") / size).otherwise(0.0).alias("similarity"))
