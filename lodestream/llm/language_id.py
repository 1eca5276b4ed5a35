"""Language of texts by error-correcting output codes.

Every language has a codeword of signs. For each place of the code a binary classifier, logistic regression on which 1- to 3-grams of characters a
text holds (hashed into ``1 << BITS`` buckets, scaled to length 1), says which sign the text's language has there, with a margin. A
text is given the language whose codeword has the least sum of the margins' logistic losses, so a sure classifier counts more than an unsure
one; where the next codeword's sum is less than ``CLOSE`` above, the text is flagged as ambiguous. All splits of the languages
in two are places of the code for up to six of them; for more, seeded splits are drawn until any two codewords differ in enough places.

Fitted on at most ``SAMPLE`` texts of each language, chosen by hash; every whole text is then scored in one pass without a shuffle. The
model that is broadcast has a weight for each bucket and place.

Defined cases: null texts and those without a letter are ``und`` with score 0; very long texts count whole; equal texts have equal results;
rows without a doc_id or lang are only scored; of codewords that are equally near the language that comes first is taken; with one language
known every text with letters has it, with none every text is ``und``; an empty table gives an empty result; other columns can be carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import durable, in_tasks, release
from ._text import text_bytes
from .toxicity import _features

#: Buckets (as bits), n-gram lengths, texts of each language that are learned from, and how much nearer a codeword must be.
BITS, LENGTHS, SAMPLE, CLOSE = 14, (1, 2, 3), 500, 1.0
UNKNOWN = "und"
#: Texts that one step of fitting spreads out to a row of floats at once.
_AT_ONCE = 512
_SPLITS = 6
_LETTER = re.compile("[A-Za-z]")


def codewords(languages: int, seed: int = 1) -> np.ndarray:
    """A row of signs for each language; no two places split the languages alike."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= _SPLITS:
        splits = np.arange(1, 1 << (languages - 1))  # the last language's bit is 0: a split and its opposite are one
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    draw, code = np.random.default_rng(seed), np.zeros((languages, 0))
    least = 4 + int(np.ceil(np.log2(languages)))  # places in which any two differ at least
    while code.shape[1] == 0 or min((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(languages - 1)) < least:
        place = np.where(draw.permutation(languages) < languages // 2, 1.0, -1.0)
        place *= place[0]
        if not (code == place[:, None]).all(axis=0).any():
            code = np.hstack((code, place[:, None]))
    return code


@dataclass
class Model:
    """Languages, their codewords, and for each place a weight by bucket and a bias."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.code.shape[1]))
        for i, buckets in enumerate(_features(texts, BITS, LENGTHS)):
            if len(buckets):
                out[i] = self.weights[np.sort(buckets)].sum(axis=0, dtype=np.float64) / np.sqrt(len(buckets))
        return out + self.bias

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language the sum of the logistic losses of its codeword's places."""
        return np.logaddexp(0, -self.margins(texts)[:, None, :] * self.code[None]).sum(axis=2)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for buckets in _features(text_bytes(batch.column("text")), BITS, LENGTHS):
            held = np.zeros(1 << BITS, bool)
            held[buckets] = True
            rows.append(np.packbits(held).tobytes())
        yield pa.record_batch([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "held"])


def fit_rows(held: np.ndarray, known: np.ndarray, code: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all places together, by accelerated gradient steps.

    ``held``: packed bits, a row for each text; ``known``: the number of its language. Every language counts the same.
    """
    n, places = len(held), code.shape[1]
    want = code[known]
    weight = (1 / np.bincount(known, minlength=len(code))[known] / len(code))[:, None]
    beta, bias = np.zeros((1 << BITS, places), np.float32), np.zeros(places)
    ahead, ahead_bias, t = beta, bias, 1.0
    step = 1 / (0.25 * 2 + penalty)  # rows have length 1, and the bias is one more feature
    for _ in range(rounds):
        slope, slope_bias = np.zeros_like(beta), np.zeros(places)
        for lo in range(0, n, _AT_ONCE):
            rows = np.unpackbits(held[lo : lo + _AT_ONCE], axis=1).astype(np.float32)
            rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
            own = want[lo : lo + _AT_ONCE]
            margin = own * (rows @ ahead + ahead_bias)
            miss = -own * weight[lo : lo + _AT_ONCE] / (1 + np.exp(np.clip(margin, -500, 500)))
            slope += rows.T @ miss.astype(np.float32)
            slope_bias += miss.sum(axis=0)
        # The loss is a mean over texts, so its curvature is that of one text at most.
        new, new_bias = ahead - step * (slope + np.float32(penalty) * ahead), ahead_bias - step * slope_bias
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + np.float32((t - 1) / following) * (new - beta), new_bias + (t - 1) / following * (new_bias - bias)
        beta, bias, t = new, new_bias, following
    return beta, bias


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: rows that are to be learned from.

    The driver gets at most ``sample`` rows of ``1 << BITS`` bits for each language.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    # Ids are chosen without their texts; at most ``sample`` of each language are broadcast. Of rows that share an id and lang, one is learned from.
    order = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("lang", "doc_id").withColumn("place", order).where(F.col("place") <= sample).select("lang", "doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy(F.xxhash64("text"), "text"))
    chosen = known.join(F.broadcast(ids), ["lang", "doc_id"]).withColumn("place", once).where("place = 1")
    table = durable(chosen.select("lang", "text").transform(in_tasks, _packed, "lang string, held binary"), "languages")
    rows = table.toArrow()
    release(table)
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    held = np.frombuffer(b"".join(rows.column("held").to_pylist()), np.uint8).reshape(len(names), -1)
    # The rows' order in the table is not fixed; the model is.
    order = sorted(range(len(names)), key=lambda i: (names[i], held[i].tobytes()))
    place = {x: i for i, x in enumerate(languages)}
    return Model(languages, code, *fit_rows(held[order], np.array([place[names[i]] for i in order]), code))


def _has_letter(text: bytes) -> bool:
    decoded = text.decode("utf-8", "replace")
    return bool(_LETTER.search(decoded)) or any(map(str.isalpha, decoded))


def _predict(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            lettered = np.array([_has_letter(t) for t in texts], bool) & bool(model.languages)
            found, score, unsure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = np.flatnonzero(lettered)
            if len(at):
                losses = model.losses([texts[i] for i in at.tolist()])
                best = np.argmin(losses, axis=1)
                found[at] = np.array(model.languages, object)[best]
                near = np.exp(losses.min(axis=1, keepdims=True) - losses)
                score[at] = 1 / near.sum(axis=1)
                if len(model.languages) > 1:
                    two = np.partition(losses, 1, axis=1)
                    unsure[at] = two[:, 1] - two[:, 0] < CLOSE
            columns = [pa.array(found.tolist(), pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.record_batch([*(batch.column(c) for c in names), *columns], [*names, "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1: the share of the nearest codeword's likelihood) and ambiguous; columns of these names give way."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    names = [c for c in docs.columns if c not in [f.name for f in added]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(names).transform(in_tasks, _predict(shared, names), T.StructType([*(docs.schema[c] for c in names), *added]))
