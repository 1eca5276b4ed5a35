"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are which n-grams of characters (ASCII letters in lower case, the text's begin and end as a character of their own)
it holds, hashed into ``1 << BITS`` buckets. Each is scaled by the log ratio of its smoothed shares in toxic and other texts; a
logistic regression on the scaled features gives the score. It is fitted on at most ``SAMPLE`` labelled texts of either
class, chosen by a hash of the doc_id and weighted so that the classes count as they do among all labels. All buckets
have a weight: the model that is broadcast is 4 MB whatever it was fitted on. It is fitted in a task, and the driver gets no more than that
model. Every whole text is scored, in one pass without a shuffle.

Defined cases: null and empty texts have no features and score as the model's bias says; very long texts count whole; equal texts
have equal scores; rows without a label, or with a null one, are only scored; repeated labels of a document count once each in the
class they name; of rows that share a doc_id one is learned from; of labels with equal hashes the smaller doc_id is chosen first; without labels of both classes every score is the
share of toxic labels (0 without any); an empty table gives an empty result; other columns can be carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import durable, in_tasks, release
from ._text import U, grouped, lists, text_bytes

#: Buckets (as bits), n-gram lengths, labelled texts per class, and texts of the smaller class that are added to every count. Of 5, 20 and 60
#: texts, 20 gave the least loss on a quarter of the labels that may be learned from, fitted on the rest.
BITS, LENGTHS, SAMPLE, SMOOTHING = 20, (4, 5, 6), 1_000, 20.0
#: Feature entries that one step of fitting holds at once.
_AT_ONCE = 1 << 20
_FEATURES = "toxic int, buckets array<int>"
_MODEL = "weights binary, bias double"


def _features(texts: list[bytes], bits: int = BITS, lengths: tuple[int, ...] = LENGTHS) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, in no order."""
    stamp, longest = np.zeros(1 << bits, np.int32), max(lengths)
    for lo, hi in grouped(texts, 1 << 18):
        decoded = ["\0" + t.decode("utf-8", "replace") + "\0" for t in texts[lo:hi]]
        points = np.frombuffer(("".join(decoded) + "\0" * longest).encode("utf-32-le"), "<u4").astype(np.uint64)
        points[(points >= 65) & (points <= 90)] += U(32)
        size = len(points) - longest
        gram, buckets = np.zeros(size, np.uint64), []
        for k in range(longest):
            gram += (points[k : k + size] + U(1)) * U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
            if k + 1 in lengths:
                mixed = gram ^ gram >> U(31)
                buckets.append(((mixed * U(0xD6E8FEB86659FD93)) >> U(64 - bits)).astype(np.int32))
        begin = 0
        for text in decoded:
            stop = begin + len(text)
            if len(text) == 2:
                yield np.zeros(0, np.int32)
            else:
                found = np.concatenate([b[begin : max(begin, stop - n + 1)] for n, b in zip(lengths, buckets, strict=True)])
                count = np.arange(len(found), dtype=np.int32)
                stamp[found] = count  # the last of equal buckets stays
                yield found[stamp[found] == count]
            begin = stop


@dataclass
class Model:
    """Weights by bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        raw = np.array([np.sort(self.weights[x]).sum(dtype=np.float64) for x in _features(texts)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit_rows(rows: list[np.ndarray], toxic: np.ndarray, shares: tuple[float, float], rounds: int = 150, penalty: float = 1e-3) -> Model:
    """Logistic regression by accelerated gradient steps on buckets scaled by their naive Bayes log ratios.

    ``shares``: how many labels of class 0 and 1 each text of that class stands for.
    """
    size = 1 << BITS
    weight = np.where(toxic == 1, shares[1], shares[0])
    share = float((weight * toxic).sum() / max(weight.sum(), 1e-12))
    if not 0 < share < 1:
        return Model(np.zeros(size, np.float32), 40.0 if share >= 1 else -40.0)
    weight = weight / weight.sum()
    # Texts are worked on in parts of about as many features each.
    sizes = np.array([len(r) for r in rows])
    group = (np.cumsum(sizes) - sizes) // _AT_ONCE
    parts = [(slice(int(x[0]), int(x[-1]) + 1), np.concatenate([rows[i] for i in x.tolist()])) for x in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(group)) + 1)]

    def forward(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for own, flat in parts:
            sums = np.concatenate(([0.0], np.cumsum(v[flat])))
            ends = np.cumsum(sizes[own])
            out[own] = sums[ends] - sums[ends - sizes[own]]
        return out

    def back(u: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for own, flat in parts:
            out += np.bincount(flat, np.repeat(u[own], sizes[own]), size)
        return out

    # Shares of the texts of a class that hold a bucket; what is added to them is the same for both, so that a bucket of no text has ratio 0.
    many = [float(shares[c] * (toxic == c).sum()) for c in (0, 1)]
    held = [back(np.where(toxic == c, shares[c] / many[c], 0.0)) + SMOOTHING / min(many) for c in (0, 1)]
    scale = np.log(held[1] / held[0])
    # The step comes from the largest curvature, by power iteration (the bias counts as one more feature).
    v, bias = scale.copy(), 1.0
    for _ in range(8):
        length = np.sqrt(v @ v + bias * bias)
        u = weight * (forward(scale * v / length) + bias / length)
        v, bias = scale * back(u), u.sum()
    step = 1 / (0.3 * np.sqrt(v @ v + bias * bias) + penalty)
    beta, bias = np.zeros(size), np.log(share / (1 - share))
    ahead, ahead_bias, t = beta, bias, 1.0
    for _ in range(rounds):
        miss = weight * (1 / (1 + np.exp(-np.clip(forward(scale * ahead) + ahead_bias, -500, 500))) - toxic)
        new, new_bias = ahead - step * (scale * back(miss) + penalty * ahead), ahead_bias - step * miss.sum()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / following * (new - beta), new_bias + (t - 1) / following * (new_bias - bias)
        beta, bias, t = new, new_bias, following
    return Model((beta * scale).astype(np.float32), float(bias))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_features(text_bytes(batch.column("text"))))
        yield pa.record_batch([batch.column("toxic"), lists(rows, pa.int32())], ["toxic", "buckets"])


def _fit(many: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = [], []
        for batch in batches:
            column = batch.column("buckets")
            rows += [column.values[a:b].to_numpy() for a, b in zip(column.offsets[:-1].to_pylist(), column.offsets[1:].to_pylist(), strict=True)]
            toxic += batch.column("toxic").to_pylist()
        shares = tuple(many[c] / max(1, toxic.count(c)) for c in (0, 1))
        model = fit_rows(rows, np.array(toxic, np.float64), shares)
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``.

    One task gets the bucket numbers of at most 2 * ``SAMPLE`` texts, at most ``1 << BITS`` of each however long it is; the driver gets
    the weights.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    many = tuple(known.agg(*(F.count_if(F.col("toxic") == c) for c in (0, 1))).collect()[0])
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = [known.where(F.col("toxic") == c).orderBy(*order).limit(SAMPLE) for c in (0, 1)]
    # At most 2 * SAMPLE ids are broadcast; texts become bucket numbers before they leave their tasks.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    # Of rows that share a doc_id, one.
    once = Window.partitionBy("doc_id", "toxic").orderBy(F.xxhash64("text"), "text")
    picked = picked.withColumn("n", F.row_number().over(once)).where("n = 1").select("toxic", "text")
    table = durable(picked.transform(in_tasks, _collect, _FEATURES), "features")
    fitted = table.coalesce(1).transform(in_tasks, _fit(many), _MODEL).collect()[0]
    release(table)
    return Model(np.frombuffer(fitted["weights"], np.float32), fitted["bias"])


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.scores(text_bytes(batch.column("text")))
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); columns of these names give way."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(names).transform(in_tasks, _score(shared, names), schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document's label is kept from fitting: crc32 of its id as text is divisible by ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0
