"""The language of texts by naive Bayes on profiles of character n-grams, with a probability.

A language's profile says how often each n-gram of one to three characters (hashed into ``1 << BITS`` buckets) occurs in its texts. A text has the language
under whose profile its n-grams are likeliest, all languages being as likely before; the probability is that of the language
given the n-grams. Profiles are counted by tasks and added up by language, so they may come from all texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUPPORTED_LANGUAGES

#: Buckets (as bits) and the longest n-gram.
BITS, LONGEST = 14, 3
_MULTIPLIER = 0x9E3779B97F4A7C15
UNKNOWN = "unknown"


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of a text in lower case, spaces at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    gram, found = np.zeros(len(points), np.uint64), []
    for n in range(1, LONGEST + 1):
        gram = gram[: len(points) - n + 1] + (points[n - 1 :] + np.uint64(n << 32)) * np.uint64(pow(_MULTIPLIER, n, 1 << 64))
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(_MULTIPLIER)
        found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        if len(points) == n:
            break
    return np.concatenate(found)


def counts(text: str) -> np.ndarray:
    return np.bincount(buckets(text), minlength=1 << BITS)


@dataclass
class LanguageModel:
    """Languages, and for each the logarithms of how likely each bucket is."""

    languages: list[str]
    logs: np.ndarray

    def posteriors(self, text: str) -> np.ndarray:
        """The probability of each language given a text's n-grams."""
        raw = self.logs @ counts(text)
        raw = np.exp(raw - raw.max())
        return raw / raw.sum()

    def detect(self, text: Column, supported: list[str] | None = None) -> Column:
        """``language, probability``: languages that aren't supported are ``unknown``, as are blank texts and all without profiles (probability 0)."""
        model, known = self, SUPPORTED_LANGUAGES if supported is None else supported

        @F.pandas_udf("language string, probability double")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                out = []
                for t in texts:
                    if t is None or not t.strip() or not model.languages:
                        out.append((UNKNOWN, 0.0))
                        continue
                    p = model.posteriors(t)
                    best = int(np.argmax(p))
                    out.append((model.languages[best] if model.languages[best] in known else UNKNOWN, float(p[best])))
                yield pd.DataFrame(out, columns=["language", "probability"])

        return found(text)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            held = own.setdefault(lang, np.zeros(1 << BITS, np.int64))
            held += counts(text)
    if own:
        yield pa.record_batch([pa.array(list(own), pa.string()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["lang", "counts"])


def _added(own: pa.Table) -> pa.Table:
    total = np.zeros(1 << BITS, np.int64)
    for part in own.column("counts").to_pylist():
        total += np.frombuffer(part, np.int64)
    return pa.table({"lang": own.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(texts: DataFrame) -> LanguageModel:
    """Profiles of ``texts(text, lang)``. The driver gets one array of ``1 << BITS`` counts for each language."""
    parts = texts.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_profiles, "lang string, counts binary")
    rows = sorted(((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in parts.groupBy("lang").applyInArrow(_added, "lang string, counts binary").collect()), key=lambda r: r[0])
    profiles = np.array([c for _, c in rows], np.float64).reshape(len(rows), 1 << BITS) + 1
    return LanguageModel([name for name, _ in rows], np.log(profiles / profiles.sum(axis=1, keepdims=True)))
