"""Token counts under a unigram model, by dynamic programming that is shared along a trie of pre-tokens.

The distinct pre-tokens (words between ASCII white space, with the model's space mark before them) go into a trie. A node's
forward score is the best sum of piece scores that spells the prefix up to it, and its count the pieces of that spelling;
both are worked out once for all words that begin so. A word's number of tokens is the count at its last node,
which also keeps how often the word was seen. Every batch of texts only adds nodes for prefixes its worker hasn't met;
the trie is dropped when it has ``NODES`` nodes, so memory is bounded. Nothing is shuffled for counts per document.

Scores: pieces come from a public model. None of the public files is a unigram model, and tokenizers are not trained here, so a
piece's log-probability is that which Zipf's law gives its merge rank, -ln(rank + 2).
Characters that no piece spells cost one token for each UTF-8 byte. Equal scores: fewer tokens win.

Defined cases: null and empty texts, and those of white space alone, have no pre-tokens and 0 tokens; very long texts and words
count whole; rows that repeat a doc_id, or have none, are counted each for itself; an empty table gives an empty result; other columns
can be carried along, and those named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import in_tasks
from ._text import distinct_spans, grouped, text_bytes

MARK = "▁"
NODES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """Scores of the ordinary pieces of a SentencePiece model, and of a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -log(rank + 2) for rank, i in enumerate(ordinary)}, -log(len(ordinary) + 2) * 1.5


class CountTrie:
    """Forward scores and token counts of all prefixes inserted so far."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self._scores, self._byte = scores, byte_score
        self._longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self._children: dict[int, int] = {}  # by the parent's number and the character
        self._best, self._count, self.seen = [0.0], [0], {}

    def __len__(self) -> int:
        return len(self._best)

    def insert(self, word: str, times: int = 1) -> int:
        """Tokens of the best spelling of ``word``; its terminal count grows by ``times``."""
        node, path = 0, [0]
        children, best, count, scores = self._children, self._best, self._count, self._scores
        for end, char in enumerate(word, 1):
            step = node << 21 | ord(char)
            after = children.get(step)
            if after is None:
                size = len(char.encode("utf-8", "surrogatepass"))
                top, fewest = best[node] + size * self._byte, count[node] + size
                for begin in range(max(0, end - self._longest), end):
                    score = scores.get(word[begin:end])
                    if score is not None:
                        start = path[begin]
                        total, number = best[start] + score, count[start] + 1
                        if total > top or total == top and number < fewest:
                            top, fewest = total, number
                after = children[step] = len(best)
                best.append(top)
                count.append(fewest)
            node = after
            path.append(node)
        self.seen[node] = self.seen.get(node, 0) + times
        return count[node]


class TokenCounter:
    """Counts of whole texts. Equal words of a run of texts are found by a 64-bit hash and then compared byte by byte."""

    def __init__(self, path: str):
        self._trie = CountTrie(*zipf_scores(path))
        self._known: dict[bytes, int] = {}

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """For the words of a run of texts: which distinct word each is, where texts end, the distinct words and their tokens."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        codes, first = distinct_spans(joined, data, starts, ends)
        if len(self._trie) > NODES:
            self._trie.clear()
            self._known.clear()
        times = np.bincount(codes, minlength=len(first)).tolist()
        known, tokens, names = self._known, [], []
        for begin, end, many in zip(starts[first].tolist(), ends[first].tolist(), times, strict=True):
            raw = joined[begin:end]
            names.append(raw)
            n = known.get(raw)
            if n is None:
                n = known[raw] = self._trie.insert(MARK + raw.decode("utf-8"), many)
            tokens.append(n)
        return codes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), names, np.array(tokens, np.int64)


_counters: dict[str, TokenCounter] = {}


def _worker(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` columns of ``carried`` with n_words and n_tokens of each whole text."""
    carried = tuple(c for c in dict.fromkeys(carried) if c not in ("n_words", "n_tokens"))
    fields = [*(docs.schema[c] for c in carried), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(model)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            words, tokens = [], []
            for lo, hi in grouped(texts):
                codes, ends, _, each = counter.words(texts[lo:hi])
                sums = np.concatenate(([0], np.cumsum(each[codes])))
                words.append(np.diff(ends, prepend=0))
                tokens.append(np.diff(sums[ends], prepend=0))
            made = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, tokens)]
            yield pa.record_batch([*(batch.column(c) for c in carried), *made], [*carried, "n_words", "n_tokens"])

    return docs.select(*carried, *(["text"] if "text" not in carried else [])).transform(in_tasks, run, T.StructType(fields))


def pretoken_counts(docs: DataFrame, model: str) -> DataFrame:
    """``(pretoken, n_tokens, occurrences)`` of all distinct pre-tokens; counts are added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(model)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in grouped(texts):
                codes, _, names, each = counter.words(texts[lo:hi])
                times = np.bincount(codes, minlength=len(names))
                yield pa.record_batch([pa.array([x.decode() for x in names], pa.string()), pa.array(each), pa.array(times)], ["pretoken", "n_tokens", "occurrences"])

    rows = docs.select("text").transform(in_tasks, run, "pretoken string, n_tokens long, occurrences long")
    return rows.groupBy("pretoken").agg(F.first("n_tokens").alias("n_tokens"), F.sum("occurrences").alias("occurrences"))
