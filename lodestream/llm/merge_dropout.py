"""SentencePiece encoding with seeded merge-dropout, and decoding that gives the text back.

Merge-type models put characters together, best-scored pair first, from an agenda of candidate merges. Here each candidate
that comes up is skipped with probability ``dropout``, decided by a hash of the seed, the doc_id, the word's number in the text and the
place of the candidate: the same seed gives the same ids on any cluster, another seed or occurrence another segmentation.
No piece of the model reaches over the start of a run of spaces, so words are worked on one by one, and every occurrence draws
for itself. The agendas of all words of a run of texts are processed side by side as arrays: in each step every word takes its best
candidate, skips it or merges it, and gets the candidates that the merge gives rise to. Words of more than ``LONGEST`` characters have a heap each.

Decoding joins the pieces' bytes; characters that the model lacks, and the model's own space mark in a text, go through byte
pieces, so every text comes back byte by byte.

Defined cases: null and empty texts have no ids and decode to an empty text; very long texts and words are worked on whole; of
candidates with equal scores the one further left comes first; rows without a doc_id count as id 0; rows that repeat a doc_id and
text have the same ids; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import in_tasks
from ._text import U, grouped, mix, text_bytes

#: Characters of a word (32 at most) beyond which it has a heap of its own, and bytes of texts worked on at once.
LONGEST, AT_ONCE = 32, 1 << 19
MARK = "▁"
_M, _FACTOR = (1 << 64) - 1, 0xBF58476D1CE4E5B9
_GONE, _UNKNOWN = -1, -2  # a place whose character has been merged into a part before it; a character that no piece has
_NONE = np.int32(0x7FFFFFFF)
_PLACE_BITS = 5


class MergeModel:
    """The pieces of a SentencePiece merge model: bytes to write, and which two symbols merge to which.

    A symbol is a piece's id, or a number above all ids for a character that only occurs inside pieces.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        ids: dict[str, int] = {}
        scores: dict[int, float] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} reaches over the start of a run of spaces")
                ids[piece], scores[i] = i, model.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(ids)
        for char in sorted({c for piece in ids for c in piece} - set(ids)):
            symbols[char] = self.size + len(symbols) - len(ids)
        #: The symbol of every code point; a text's own mark has none, a space has the mark's.
        self.chars = np.full(0x110000, _UNKNOWN, np.int32)
        for char in {c for piece in ids for c in piece}:
            self.chars[ord(char)] = symbols[char]
        self.chars[32], self.chars[ord(MARK)] = self.chars[ord(MARK)], _UNKNOWN
        #: (rank, merged symbol) by both parts; lower ranks are merged sooner.
        self.pairs: dict[int, tuple[int, int]] = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = order[scores[i]], i
        bits = max(10, (4 * len(self.pairs)).bit_length())
        self._shift, self._slots = U(64 - bits), np.full(1 << bits, -1, np.int64)
        self._ranks, self._merged = np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        for key, (rank, merged) in self.pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & _M) >> 64 - bits
            while self._slots[at] >= 0:
                at = (at + 1) & (1 << bits) - 1
            self._slots[at], self._ranks[at], self._merged[at] = key, rank, merged

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each two parts; rank ``_NONE`` where they don't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = ((keys.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        found = self._slots[at]
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & len(self._slots) - 1
            again = self._slots[at[more]]
            more = more[(again != keys[more]) & (again >= 0)]
        hit = (self._slots[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self._ranks[at], _NONE), self._merged[at]

    def merge_word(self, parts: list[int], key: int, limit: int) -> list[int]:
        """The agenda of one word: symbols of its characters to symbols of its parts, ``_GONE`` at places merged into an earlier one.

        A candidate whose hash with ``key`` is below ``limit`` is skipped.
        """
        n, pairs = len(parts), self.pairs
        # A part is named by where it begins; ``ends`` tells where it stops, and ``befores`` where the part before it begins.
        ends, befores = list(range(1, n + 2)), list(range(-1, n))
        agenda = []

        def meet(i: int, middle: int) -> None:
            if parts[i] >= 0 and parts[middle] >= 0 and (found := pairs.get(parts[i] << 32 | parts[middle])):
                heapq.heappush(agenda, (found[0], i, middle, ends[middle], found[1]))

        for i in range(n - 1):
            meet(i, i + 1)
        while agenda:
            _, i, middle, end, merged = heapq.heappop(agenda)
            if parts[i] == _GONE or ends[i] != middle or ends[middle] != end:
                continue  # one side has been merged since
            x = key ^ (i << 32 | end - i)
            if (x ^ x >> 29) * _FACTOR & _M < limit:  # the key is mixed already
                continue
            parts[i], parts[middle], ends[i] = merged, _GONE, end
            if end < n:
                befores[end] = i
                meet(i, end)
            if befores[i] >= 0:
                meet(befores[i], i)
        return parts

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        text = b"".join([table[i] for i in ids])
        return text[1:] if text[:1] == b" " else text


class DropoutEncoder:
    """Texts to ids; every text gets the model's leading space."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.model, self._limit, self._seed = MergeModel(path), min(_M, int(dropout * (_M + 1))), seed

    def _side_by_side(self, parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        """Merge the words at ``starts`` of ``parts`` in place; a column for each word, a row for each place."""
        height = int(sizes.max())
        rows = np.arange(height + 1, dtype=np.int32)[:, None]
        inside = rows < sizes
        symbols = np.where(inside, parts[np.where(inside, starts + rows, 0)], _UNKNOWN)
        ends, befores = (np.repeat(x.astype(np.int8), len(starts), axis=1) for x in (rows + 1, rows - 1))
        ranks, merged = self.model.merges(symbols[:-1].ravel(), symbols[1:].ravel())
        # The agenda: the rank of what stands at a place and after it, with the place in its low bits.
        agenda = np.where(ranks == _NONE, _NONE, ranks << _PLACE_BITS | np.repeat(rows[:-1, 0], len(starts))).reshape(height, -1)
        merged = merged.reshape(height, -1)
        limit = U(self._limit)
        while True:
            best = agenda.min(axis=0)
            live = best != _NONE
            if live.mean() < 0.7:
                done = ~live
                at, width = np.nonzero(rows < sizes[done]), sizes[done]
                parts[starts[done][at[1]] + at[0]] = symbols[:, done][at]
                if not live.any():
                    return
                starts, sizes, keys, best = starts[live], sizes[live], keys[live], best[live]
                symbols, ends, befores, agenda, merged = (np.ascontiguousarray(x[:, live]) for x in (symbols, ends, befores, agenda, merged))
                word = np.arange(len(starts))
            else:
                word = np.flatnonzero(live)
                best = best[word]
            n = len(starts)
            place = (best & (1 << _PLACE_BITS) - 1).astype(np.int64)
            here = place * n + word
            middle = ends.ravel()[here].astype(np.int64)
            there = middle * n + word
            end = ends.ravel()[there].astype(np.int64)
            x = keys[word] ^ (place << 32 | end - place).view(np.uint64)
            skip = (x ^ x >> U(29)) * U(_FACTOR) < limit
            agenda.ravel()[here[skip]] = _NONE
            go = ~skip
            place, here, there, end, word = place[go], here[go], there[go], end[go], word[go]
            symbol = merged.ravel()[here]
            symbols.ravel()[here], symbols.ravel()[there] = symbol, _GONE
            agenda.ravel()[there] = _NONE
            ends.ravel()[here] = end
            after = end * n + word
            befores.ravel()[after] = place
            before = befores.ravel()[here].astype(np.int64)
            first = before >= 0
            left = before[first] * n + word[first]
            rank, into = self.model.merges(np.concatenate([symbol, symbols.ravel()[left]]), np.concatenate([symbols.ravel()[after], symbol[first]]))
            at, spot = np.concatenate([here, left]), np.concatenate([place, before[first]]).astype(np.int32)
            agenda.ravel()[at] = np.where(rank == _NONE, _NONE, rank << _PLACE_BITS | spot)
            merged.ravel()[at] = into

    def _part(self, texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text the end of its own."""
        decoded = [t.decode("utf-8") for t in texts]
        points = np.frombuffer("".join(decoded).encode("utf-32-le"), "<u4")
        sizes = np.array([len(t) for t in decoded], np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        stops = np.cumsum(sizes)
        cut = np.zeros(len(points) + 1, bool)
        cut[stops - sizes] = True
        space, line = points == 32, points == 10
        cut[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(cut[:-1])
        lengths = np.diff(starts, append=len(points))
        counted = np.diff(np.searchsorted(starts, stops), prepend=0)
        step = np.arange(len(starts)) - np.repeat(np.cumsum(counted) - counted, counted)
        keys = mix(np.repeat(docs, counted) ^ mix(step.astype(np.uint64) + U(self._seed & _M)))
        parts = self.model.chars[points]
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 18), (18, 32)):
            own = np.flatnonzero((lengths > low) & (lengths <= min(high, LONGEST)))
            if len(own):
                self._side_by_side(parts, starts[own], lengths[own], keys[own])
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            whole = slice(int(starts[i]), int(starts[i] + lengths[i]))
            parts[whole] = self.model.merge_word(parts[whole].tolist(), int(keys[i]), self._limit)
        counts = (parts != _GONE).astype(np.int8)
        odd = (parts == _UNKNOWN) | (parts >= self.model.size)
        if odd.any():  # characters without a piece are written byte by byte
            own = points[odd]
            counts[odd] = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
            ids = np.repeat(parts, counts)
            raw = np.frombuffer(own.tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[np.repeat(odd, counts)] = self.model.byte_ids[raw]
        else:
            ids = parts[counts > 0]
        return ids, np.cumsum(counts, dtype=np.int64)[np.maximum(stops - 1, 0)] * (stops > 0)

    def encode(self, texts: list[bytes], docs: list[int | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        named = mix(np.array([(d or 0) & _M for d in docs], np.uint64))
        texts = [b" " + t if t else b"" for t in texts]
        for lo, hi in grouped(texts, AT_ONCE):
            ids, ends = self._part(texts[lo:hi], named[lo:hi])
            out += np.split(ids, ends[:-1])
        return out


_encoders: dict[tuple, DropoutEncoder] = {}


def _worker(*key) -> DropoutEncoder:
    if key not in _encoders:
        _encoders[key] = DropoutEncoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """``(doc_id, ids)`` of ``docs(doc_id, text)`` under the SentencePiece merge model at ``model``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(model, dropout, seed)
        for batch in batches:
            ids = worker.encode(text_bytes(batch.column("text")), batch.column("doc_id").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_tasks, run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the text of its ``ids`` (null ids: null text)."""

    @F.pandas_udf("string")
    def text(ids):
        found = _worker(model, 0.0, 0).model
        return ids.map(lambda x: None if x is None else found.decode(x.tolist()).decode("utf-8", "replace"))

    return encoded.withColumn("text", text("ids"))


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_sha256)``: what encoding gives, and a digest of the text decoded from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(model, dropout, seed)
        for batch in batches:
            ids = worker.encode(text_bytes(batch.column("text")), batch.column("doc_id").to_pylist())
            rows = [(len(x), zlib.crc32(x.astype("<u4").tobytes()), hashlib.sha256(worker.model.decode(x.tolist())).hexdigest()) for x in ids]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_tasks, run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
