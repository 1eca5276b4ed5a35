"""Encoding of whole texts with a public tokenizer, each distinct piece once per worker.

The pre-tokenizers of the supported files never join characters over the start of a run of white space, nor letters of ASCII and
Latin-1, ASCII digits and other ASCII characters with each other (but for an apostrophe and what stands beside it). So a text's ids are those of its
pieces between such places in a row. Equal pieces of a run of texts are found by a 64-bit hash and then compared byte by byte;
their bytes and ids are kept in bounded arrays, where they are found in the same way. Pieces of ASCII letters, which the pre-tokenizer would leave as they
are, and of Latin-1 letters, in lower case and by the pre-tokenizer's letters for bytes, go straight to the tokenizer's model. Texts with white space other than ASCII's, or which could hold a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from ._text import distinct_spans, equal_spans, span_hashes

#: Pieces kept by a worker at once, their bytes and ids at most, and bytes worked on at once.
KEPT, KEPT_BYTES, AT_ONCE = 1_200_000, 32 << 20, 1 << 20
_SPACE, _LETTER, _DIGIT, _OTHER, _QUOTE = 1, 2, 3, 4, 5  # 0: not ASCII
_KINDS = np.array([_OTHER] * 128 + [0] * 128, np.uint8)
_KINDS[[32, 9, 10, 11, 12, 13]] = _SPACE
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[39] = _QUOTE
#: Whether a piece may end between two kinds.
_CUTS = np.zeros((8, 8), bool)
_CUTS[[_LETTER, _LETTER, _LETTER, _DIGIT, _DIGIT, _DIGIT, _OTHER, _OTHER], [_DIGIT, _OTHER, _QUOTE, _LETTER, _OTHER, _QUOTE, _LETTER, _DIGIT]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0x3C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_WHOLE = re.compile(rb"<\||[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
#: Second bytes of Latin-1 letters; the first is C3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: The letters that byte-level pre-tokenizers write for bytes.
_SHOWN = np.arange(256, dtype="<u2")
_SHOWN[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 68)


class WordEncoder:
    """Ids of texts by the ``tokenizers`` file at ``path``, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            text = f.read()
        self._tokenizer = Tokenizer.from_str(text)
        kinds = json.loads(text)
        steps = [x["type"] for x in (kinds["normalizer"] or {}).get("normalizers", [])]
        #: Case and white space make no difference to the ids.
        self._folds = "Lowercase" in steps and kinds["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed"
        #: Without normalizer and pre-tokenizer.
        self._bare = Tokenizer(self._tokenizer.model)
        #: Whether an id ends a word, if the model marks that.
        mark, vocabulary = kinds["model"].get("end_of_word_suffix"), kinds["model"]["vocab"]
        self._last = np.zeros(max(vocabulary.values(), default=0) + 1, bool) if mark else None
        if mark:
            self._last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all pieces."""
        #: Sorted hashes and which piece has each; the pieces' bytes and ids, and where those begin.
        self._hashes, self._known = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._bytes, self._begins = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self._ids, self._starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, all in a row, and how many each has."""
        found = self._tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return self._listed([x.ids for x in found])

    @staticmethod
    def _listed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64)

    def _words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for spans, up to ``ends``, that are one word of letters of ASCII or Latin-1 each, after one space at most."""
        data = data.copy()
        if self._folds:
            second = np.flatnonzero(data == 0xC3) + 1
            data[second] += (data[second] < 0x9F).astype(np.uint8) * np.uint8(32)
        words = np.insert(_SHOWN[data], ends[:-1], 10).tobytes().decode("utf-16-le").split("\n")
        if self._last is not None:
            ids = np.array(self._bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self._last[ids]) + 1
            if len(stops) == len(words) and stops[-1] == len(ids):
                return ids, np.diff(stops, prepend=0)
        return self._listed([x.ids for x in self._bare.encode_batch_fast(words, add_special_tokens=False)])

    def _learn(self, joined: bytes, data: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Keep spans that aren't known, with their ids; returns which piece each has become."""
        letters = np.concatenate(([0], np.cumsum(kinds == _LETTER, dtype=np.int32)))
        others = ends - starts - (letters[ends] - letters[starts])
        word = (others == 0) | (others == 1) & (data[starts] == 32) & (ends - starts > 1)
        order = np.argsort(~word, kind="stable")
        starts, sizes, many = starts[order], (ends - starts)[order], int(word.sum())
        stops = np.cumsum(sizes)
        own = data[np.arange(stops[-1]) + np.repeat(starts - (stops - sizes), sizes)]
        parts = [self._words(own[: stops[many - 1]], stops[:many])] if many else []
        if many < len(order):
            parts.append(self._encode([joined[a : a + n] for a, n in zip(starts[many:].tolist(), sizes[many:].tolist(), strict=True)]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) + len(self._starts) - 1
        self._bytes, self._begins = np.concatenate([self._bytes, own]), np.concatenate([self._begins, self._begins[-1] + stops])
        self._ids = np.concatenate([self._ids, *(ids for ids, _ in parts)])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])
        # Of pieces with one hash the first alone is found again.
        hashes, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self._hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = np.flatnonzero(at < len(self._hashes))
        new[inside] = self._hashes[at[inside]] != hashes[inside]
        self._hashes, self._known = np.insert(self._hashes, at[new], hashes[new]), np.insert(self._known, at[new], place[first[new]].astype(np.int32))
        return place

    def _find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which known piece each span is, or -1."""
        place = np.full(len(starts), -1, np.int64)
        if not len(self._hashes):
            return place
        order = np.argsort(hashes)
        at = np.empty(len(order), np.int64)
        at[order] = np.searchsorted(self._hashes, hashes[order])
        at = np.minimum(at, len(self._hashes) - 1)
        piece = self._known[at].astype(np.int64)
        begins, sizes = self._begins[piece], ends - starts
        may = np.flatnonzero((self._hashes[at] == hashes) & (self._begins[piece + 1] - begins == sizes))
        may = may[equal_spans(data, starts[may], self._bytes, begins[may], sizes[may])]
        place[may] = piece[may]
        return place

    def _part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        joined = joined.lower() if self._folds else joined  # ASCII only
        data = np.frombuffer(joined, np.uint8)
        kinds, starts, ends = self._pieces(data, stops - sizes, stops)
        text_ends = np.searchsorted(starts, stops)
        if not len(starts):
            return np.zeros(0, np.int32), text_ends
        hashes = span_hashes(data, starts, ends)
        codes, first = distinct_spans(joined, data, starts, ends, hashes)
        if len(self._hashes) > KEPT or len(self._bytes) + 4 * len(self._ids) > KEPT_BYTES:
            self.clear()
        begins, stops, hashes = starts[first], ends[first], hashes[first]
        place = self._find(data, begins, stops, hashes)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = self._learn(joined, data, kinds, begins[fresh], stops[fresh], hashes[fresh])
        begin = self._starts[place]
        counts = (self._starts[place + 1] - begin)[codes]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self._ids[np.arange(total[-1]) + np.repeat(begin[codes] - total[:-1], counts)]
        return ids, total[text_ends]

    def _pieces(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kind of each byte, and where pieces start and end."""
        kinds = _KINDS[data]
        space, fence = kinds == _SPACE, np.zeros(len(data) + 1, bool)
        fence[begins] = True
        fence[ends] = True
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]] & ~fence[lead + 1]]
        kinds[lead] = kinds[lead + 1] = _LETTER
        cut = fence.copy()
        cut[1:-1] |= _CUTS.ravel()[kinds[:-1] << 3 | kinds[1:]]
        if not self._folds:
            cut[1:-1] |= space[1:] & ~space[:-1]
            starts = np.flatnonzero(cut[:-1])
            return kinds, starts, np.append(starts[1:], len(data))
        after = cut[:-1].copy()
        after[1:] |= space[:-1]
        before = cut[1:].copy()
        before[:-1] |= space[1:]
        return kinds, np.flatnonzero(~space & after), np.flatnonzero(~space & before) + 1

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text (UTF-8) the end of its own."""
        joined = b"".join(texts)
        # Only texts with a byte that such places begin with are searched for them.
        leads = np.flatnonzero(_LEADS[np.frombuffer(joined, np.uint8)])
        owners = np.unique(np.searchsorted(np.cumsum([len(t) for t in texts]), leads, "right"))
        whole = {i: texts[i] for i in owners.tolist() if _WHOLE.search(texts[i])}
        plain = [b"" if i in whole else t for i, t in enumerate(texts)]
        parts, ends, lo, done = [], [], 0, 0
        while lo < len(plain):
            hi, size = lo, 0
            while hi < len(plain) and (hi == lo or size + len(plain[hi]) <= AT_ONCE):
                size += len(plain[hi])
                hi += 1
            ids, stops = self._part(plain[lo:hi])
            parts.append(ids)
            ends.append(stops + done)
            done, lo = done + len(ids), hi
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        text_ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        if not whole:
            return ids, text_ends
        begins = np.concatenate(([0], text_ends[:-1]))
        own = [ids[b:e] for b, e in zip(begins.tolist(), text_ends.tolist(), strict=True)]
        for i, t in whole.items():
            own[i] = self._encode([t])[0]
        return np.concatenate(own), np.cumsum([len(p) for p in own])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
