import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lodestream.llm import _tokens, token_files

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = [
    "", " ", "a", "É", "ÉÈ é.è", "naïve!ß$$ŒœŸÿ", "é Ẹ́ Ẹ́x é́", "x×y÷z ×", "don't L'été l'É 'Ré's 's", "a b", "3é4 é5'é", "İIı",
    "word" * 9, "word" * 9 + "s", "Wörter" * 40, "Wörter" * 39 + "wörter", "µª º", "—é— “é”", "  é\t\nÀ ", "<|endoftext|>é", "é<|startoftext|>", "ΣΑΣ ς", "日本é", "̀", "é" * 300,
]


@pytest.mark.parametrize("file", FILES)
def test_encoder_is_the_tokenizer(file, monkeypatch):
    path = public_tokenizers.path(file)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aAéÉßÀ .!'3́×中-\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def same(encode) -> None:
        for _ in range(2):  # from the tokenizer, then from what is kept
            ids, ends = encode([t.encode() for t in texts])
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == want

    same(_tokens.WordEncoder(path))
    monkeypatch.setattr(_tokens, "AT_ONCE", 100)
    monkeypatch.setattr(_tokens, "KEPT", 40)
    same(_tokens.WordEncoder(path))
    # Pieces whose hashes clash are told apart by their bytes, in one run of texts and over runs.
    monkeypatch.setattr(_tokens, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    same(_tokens.WordEncoder(path))


def test_words_of_latin_letters_skip_the_whole_tokenizer(monkeypatch):
    encode = _tokens.WordEncoder(public_tokenizers.path(FILES[0]))
    handed, whole = [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: handed.extend(texts) or whole(texts))
    encode(["Éreré schätze. schätze! (schätze) éreré,".encode()])
    assert set(handed) == {b".", b"!", b"(", b")", b","}
    handed.clear()
    encode([b"(.)", "schätze,éreré".encode()])
    assert handed == [b"(.)"]


def test_rules_of_a_shard_are_expanded_once(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 40, 2_000)
    ends = np.cumsum(counts)
    ids = rng.integers(2, 12, ends[-1]).astype(np.uint32)
    ids[ends - 1] = 1
    path = str(tmp_path / "shard")
    token_files.write_shard(path, np.arange(2_000), ends, ids, 1)
    calls, plain = [], token_files.expand
    monkeypatch.setattr(token_files, "expand", lambda *x: calls.append(1) or plain(*x))
    rows = list(token_files._digest(iter([pa.record_batch([pa.array([path]), pa.array([7])], ["path", "first_id"])])))
    assert [x for r in rows for x in r.column("ids_crc32").to_pylist()] == [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, ends[:-1])]
    assert [x for r in rows for x in r.column("start").to_pylist()] == (ends - counts + 7).tolist()
    assert len(calls) == 1


def test_pairs_of_rare_slots_are_not_counted(monkeypatch):
    rng = np.random.default_rng(6)
    ids = np.where(rng.random(60_000) < 0.5, rng.integers(0, 3, 60_000), rng.integers(3, 2_000, 60_000))
    counted, plain = [], token_files.pd.factorize
    monkeypatch.setattr(token_files.pd, "factorize", lambda x: counted.append(len(x)) or plain(x))
    symbols, rules = token_files.re_pair(ids, 2_000, -1)
    assert (token_files.expand(symbols, rules, 2_000) == ids).all()
    assert counted[0] < 30_000
