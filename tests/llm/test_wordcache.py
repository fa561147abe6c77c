import random

import duckdb
import numpy as np
import public_tokenizers

from siltstone.llm.wordcache import CachedTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "don't", "'s", "'", "İ", "I", "̇", "é", "é", "É", "ÿ", "÷", "ß", "Σ", "ς", "ǅ", "Å", "Å", "日", "5", "٣", "#", ".", ",", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "\x01", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "\xa0", "　"]


def same(texts):
    cached = CachedTokenizer(PATH)
    plain = cached.tokenizer
    for text in texts:
        assert cached.encode_bytes(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_cached_ids_are_the_tokenizers_ids_on_random_text():
    rng = random.Random(1)
    same("".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(20_000))


def test_cached_ids_are_the_tokenizers_ids_on_documents():
    same(r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr("siltstone.llm.wordcache.CACHED", 3)
    cached = CachedTokenizer(PATH)
    cached.encode_bytes("one two three four five")
    cached.encode_bytes("six")
    assert len(cached) == 1 and cached.encode_bytes(None) == b""


def test_a_tokenizer_with_other_steps_is_used_plainly():
    other = public_tokenizers.path("byte_bpe_50k.json")
    cached = CachedTokenizer(other)
    assert CachedTokenizer(PATH).by_words and not cached.by_words
    for text in ("Two  words", " Two\n\nWords, don't <|endoftext|>", None, ""):
        assert cached.encode_bytes(text) == np.array(cached.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
