import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from wavejobs.llm import bpe, packing

from .data import SF, awkward, empty

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(RANKS)
    own = bpe.BytePairEncoder(ranks, public_tokenizers.PATTERN, cached_words=50)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, other


def test_bpe_equals_the_library(both):
    own, other = both
    rng = random.Random(5)
    alphabets = ["ab", "aeiou thern", "a \n", "a. \n", "ab  \n\u2003", "the in", " \n\t\x1c\x85\xa0　x1'", "日本語テキスト é́", "0123456789", "=-_*#", "🤖👍🏽a"]
    for _ in range(3000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode(), repr(text)
    for text in ("a" * 100_000, "=-" * 30_000 + "x", "the" * 30_000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_bpe_query(spark, both):
    _, other = both
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), awkward(spark), empty(spark)):
        got = sorted(map(tuple, bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()), key=str)
        want = []
        for d, t in df.select("doc_id", "text").collect():
            ids = other.encode_ordinary(t or "")
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_bpe_encode_then_decode(spark):
    df = awkward(spark)
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    got = sorted((r.decoded.decode() for r in bpe.decode(encoded, RANKS).collect()))
    assert got == sorted(r.text or "" for r in df.select("text").collect())


def test_word_tokenizer_equals_the_library():
    own, other = packing.WordTokenizer(WORDS, cached_words=50), Tokenizer.from_file(WORDS)
    rng = random.Random(6)
    alphabets = ["abAB 'sS", "İıſßéÉÀñ x", "<|endoftext|>a ", "日本語 é́", "12 3a!?.", "don't we'll \xa0\x85\x1c", "ΣΑΣ σ"]
    for _ in range(3000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 40)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)
    extended = [chr(c) for c in range(0x180, 0x250)]
    texts = ["".join(rng.choices(extended, k=rng.randint(1, 6))) for _ in range(3000)]
    # Every character that words are looked up with, alone, between letters, after an apostrophe and beside a mark.
    plain = [c for c in map(chr, range(0x3000)) if packing.PLAIN.fullmatch(c)]
    assert len(plain) > 340 and all(packing.PLAIN.fullmatch(c.lower()) for c in plain)
    texts += [t for c in plain for t in (c, f"a{c}b", f"A{c}{c}", f"'{c}s", f"!{c}'s 1{c}", f"é {c} é")]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_tokenizer_leaves_other_files_to_the_library(tmp_path):
    import json

    file = json.load(open(WORDS))
    file["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(file))
    own, other = packing.WordTokenizer(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    assert not own.by_words and packing.WordTokenizer(WORDS).by_words
    assert np.frombuffer(own.encode("Some Words"), "<u4").tolist() == other.encode("Some Words", add_special_tokens=False).ids


def check_packing(df, **options):
    tok = Tokenizer.from_file(WORDS)
    length = options.get("length", 2048)
    rows = packing.pack(df, WORDS, **options).collect()
    texts = {}
    for d, t in df.select("doc_id", "text").collect():
        texts.setdefault((d, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)), []).append(1)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (d, ids), copies in texts.items():
        mine = sorted((r for r in by_doc.pop(d)), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) * len(copies)
        for r in mine:
            assert r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        cover = np.zeros(len(ids), int)
        for r in mine:
            cover[r.start : r.start + r.length] += 1
        assert (cover == len(copies)).all()
    assert not by_doc
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(docs)
    check_packing(docs.repartition(7), length=64, open_windows=2, merged_partitions=2)
    check_packing(awkward(spark))
    check_packing(empty(spark))


def test_known_words_are_held_once():
    """A piece that is one word shares its string with the table of words, and a generation that is let go of holds no other."""
    own = packing.WordTokenizer(WORDS, cached_words=8)
    own.encode("harbour")
    assert next(iter(own.pieces)) is next(iter(own.words))
    for i in range(40):
        own.encode(f"harbour{'abcdefghij'[i % 10] * (1 + i // 10)}")
    assert own.words.older and not own.words.older.older and not own.pieces.older.older
