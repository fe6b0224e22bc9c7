"""Byte-level BPE: against the tiktoken library on whole texts, with small leaves so that every join is made, and round trips."""

import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from ledgerloom.llm.bpe import Coder, encoded, read_ranks, token_digests
from ledgerloom.llm.queries import op13_byte_bpe

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
WHOLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODERS = [Coder(RANKS, public_tokenizers.PATTERN, *sizes) for sizes in ((4096, 16), (1, 1), (2, 1), (3, 4), (7, 2), (64, 8))]
PARTS = ["'", "'l", "'ll", "'s", "'re", "l", "e", " ", "  ", "   ", "\n", "\r\n", "\t", " ", " ", "a", "the", " the", "Straße", "ø", "é", "漢字", "ไทย", "🙂", "👩‍👩", "1", "12345", "²", "!", "!!", "=", "====", "-", "_", "<|endoftext|>", "\x00", "\x1c", "́", "aaaa", "abab"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.lists(st.sampled_from(["a", "b", "ab", "aa", "the", "ing"]), max_size=120).map("".join)))
def test_every_tree(text):
    want = WHOLE.encode_ordinary(text)
    for coder in CODERS:
        ids = coder.encode(text)
        assert list(ids) == want and coder.decode(ids) == text.encode()


def test_borders():
    """Every cut of texts whose matches change when they go on."""
    for text in ["we'll they're I'd'll''s", "a   b", "a \n\n  b ", "x\n", "   ", "!'ll ?'s", "1'23 '4", "word    word", "=" * 70 + " " * 70 + "a" * 70]:
        want = WHOLE.encode_ordinary(text)
        for coder in CODERS:
            for cut in range(1, len(text)):
                both = coder._both(text, coder._part(text, 0, cut), coder._part(text, cut, len(text)))
                assert list(both.ids) == want and both.ends[-1] == len(text) and sum(both.counts) == len(both.ids)


def test_unreachable_tokens():
    """A token that no merges make stands for its own match only, also where a join meets it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259, b"bcd": 260}
    whole = tiktoken.Encoding("own", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["abcd", "bcd", "abcd abcd"] + ["".join(rng.choice("abcd ") for _ in range(rng.randrange(40))) for _ in range(300)]
    for leaf in ((1, 1), (2, 2), (4, 4), (50, 3)):
        coder = Coder(ranks, r"\w+|\W+", *leaf)
        for text in texts:
            assert list(coder.encode(text)) == whole.encode_ordinary(text)


def test_long_matches():
    """One match of a million characters, of one letter, of random letters and of a period; the time stays in bounds."""
    rng = random.Random(4)
    coder = CODERS[0]
    for text in ["a" * 300_000, "".join(rng.choice("abcdefgh") for _ in range(300_000)), "=" * 300_000, " " * 300_000, ("abcde" * 7 + "x") * 8000, "漢字仮名" * 50_000]:
        began = time.time()
        ids = coder.encode(text)
        assert time.time() - began < 60
        assert coder.decode(ids) == text.encode()
        for cut in range(0, len(ids) - 1, 997):
            assert coder.stands(ids[cut], ids[cut + 1])
        short = text[:20_000]
        assert list(coder.encode(short)) == WHOLE.encode_ordinary(short)


def expected(doc_id, text):
    ids = WHOLE.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "we'll  see"), (None, None), (4, "<|endoftext|>"), (5, "long text, again and again. " * 5000), (6, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 ids", "2 data", "3 decoded")
    assert sorted(map(tuple, token_digests(encoded(docs, PATH, public_tokenizers.PATTERN)).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    broken = spark.sql("select 1L doc_id, cast(unhex('61FF62') as string) text")
    assert bytes(encoded(broken, PATH, public_tokenizers.PATTERN).first()["decoded"]) == "a�b".encode()


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op13_byte_bpe(spark, DATA).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_other_vocabulary(name):
    ranks = read_ranks(public_tokenizers.path(name))
    whole, coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Coder(ranks, public_tokenizers.PATTERN, 5, 2)
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(60))
        assert list(coder.encode(text)) == whole.encode_ordinary(text)
