import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trawl.llm.rangecoder import decode, encode, pack_alphabet, unpack_alphabet
from trawl.llm.tokenfile import token_digest

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 5)), max_size=400), st.integers(1, 90))
def test_round_trip(ids, block):
    assert decode(encode(np.array(ids, np.int64), block)).tolist() == ids


def test_round_trip_of_long_runs_and_skewed_ids():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(30_000, np.int64), np.repeat(rng.integers(0, 65536, 500), 40), rng.zipf(1.2, 60_000) % 65536, np.tile(rng.integers(0, 65536, 300), 100)):
        raw = encode(ids)
        assert (decode(raw) == ids).all() and len(raw) < 2 * ids.size


def test_alphabet():
    ids = np.array([0, 1, 254, 255, 600, 65535])
    assert unpack_alphabet(pack_alphabet(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("at", [0, 30, 200, -1])
def test_damage_is_noticed(at):
    raw = bytearray(encode(np.arange(3000) % 700, 1000))
    raw[at] ^= 0x55
    with pytest.raises((ValueError, IndexError)):
        decode(bytes(raw))
    with pytest.raises(ValueError):
        decode(bytes(encode(np.arange(9))[:-4]))


def test_digest_equals_plain_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = [(10**6, None, "x"), (-5, "", "x"), (7_000_000, "word " * 9000, "x"), (8_000_000, "b", "x"), (8_000_000, "a a a", "x"), (8_000_000, "b", "x")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    plain, expected, start = Tokenizer.from_file(PATH), [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for size in (5000, 10**7):
        assert sorted(map(tuple, token_digest(docs, PATH, segment_ids=size).collect()), key=lambda r: r[1]) == expected


def test_empty_table(spark):
    assert token_digest(spark.createDataFrame([], "doc_id long, text string, part int"), PATH).collect() == []
