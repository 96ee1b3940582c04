import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm.packing import fullest, pack, plan
from trawl.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", " lead", "trail ", "two  spaces", "tab\tand\nline \n x", "don't we'll I'M", "ünï çödé ñ 中文 🙂 é", "<|endoftext|> in text", "a <|startoftext|>b", "x y z", "\x1c\x1d a\x85b", "A" * 300, "ΣΊΣΥΦΟΣ İstanbul ǅ", "1234 56a7 $$$ ###!!", "\n\n a\n", "a\nb.\nc, d\n\te", "x \ny", "l\n", "a\x00 b\x00\x00 c", "w" * 100 + " " + "é" * 50, " ", "", "Ünd,\nÉt. ß.. ...", "q ́w",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(spark, sf, name):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for kept_words, step in ((50, 7), (2_000_000, 100)):
        words, got = Encoder(public_tokenizers.path(name), kept_words=kept_words), []
        for i in range(0, len(texts), step):
            ids, ends = words.batch(pa.array(texts[i : i + step], pa.string()), 9)
            got += np.split(ids, ends[:-1])
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [9] for t in texts]


def test_fullest_equals_all_choices():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(k): int(rng.integers(0, 4)) for k in rng.choice(np.arange(1, 30), 5, replace=False)}
        room = int(rng.integers(0, 60))
        used = fullest(counts, room)
        sums = {sum(k * n for k, n in zip(counts, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts.values()))}
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_piece_once():
    counts = {1024: 7, 900: 13, 130: 40, 124: 5, 64: 1000, 3: 2, 1: 1}
    held, taken = defaultdict(list), defaultdict(list)
    for length, a, b, first, per, at in plan(counts, 1024):
        taken[length] += range(a, b)
        for k in range(b - a):
            held[first + k // per].append((at + k % per * length, length))
    assert all(sorted(taken[k]) == list(range(n)) for k, n in counts.items())
    assert sorted(held) == list(range(len(held)))
    for spans in held.values():
        ends = list(itertools.accumulate(n for _, n in sorted(spans)))
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_pieces_hold_all_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "x"), (10**6 + 1, "", "x"), (10**6 + 2, "long word " * 9000, "x"), (10**6 + 2, "long word " * 9000, "x")], "doc_id long, text string, lang string"))
    got = pack(docs, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    expected = defaultdict(list)
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected[r.doc_id].append(ids)
    spans, per_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = expected[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        spans[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append((r.start, r.length))
    for doc, docs_ids in expected.items():
        assert sorted(i for s, n in per_doc[doc] for i in range(s, s + n)) == sorted(list(range(len(docs_ids[0]))) * len(docs_ids))
    for s in spans.values():
        ends = list(itertools.accumulate(n for _, n in sorted(s)))
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 1024
    total = sum(len(i) for v in expected.values() for i in v)
    assert len(spans) <= 1.02 * total / 1024


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, part int"), PATH).collect() == []
