import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from trawl.llm import alignment
from trawl.llm.alignment import Transducer, align
from trawl.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, keys int"


def brute(rows):
    """Whole texts, offsets by cumulated lengths, links from the intersection of ends."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = {c: i for i, c in enumerate(byte_letters())}
    found, counts = [], Counter()
    for doc, text in rows:
        links, groups, x, y = [], [], [], []
        if text:
            x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            left = [bytes(of[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in x]
            right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(left) == b"".join(right) == f" {text}".encode():
                ends = [{at: k for k, at in enumerate(accumulate(map(len, t)))} for t in (left, right)]
                i = j = 0
                for at in sorted(ends[0].keys() & ends[1].keys()):
                    p, q = ends[0][at] + 1, ends[1][at] + 1
                    groups.append(f"{','.join(map(str, x[i:p]))}|{','.join(map(str, y[j:q]))}")
                    links.append((x[p - 1], y[q - 1]))
                    i, j = p, q
            else:
                x, y = [], []
        counts.update(links)
        found.append((doc, x, y, groups, links))
    most = {}
    for (_, q), n in counts.items():
        most[q] = max(most.get(q, 0), n)
    return sorted(((d, len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, k in found), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, align(frame, A, B).collect()), key=str)


EDGES = ["", None, " ", "\n", "a  b", "<s> x<|endoftext|>y </s>", "▁x", "x ▁y z", "\n\n a\t\t\nb   c  d  \n", "x" * 300, "  lead", "\nq", "é ü\r\n z", "　 a 　b", "it's 'll don't\n's", "日本語 テキスト\n한국어", "\x00 a\x00", "a  b "]


def test_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(4)
    letters = ["a", "Be", " ", " ", "\n", "\t", ".", ",", "1", "23", "é", "ß", "<", "|", "▁", "'s", "日", "😀", " "]
    rows += [(1000 + k, "".join(rng.choices(letters, k=rng.randrange(40)))) for k in range(300)]
    rows += [(2000 + k, t) for k, t in enumerate(EDGES)] + [(None, "no id"), (5, "twice the same"), (5, "twice the same"), (6, "word " * 30_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(g[4] and g[5] < g[4] for g in got)


def test_rows_do_not_depend_on_blocks(spark, monkeypatch, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 2)
    monkeypatch.setattr(alignment, "KEPT", 50)
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_empty_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, ""), (None, None)]) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_transducer_closes_on_an_empty_residual():
    walk = Transducer([b"ab", b"c", b"def", b"x"], [b"a", b"bcd", b"ef", b"abc"], most=0)
    assert walk.groups([0, 1, 2], [0, 1, 2]) == [(3, 3)]
    assert walk.groups([0, 1], [3]) == [(2, 1)]
    assert walk.groups([0, 1, 0, 1], [3, 0, 1, 2]) is None
    assert walk.groups([0], [3]) is None and walk.groups([3], [0]) is None and walk.groups([0, 3], [0]) is None
    assert walk.groups([], []) == []
