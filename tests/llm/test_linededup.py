import random
import re

from trawl.llm import linededup
from trawl.llm.linededup import dedup_lines

SCHEMA = "doc_id long, text string, t string, n_kept int, lines array<string>"


def distance_fits(a, b):
    """Plain dynamic programming over words; true if the distance is at most one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= 1


def brute(rows, min_words=8):
    seen, out = [], []
    for d, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((d, None, 0, 0))
            continue
        kept = []
        for line in text.split("\n"):
            w = re.sub(r"\s+", " ", line).strip(" ").split(" ")
            if w == [""]:
                kept.append(line)
                continue
            if not any(w == o or min(len(w), len(o)) >= min_words and abs(len(w) - len(o)) < 2 and distance_fits(w, o) for o in seen):
                kept.append(line)
            seen.append(w)
        out.append((d, "\n".join(kept), len(text.split("\n")), len(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1, ["x"]) for r in rows], SCHEMA)
    got = dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "t", "lines", "n_lines", "n_kept"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in got.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") for _ in range(n)] for n in (1, 2, 7, 8, 8, 9, 15, 16, 17, 31, 32, 33, 64) for _ in range(3)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(12):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[i : i + (kind != 0)] = [rng.choice("xyz")] if kind < 2 else []
                w = w or ["q"]
            lines.append(rng.choice([" ", "  "]).join(w))
            if rng.random() < 0.1:
                lines.append(" \t")
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n"), (103, "word " * 3000), (104, "word " * 3001)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "b\nc")]
    assert run(spark, rows) == [(1, "a\nb", 2, 2), (1, "a\nb", 2, 2), (2, "c", 2, 1)]


def test_null_ids_and_empty_table(spark):
    assert run(spark, [(None, "a"), (1, "a\nz")]) == [(1, "z", 2, 1), (None, "a", 1, 1)]
    assert run(spark, []) == []


def test_shuffled_past_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_PLACES", 0)
    line = "one two three four five six seven eight"
    rows = [(1, line), (2, f"{line} nine\nten"), (3, line)]
    assert run(spark, rows) == brute(rows)
