import hashlib
import math
import random
import re
from collections import defaultdict

from trawl.llm.sanitise import AROUND, LEAST, STEM, SUPPORT, THRESHOLD, personal_data, sanitised

SCHEMA = "doc_id long, text string, row int, kind string, term string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = [*PLAIN, "general", "removed"]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return m.lower()
    if kind == "ip":
        return m if all(int(p) <= 255 for p in m.split(".")) else None
    if kind == "phone":
        return d if 9 <= len(d) <= 15 else None
    total = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d))))
    return d if 12 <= len(d) <= 19 and total % 10 == 0 else None


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        every = list(re.finditer(pattern, text))
        for i, m in enumerate(every):
            if (value := valid(kind, m[0])) is not None:
                left = every[i - 1].end() if i else 0
                right = every[i + 1].start() if i + 1 < len(every) else len(text)
                out.append((m.start(), NAMES.index(kind), m.end(), value, left, right))
    return sorted(out)


def core_words(text, lo, hi, take):
    tokens = [(t.start() + lo, t[0]) for t in re.finditer(r"\S+|\s+", text[lo:hi])]
    for at, t in take(tokens):
        if re.fullmatch(r"[^\w@+]*[^\W\d_]{%d,}[^\w@+]*" % LEAST, t):
            m = re.search(r"[^\W\d_]+", t)
            yield m[0].lower(), at + m.start(), at + m.end()


def brute(rows):
    texts = {t for _, t in rows if t is not None}
    words = {t: {w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) >= LEAST} for t in texts}
    forms = {t: w | {x[:STEM] + "*" for x in w} for t, w in words.items()}
    n_entity, contexts, found = defaultdict(set), defaultdict(set), {}
    for t in texts:
        found[t] = []
        for start, kind, end, value, left, right in base(t):
            n_entity[kind, value].add(t)
            around = (re.findall(r"\S+|\s+", t[left:start])[-2 * AROUND :], re.findall(r"\S+|\s+", t[end:right])[: 2 * AROUND])
            near = [*core_words(t, left, start, lambda x: x[-2 * AROUND :]), *core_words(t, end, right, lambda x: x[: 2 * AROUND])]
            for w, s, e in near:
                found[t].append(((kind, value), w, s, e))
                for form in (w, w[:STEM] + "*"):
                    contexts[(kind, value), form].add(str(around))

    def tells(entity, form):
        seen, n, n_e = len(contexts[entity, form]), sum(form in forms[t] for t in texts), len(n_entity[entity])
        if seen < SUPPORT or n_e == len(texts):
            return False
        return math.log(min(seen, n, n_e) * len(texts) / (n * n_e)) / math.log(len(texts) / n_e) >= THRESHOLD

    out = []
    for doc, text in rows:
        spans = [x[:3] for x in base(text or "")]
        mine = {}
        for entity, w, s, e in found.get(text, []):
            if tells(entity, w):
                mine[s, e] = max(mine.get((s, e), 0), 5 if tells(entity, w[:STEM] + "*") else 4)
        said = lambda x: ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in sorted(x))
        counts = [sum(x[1] == k for x in spans) for k in range(4)]
        out.append((doc, *counts, hashlib.sha256(said(spans).encode()).hexdigest(), said([*spans, *((s, k, e) for (s, e), k in mine.items())])))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted(map(tuple, personal_data(spark.createDataFrame([(*r, 1, "clash", "x") for r in rows], SCHEMA)).collect()), key=str)


def test_patterns_equal_plain_ones(spark):
    rng = random.Random(1)
    bits = ["a", "B.c", "@", "x.y", ".", "-", " ", "  ", "+", "1", "25", "255", "256", "4111111111111111", "(", ")", "é", "😀", "_", "%", "\n", "999", "a@b.c", "1.2.3.4", "+1 (377) 555-0271", "4111 1111 1111 1111"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(1, 30)))) for k in range(2000)]
    rows += [(3000, "a@b.c_d@e.f"), (3001, "1.2.3.4.5.6.7.8"), (3002, "000001.02.3.4"), (3003, "+1" + "-" * 500 + "2"), (3004, None), (3005, ""), (None, "a@b.cd"), (7, "x@y.z"), (7, "x@y.z")]
    rows += [(4000, "1 " * 3_000), (4001, "a" * 3_000), (4002, "1" * 3_000), (4003, "a@" * 3_000 + "b.c"), (4004, "1." * 3_000), (4005, "x@y" + ".z" * 3_000), (4006, "+1" * 3_000)]
    assert run(spark, rows) == brute(rows)


def test_very_long_texts(spark):
    rows = [(1, "a" * 2_000_000), (2, "1" * 500_000), (3, "a@" * 200_000 + "b.c"), (4, "x@y" + ".z" * 200_000), (5, "+1" + " " * 500_000), (6, "1.2.3.4 " * 20_000)]
    counts = {r[0]: r[1:5] for r in run(spark, rows)}
    assert counts == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (1, 0, 0, 0), 5: (0, 0, 0, 0), 6: (0, 20_000, 0, 0)}


def planted():
    rng = random.Random(3)
    common = ["the", "house", "green", "walks", "over", "river", "under", "tree"]
    text = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(k, text(30)) for k in range(200)]
    rows += [(300 + k, f"{text(9)} Quorbane, {text(2)} zed@mail.example.org {text(3)} greffin {text(9)}") for k in range(8)]
    rows += [(400 + k, f"{text(9)} grenade {text(2)}") for k in range(30)]
    rows += [(500 + k, f"{text(9)} copied wordle 10.1.2.{k} {text(9)}") for k in range(20)]
    rows += [(600, "the only copied hapaxes near 99.1.2.3 here")] * 6
    return rows


def test_words_that_tell_equal_brute_force(spark):
    rows = planted()
    got = run(spark, rows)
    assert got == brute(rows)
    added = {g[0]: g[-1] for g in got if "general" in g[-1] or "removed" in g[-1]}
    assert set(added) == set(range(300, 308))  # a word beside many entities, and copies of one passage, tell nothing
    assert all("removed" in x and "general" in x for x in added.values())


def test_sanitised_texts(spark):
    rows = [*planted(), (1000, None), (1001, ""), (1002, "4111 1111 1111 1111, +4111111111111111 é😀 a@b.cd!")]
    frame = spark.createDataFrame([(*r, 1, "clash", "x") for r in rows], SCHEMA)
    done = sanitised(frame)
    assert done.columns == frame.columns
    texts = {r.doc_id: r.text for r in done.collect()}
    assert texts[1000] is None and texts[1001] == "" and texts[0] == rows[0][1]
    assert texts[1002].endswith(" é😀 [email]!") and "1111" not in texts[1002]
    assert "Quorbane" not in texts[300] and "gre* " in texts[300] and "[email]" in texts[300] and "..." in texts[300]
    assert done.count() == len(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(sum(g[1:5]) for g in got) > 0


def test_telling_words_go_everywhere_in_the_text(spark):
    rows = planted()
    far = "the house " * 30
    rows += [(700, f"{far}Quorbane; {far}zed@mail.example.org {far}(greffin) {far}é😀 QUORBANE"), (701, f"{far}Quorbane {far}"), (702, f"{far}Quorbane a@b.cd {far}")]
    got = {g[0]: g[-1] for g in run(spark, rows)}
    text = rows[-3][1]
    places = [(m.start(), m.end()) for m in re.finditer("Quorbane|greffin|QUORBANE", text)]
    said = {(int(s), int(e)) for kind, s, e in (x.split(":") for x in got[700].split(",")) if kind in ("general", "removed")}
    assert len(places) == 3 and set(places) == said
    assert got[701] == "" and "removed" not in got[702] and "general" not in got[702]
