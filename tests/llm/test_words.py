"""Operators on words against brute force: scoring, joins, substrings, quality."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import graph, jaccard, ppm, quality, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}) if lower else text)


def corpus(n=120, seed=5):
    """Texts from phrases that repeat, with nulls, empties, odd spaces, repeated rows and a long one."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["École", "日本", "A", "a", "naïve\x1fx", " "]
    phrases = [[rng.choice(vocab) for _ in range(rng.randint(3, 60))] for _ in range(15)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 6)):
            out += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 20))]
        rows.append((i * 2, rng.choice(["", "\n", " \t"]) + rng.choice([" ", "  ", "\n"]).join(out)))
    long = " ".join(rng.choice(vocab) for _ in range(20_000))
    rows += [(900, None), (901, ""), (902, " \n\t "), (None, rows[3][1]), (903, long), (904, long + " end"), rows[5], rows[50], (905, "A b"), (906, "a B"), (907, "b a")]
    return rows


ROWS = corpus()


def frame(spark, rows, n=5):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(n)
    for c in ("id", "n", "hash", "runs", "part", "chunk", "kind", "component", "toks", "_t", "c", "key"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("window, held", [(13, 1_500_000), (13, 100), (2, 100), (20, 150), (45, 300)])
def test_substring_dedup(spark, monkeypatch, window, held):
    monkeypatch.setattr(substring, "HELD", held)
    first = {}
    for i, t in ROWS:
        if i is not None:
            w = words(t)
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in ROWS:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    df = frame(spark, ROWS)
    got = [tuple(r) for r in substring.digests(df, window=window).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = substring.cleaned(df, window=window)
    assert cut.columns == df.columns
    left = Counter((r.doc_id, len(words(r.text))) for r in cut.collect())
    assert left == Counter((i, n - m) for i, n, m, _ in want)


def test_substring_levels():
    assert substring.lengths(13) == [7, 13] and substring.lengths(50) == [7, 13, 25, 50] and substring.lengths(2) == [2]


def test_substring_empty_table_and_growth(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.digests(empty).count() == 0 and substring.cleaned(empty).count() == 0
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p), (2, "x " + p + " y"), (3, " ".join(p.split()[:20]))]
    got = {(r.doc_id, r.length): r.windows for r in substring.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 13): 48, (3, 13): 8, (2, 26): 35, (2, 52): 9}


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = words(t, True)
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and t and den * len(s & t) >= num * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n=200, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 3, " ".join(w[rng.randint(0, 2) :])))
    return rows


@pytest.mark.parametrize("rows, k, num, limit", [(ROWS, 3, 90, jaccard.LIMIT), (ROWS, 5, 80, 2000), (near_copies(), 3, 90, jaccard.LIMIT), (near_copies(), 3, 90, 1500), (near_copies(), 2, 70, 900)])
def test_jaccard_join(spark, rows, k, num, limit):
    got = jaccard.join(frame(spark, rows), words=k, num=num, den=100, limit=limit).collect()
    want = brute_groups(rows, k, num, 100)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divide_skip():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 25))) for _ in range(rng.randint(1, 30))]
        need = rng.randint(1, len(lists))
        n = Counter(x for one in lists for x in one)
        assert sorted(jaccard.divide_skip(lists, need)) == sorted(x for x, c in n.items() if c >= need)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_ppm(train, texts, order, least):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    seq = lambda t: [255] * order + list(" ".join(words(t, True)).encode()) + [254]
    for t in train:
        s = seq(t)
        for p in range(order, len(s)):
            for j in range(order + 1):
                counts[j][tuple(s[p - j : p])][s[p]] += 1

    def step(s, p):
        out, lp = set(), 0.0
        for j in range(order, -1, -1):
            c = counts[j].get(tuple(s[p - j : p]))
            if not c or (j and sum(c.values()) < least):
                continue
            rest = {a: n for a, n in c.items() if a not in out}
            if not rest:
                continue
            n = sum(rest.values())
            if s[p] in rest:
                return lp + math.log10((2 * rest[s[p]] - 1) / (2 * n))
            lp, out = lp + math.log10(len(rest) / (2 * n)), set(c)
        return lp - math.log10(255 - len(counts[0].get((), ())))

    return [sum(step(s, p) for p in range(order, len(s))) for s in map(seq, texts)]


@pytest.mark.parametrize("order, least", [(5, 3), (3, 1), (6, 2)])
def test_ppm(spark, order, least):
    rows = [r for r in ROWS if not (r[1] and len(r[1]) > 20_000)]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = ppm.score(frame(spark, rows), ~held, held, order=order, least=least).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if i is not None and not is_held(i)]
    tokens = lambda t: [*words(t, True), "\n"]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    scores = brute_ppm(train, [t for _, t in rows], order, least)
    want = sorted(((i, is_held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), s) for (i, t), s in zip(rows, scores)), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-5)


def test_ppm_without_training_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], SCHEMA)
    got = {r.doc_id: r for r in ppm.score(df, F.lit(False), F.lit(True)).collect()}
    assert math.isclose(got[1].score, -3 * math.log10(255), rel_tol=1e-6) and got[2].n_tokens == 1 and got[1].n_known == 0
    assert ppm.score(df.filter("false"), F.lit(True), F.lit(False)).count() == 0


def test_ppm_is_a_distribution():
    """Next-symbol probabilities after any context sum to one."""
    text = [b"abracadabra", b"abrabra cad"]
    low_codes = np.concatenate([c for c, _ in ppm.strings(text, 2)])
    low = np.unique(low_codes, return_counts=True)
    codes = np.concatenate([c for c, _ in ppm.strings(text, 4)])
    for context in (b"abra", b"zzzz", b"xabr", b"cada"):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        every = np.unique(np.concatenate((codes, base + np.arange(255, dtype=np.uint64))))
        n = np.array([(codes == x).sum() for x in every])
        p = ppm.code_lengths(every, n, (low[0], low[1]), 4, 2)
        assert math.isclose((10 ** p[(every >> np.uint64(8)) == (base >> np.uint64(8))]).sum(), 1.0, rel_tol=1e-9)


def test_quality_base(spark):
    rows = ROWS + [(1000, "good words here. " * 30), (1001, "\n".join(["Same line of text here."] * 9 + ["Another line."])), (1002, "a### b$$$ c%%% " * 40), (1003, "Home | About | News | Contact\n" * 10 + " ".join(f"word{i}" for i in range(60)) + ".")]
    got = sorted((tuple(r)[:7] for r in quality.judge(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = words(t)
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        rep = {j + d for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] >= 2 for d in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert got == sorted(want, key=str)


def test_quality_verdicts(spark):
    prose = " ".join(f"Sentence{i} number{i} says{i} a{i} thing{i}." for i in range(20))
    nav = "\n".join(f"Home | Page{i} | News | Contact | Sitemap{i}" for i in range(30))
    rows = [(1, prose), (2, nav), (3, prose + "\n" + "Home | About | News | Contact"), (4, prose + "\nAll rights reserved."), (5, " ".join(f"w{i}$$$" for i in range(80)))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, True, True, False]
    assert got[3].clean_text == prose == got[4].clean_text and got[3].failed_lines == 1
    assert quality.failure("All rights reserved.", 3) == "boilerplate" and quality.failure("Menu", 1) == "fragment" and quality.failure("Yes.", 1) is None
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
