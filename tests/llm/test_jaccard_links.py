"""The n-gram Jaccard join: types of ids, several texts of one id, cut blocks, and that links come from the search."""

import random

import pytest
from test_words import SCHEMA, brute_groups, frame, near_copies

from paperloom.llm import jaccard


def family(n, seed=9, size=60, most=6):
    """Copies of one text with a few words changed: some link, most do not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(size)] = f"x{rng.randrange(50)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("kind, make", [("int", int), ("long", int), ("string", lambda i: f"d{i:05d}")])
def test_ids_of_any_type(spark, kind, make):
    rows = near_copies(90)
    df = spark.createDataFrame([(make(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.join(df, words=3, num=90, den=100).collect()}
    assert got == {make(i): make(c) for i, (_, c) in brute_groups(rows, 3, 90, 100).items()}


@pytest.mark.parametrize("num, members, tile, limit", [(90, 64, 512, 400_000), (90, 5, 3, 400_000), (80, 7, 4, 400), (90, 3, 2, 100)])
def test_cut_blocks_lose_no_link(spark, num, members, tile, limit):
    rows = family(150) + [(1000 + i, t) for i, t in family(80, seed=10, size=45, most=4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), words=3, num=num, den=100, members=members, tile=tile, limit=limit).collect()}
    assert got == brute_groups(rows, 3, num, 100)


def test_an_id_with_two_texts_joins_nothing_by_itself(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other words here"), (1, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r["first"]) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA), words=3, num=90, den=100).collect())
    assert got == [(1, 58, 1, True), (1, 58, 1, True), (1, 58, 1, True), (2, 59, 1, False), (3, 59, 1, False), (4, 1, 4, True)]


def test_one_of_each_keeps_every_distinct_row(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(1, a), (1, b), (1, b + " end"), (2, a + " end"), (4, None), (4, None), (None, a), (None, "x"), (1, a), (5, ""), (6, "")]
    kept = jaccard.one_of_each(frame(spark, rows), words=3, num=90, den=100)
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    either = min((b, b + " end"), key=lambda t: spark.sql("SELECT xxhash64(:t) AS h", args={"t": t}).first().h)
    assert left == sorted([(1, a), (1, either), (4, None), (None, a), (None, "x"), (5, ""), (6, "")], key=str)


def test_links_come_from_the_search(spark, small, monkeypatch):
    """Over the documents table as one block: what the search finds is what links; without it nothing does."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in family(40)]
    want = brute_groups(rows, 3, 90, 100)
    rows = [(i, s) for i, t in rows if len(s := jaccard.shingles((t or "").encode(), 3))]
    found = jaccard.block_links([s for _, s in rows], [True] * len(rows), 90, 100)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in found:
        a, b = sorted((find(rows[x][0]), find(rows[y][0])))
        root[b] = a
    assert {i: find(i) for i, _ in rows} == {i: want[i][1] for i, _ in rows}
    assert any(find(i) != i for i, _ in rows if i < 10_000)
    monkeypatch.setattr(jaccard, "divide_skip", lambda *a: [])
    assert jaccard.block_links([s for _, s in rows], [True] * len(rows), 90, 100) == []


def test_equal_sets_alone(spark):
    rows = near_copies(60)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, SCHEMA), words=3, num=100, den=100).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 3, 100, 100).items()}
    with pytest.raises(ValueError, match="num / den"):
        jaccard.join(spark.createDataFrame(rows, SCHEMA), num=0)
