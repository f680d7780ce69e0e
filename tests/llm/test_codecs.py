"""Tokenizers, languages, archives, mixing and neighbours."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import arc, bpe, langid, lsh, mixing, token_counts
from paperloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string"


def odd_texts():
    rng = random.Random(0)
    bits = ["ab", "the", " ", "  ", "\n", "é", "日", "'s", "1²", "!!", "<|endoftext|>", "\x1c", "\xa0", "🙂", "▁", "\r\n", "\t", "<s>", "ﬁ", "\x00"]
    out = ["".join(rng.choice(bits) for _ in range(150)) for _ in range(120)]
    out += ["".join(rng.choice("abcetaoinéñ") for _ in range(4000)) for _ in range(8)]
    out += ["a" * 2000 + "b" + " " * 3000 + "!" * 1500 + "日本" * 700 + "1" * 999, "🙂" * 1500, "", " ", None, "ab", "ab"]
    return out


def with_clashes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    for c in ("n_tokens", "ids", "score", "id", "n", "lang_pred"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("leaf", [8, 64, 256])
def test_bpe_equals_the_library(spark, leaf):
    from tokenizers import Tokenizer

    path, texts = vocabulary("byte_bpe_50k.json"), odd_texts()
    t = Tokenizer.from_file(path)
    df = with_clashes(spark, texts)
    got = {r.doc_id: r for r in bpe.encode(df, path, leaf=leaf).collect()}
    digests = {r.doc_id: r for r in bpe.round_trip(df, path, leaf=leaf).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, path, leaf=leaf), path).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert back[i] == (text or "") == t.decode(ids, skip_special_tokens=False)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_character_classes():
    codec = bpe.Codec(vocabulary("byte_bpe_50k.json"))
    for o in range(0x250):
        c = chr(o)
        for s in (f"a{c}b", f"1{c}2", f" {c}{c}", f"{c}  x", f"!{c}", f"{c}\n"):
            if not bpe.RARE.search(s):
                assert codec.pieces(s) == [s[a:b] for _, (a, b) in codec.t.pre_tokenizer.pre_tokenize_str(s)]


def test_bpe_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("split", [20, 300, 1 << 20])
def test_token_counts(spark, split):
    import sentencepiece

    path, texts = vocabulary("piece_bpe_32k.model"), odd_texts() + ["a b\nc d\n\n e" * 60, " x  y" * 90]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts.count_tokens(with_clashes(spark, texts), path, limit=100, split_bytes=split).collect()}
    for i, text in enumerate(texts):
        n = len(sp.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100)


def test_language_accuracy_and_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.train(docs.filter(~held))
    rows = docs.filter(held).join(langid.predict(docs, model), "doc_id")
    assert rows.filter("lang = lang_pred").count() >= 0.97 * rows.count()
    assert rows.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    odd = with_clashes(spark, [None, "", "123 !!! 456", "\n\t", "日本語", "the"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(4)) and got[4][0] in model.names and got[5][0] in model.names
    assert sorted(r.doc_id for r in langid.keep(odd, model).collect())[:1] not in ([0], [1])
    en = docs.filter("lang = 'en'").first().text[:400]
    fr = docs.filter("lang = 'fr'").first().text[:400]
    spans = langid.label_spans(spark.createDataFrame([(1, en + " " + fr)], SCHEMA), model).first().spans
    assert [s.lang for s in spans] == ["en", "fr"]
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = rng.integers(1, 12), rng.integers(1, 4)
        s = rng.normal(size=(n, m)) * rng.choice([0.5, 3])
        if rng.random() < 0.5:
            s[:, 0] += 2
        pen = float(rng.choice([0.5, 2, 5]))
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - pen * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = np.full(m, 0.0) + s[0]
        for i in range(1, n):
            best = np.maximum(best, best.max() - pen) + s[i]
        assert math.isclose(value(langid.viterbi(s, pen).tolist()), best.max(), abs_tol=1e-9)


def test_arc_versions_and_round_trip():
    rows = [("http://h/a b", b"x\nhttp://h 0.0.0.0 2 text/html 3\n"), (None, b""), ("http://h/\xe9", "日本\r\n\r\nWARC/1.1\r\n".encode())]
    for version in (1, 2):
        got = list(arc.parse_arc(arc.arc_file(rows, version)))
        assert [b.removeprefix(arc.HTTP) for _, b in got] == [p for _, p in rows]
        assert got[0][0]["URL"] == "http://h/a%20b" and len(got[0][0]) == len(arc.ARC_FIELDS[version])
    data = arc.arc_file(rows, 2)
    with pytest.raises(ValueError, match="shorter"):
        list(arc.parse_arc(data[: -len(arc.HTTP)]))
    with pytest.raises(ValueError, match="version block"):
        list(arc.parse_arc(data.replace(b"Result-code", b"Result", 1).replace(b" 194\n", b" 189\n")))


def test_through_warc(spark):
    same, tricky = "s" * 100, "t" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" + "u" * 60
    texts = {1: same, 2: same, 3: "s" * 99, 4: "s" * 99, 5: None, 6: "", 7: tricky, 8: tricky, 9: "é" * 50, 10: "é" * 50, 11: "z" * 50_000}
    rows = [(i, f"http://h/{i}", t) for i, t in texts.items()] + [(2, "http://h/2", same), (None, None, "n" * 200), (1, "http://h/1", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = sorted((tuple(r) for r in arc.through_warc(df).collect()), key=str)
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(first.get(t, i), i)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        f = first.get(t)
        refers = f if f is not None and i != f and len(raw) >= 100 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=str)
    assert arc.through_warc(df.filter("false")).count() == 0


def mixed(spark, rows, **how):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), **how).collect()


def test_mixing_meets_entropy_and_quota(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    rng = random.Random(4)
    rows = [(i, f"s{0 if rng.random() < 0.6 else rng.randrange(1, 6)}", "w " * rng.randint(0, 40)) for i in range(600)]
    goal, got = 0.8, None
    got = mixed(spark, rows, target="entropy", goal=goal, budget=8000)
    w = {r.source: r.weight for r in got}
    assert math.isclose(-sum(p * math.log(p) for p in w.values()) / math.log(len(w)), goal, abs_tol=1e-6) and math.isclose(sum(w.values()), 1, abs_tol=1e-6)
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += len(t.split())
    streams = defaultdict(list)
    for r in got:
        streams[r.source].append((r.start, r["pass"], r.doc_id, r.n_tokens))
    for s, taken in streams.items():
        quota, at = round(w[s] * 8000), 0
        for start, k, _, n in sorted(taken, key=lambda x: (x[0], x[3])):
            assert start == at and start // max(tokens[s], 1) in (k, k + 1) and start < quota
            at += n
        assert at >= quota
        ids = [sorted(d for _, k, d, _ in taken if k == p) for p in range(max(k for _, k, _, _ in taken))]
        assert all(x == sorted(i for i, t, _ in rows if t == s) for x in ids)  # full passes hold every document once


def test_mixing_limits_repeats_and_loses_nothing(spark):
    rows = [(i, "big" if i < 200 else "small" if i < 220 else None, "a b c") for i in range(230)] + [(500, "void", None), (501, "void", ""), (7, "big", "a b c")]
    got = mixed(spark, rows, target="repeats", goal=3.0)
    times = Counter(r.doc_id for r in got)
    assert set(times) == {i for i, _, _ in rows}
    assert times[0] == 1 and times[7] == 2 and 2 <= times[205] <= 3 and 3 <= times[225] <= 4 and times[500] == 1
    again = mixed(spark, rows, target="repeats", goal=3.0)
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixed(spark, []) == []
    assert {r.doc_id for r in mixed(spark, [(1, "s", None), (2, None, "")])} == {1, 2}


def test_mixing_is_native(spark, small):
    df = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def neighbours(x, ids, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    d[ids == ids[i]] = np.inf
    order = np.lexsort((ids, d))
    return [(ids[j], d[j]) for j in order[:k] if np.isfinite(d[j])]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 24))
    x[:600] = x[0]  # one vector that many rows share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(5).withColumn("x", F.lit(1)).withColumn("id", F.lit(1))
    got = defaultdict(list)
    for r in lsh.search(df, lambda i: i % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    assert sorted(got) == list(range(0, 4000, 100))
    for q, found in got.items():
        found.sort()
        want = neighbours(x, ids, q)
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        assert sorted(found, key=lambda f: (f[2], f[1])) == found and all(v != q for _, v, _ in found)
        assert all(math.isclose(s, math.dist(x[q], x[v]), rel_tol=1e-12, abs_tol=1e-15) for _, v, s in found)
        hits, total = hits + len({v for _, v, _ in found} & {v for v, _ in want}), total + len(want)
        if q < 600:  # ties at distance zero go to the smallest ids
            assert [v for _, v, _ in found] == [v for v, _ in want]
    assert hits >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in lsh.search(df, lambda i: i % 100 == 0).collect())
    s = round(math.sqrt(2), 6)
    assert got == [(0, 1, 8, 0.0), (0, 2, 100, 0.0), (0, 3, 1, s), (100, 1, 0, 0.0), (100, 2, 8, 0.0), (100, 3, 1, s)]
    assert lsh.search(df.filter("false"), lambda i: i % 100 == 0).count() == 0
    alone = lsh.search(df.filter("vec_id = 1"), lambda i: i == 1)
    assert alone.count() == 0


def test_cells_above_the_limit_are_split(spark, monkeypatch):
    monkeypatch.setattr(lsh, "LIMIT", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in lsh.search(df, lambda i: i % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    for q in (0, 100, 200):
        assert [v for _, v in sorted(got[q])] == [v for v, _ in neighbours(x, np.arange(240), q)]


def test_pipeline(spark, small):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "passages", "mixture", "encoding"]
    prose = lambda i: " ".join(f"thing{i}x{j} the and of" for j in range(40))
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [(i, prose(i), "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(50, prose(3), "en", "s0", 1), (51, prose(4) + " extra", "en", "s0", 1), (52, prose(60) + " " + passage, "en", "s1", 1), (53, passage + " " + prose(61), "en", "s1", 1), (54, "123 456", None, "s0", 1), (55, None, "en", None, 1), (56, prose(70), None, None, None), (57, prose(71), "fr", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_id", F.lit("clash")).withColumn("id", F.lit(0))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert kept == {r[0] for r in rows} - {54, 55}
        if name == "near_duplicates":
            assert kept == {r[0] for r in rows} - {50, 51, 54, 55}
        if name == "passages":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert passage in texts[52] and texts[53] == prose(61) and texts[0] == prose(0) and texts[56] == prose(70)
        if name in ("mixture", "encoding"):
            assert kept == {r[0] for r in rows} - {50, 51, 54, 55}
    assert docs.columns == ["doc_id", "n_tokens", "ids"]


def test_registered_queries_return_their_contract(spark, small):
    from paperloom.llm import queries

    want = {
        "op1_ppm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op2_multiprobe": ["query_id", "rank", "vec_id", "score"],
        "op4_arc_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_jaccard": ["doc_id", "n_shingles", "component_id"],
        "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op10_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, small)
        assert df.columns[: len(columns)] == columns
        if name not in ("op2_multiprobe", "op4_arc_warc"):
            assert df.count() == n
    assert os.path.isdir(small)
