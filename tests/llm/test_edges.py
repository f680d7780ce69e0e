"""Edge cases and bounds of the training-data operators."""

import gzip
import io
import json
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_codecs import mixed, neighbours, with_clashes
from test_words import ROWS, SCHEMA, brute_ppm, frame, words

from paperloom.llm import arc, bpe, common, langid, lsh, mixing, ppm, quality, substring, token_counts
from paperloom.llm.queries import vocabulary


@pytest.mark.parametrize("master, fine", [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    from paperloom import session

    settings = {}
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=settings.__setitem__)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    for scratch in (common.scratch, session.scratch):
        settings.pop("spark.checkpoint.dir", None)
        if fine:
            assert "/checkpoints/x-" in scratch(spark, "x")
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                scratch(spark, "x")
        settings["spark.checkpoint.dir"] = "hdfs://store/shared"
        assert scratch(spark, "x").startswith("hdfs://store/shared/x-")


def found(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(f) for q, f in got.items()}


@pytest.mark.parametrize("n, kind", [(40, "float"), (256, "double"), (300, "float")])
def test_small_tables_are_hashed_too(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    assert lsh.fit(x.astype(float), n).k >= 1
    got, ids = found(lsh.search(df, lambda i: i % 10 == 0)), np.arange(n)
    hits = 0
    for q in range(0, n, 10):
        want = neighbours(x.astype(float), ids, q)
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(np.isclose(s, np.linalg.norm(x[q].astype(float) - x[v].astype(float)), rtol=1e-12) for _, v, s in got[q])
        hits += len({v for _, v, _ in got[q]} & {v for v, _ in want})
    assert hits >= 0.9 * 10 * len(range(0, n, 10))


def test_an_id_names_one_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [1.0, 0.1]), (2, [0.0, 5.1]), (2, [9.0, 9.0]), (3, [1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = found(lsh.search(df, lambda i: i == 0))
    assert [r for r, _, _ in got[0]] == [1, 2, 3] and sorted(v for _, v, _ in got[0]) == [1, 2, 3]
    again = found(lsh.search(df.repartition(2), lambda i: i == 0))
    assert again == got


def test_wall_sets_are_in_the_order_of_their_scores():
    k = 5
    sets = lsh.wall_sets(k, 60)
    j = np.arange(1, k + 1)
    far = 1 - (k + 1 - j) / (k + 1) + (k + 1 - j) * (k + 2 - j) / (4 * (k + 1) * (k + 2))
    cost = sets @ np.concatenate((j * (j + 1) / (4 * (k + 1) * (k + 2)), far))
    assert (np.diff(cost) >= -1e-12).all() and not sets[0].any() and len({s.tobytes() for s in sets}) == len(sets)
    assert not (sets & sets[:, ::-1]).any()  # both walls of a projection are never crossed


def test_letters_are_those_of_category_l(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    odd = ["½ ²", "Ⅷ ㊿ ٣", "— 🙂…", "ª", "x½", "日", "́̂", ""]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(with_clashes(spark, odd), model).collect()}
    assert [got[i][0] == "und" for i in range(8)] == [True, True, True, False, False, False, True, True]
    assert langid.predict(docs.filter("false"), model).count() == 0 and langid.keep(docs.filter("false"), model).count() == 0
    plain = Counter(r.lang_pred for r in langid.predict(docs, model).collect())
    dashed = Counter(r.lang_pred for r in langid.predict(docs.withColumn("text", F.regexp_replace("text", " ", " — ")), model).collect())
    assert plain == dashed


def test_training_reads_at_most_its_sample(spark):
    rows = [(i, "same text", "en") for i in range(300)] + [(i, f"text {i}", None) for i in range(300, 400)] + [(500, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.pick(df, "text", "lang", "doc_id", 50).count() == 50
    assert langid.pick(df, "text", "lang", "doc_id", 300).count() == 300
    many = spark.range(langid.MOST_LANGUAGES + 5).selectExpr("id AS doc_id", "'abc' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="languages"):
        langid.train(many)


def plainly_kept(text):
    """The verdict by a plain reading of the rules."""
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    lost = 0
    for line in (text or "").split("\n"):
        n = len(words(line))
        if not n:
            continue
        signs = len(re.findall(r"[#*$%&|<>]|!!", line))
        seps = len(re.findall(r"[|>»•·]", line))
        low = " ".join(line.lower().split())
        phrases = sorted((p for ps in quality.BOILERPLATE.values() for p in ps), key=len, reverse=True)
        taken = 0
        for p in phrases:
            low, k = re.subn(rf"(?<!\w){re.escape(p)}(?!\w)", "\x00", low)
            taken += k * len(p.split())
        bad = signs > 0.3 * n or (seps >= 2 and n - seps <= 3 * seps) or 2 * taken >= n or (n < 4 and not re.search(r"[.!?…;:\"'”’»)\]]\s*$", line))
        lost += n * bad
    return lost <= 0.5 * len(w)


def test_quality_verdicts_by_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    prose = " ".join(f"Sentence{i} number{i} says{i} a{i} thing{i}." for i in range(20))
    bad = ["Home | About | News", "Tous droits réservés.", "Read more", "Menu", "a# b$ c%"]
    rows += [(100_000 + i, "\n".join([prose] * (i % 2) + [f"{b} {j}" if b == "Menu" else b for j in range(40)])) for i, b in enumerate(bad)]
    rows += [(200_000, None), (200_001, ""), (200_002, " \n"), (200_003, "\n".join(f"Line {i} of a very long text ends here." for i in range(30_000))), (200_003, "\n".join(f"Line {i} of a very long text ends here." for i in range(30_000)))]
    got = sorted((r.doc_id, r.kept) for r in quality.judge(frame(spark, rows)).collect())
    assert got == sorted((i, plainly_kept(t)) for i, t in rows)
    assert {k for _, k in got} == {True, False}


@pytest.mark.parametrize("line, rule", [
    ("The design in this house is modern and bright.", None), ("The blog interface was changed last year.", None), ("The market share on the exchange fell sharply.", None),
    ("Children read more books in winter.", None), ("He ate a cookie.", None), ("Tous droits réservés.", "boilerplate"), ("Alle Rechte vorbehalten.", "boilerplate"),
    ("© 2024 Example. All rights reserved.", "boilerplate"), ("Todos los derechos reservados", "boilerplate"), ("Privacy Policy  Terms of Use  Contact us", "boilerplate"),
])
def test_boilerplate_lines(line, rule):
    assert quality.failure(line, len(words(line))) == rule


def test_ppm_of_long_texts_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BUCKET", 2000)
    rng = np.random.default_rng(0)
    vocab = [f"wort{i}" for i in range(50)] + ["é", "日本"]
    long = " ".join(vocab[i] for i in rng.integers(0, len(vocab), 110_000))
    assert len(long.encode()) > ppm.PIECE  # coded in several pieces
    rows = [(1, long), (2, long[:3000]), (3, "Wort1 neu"), (4, None)]
    got = {r.doc_id: r for r in ppm.score(frame(spark, rows, 2), F.col("doc_id") < 3, F.col("doc_id") >= 3).collect()}
    want = brute_ppm([long, long[:3000]], [t for _, t in rows], 5, 3)
    for (i, t), s in zip(rows, want):
        assert np.isclose(got[i].score, s, rtol=1e-9) and got[i].n_tokens == len(words(t)) + 1
    assert got[1].train_tokens == len(words(long)) + len(words(long[:3000])) + 2


@pytest.mark.parametrize("bucket, settled", [(300, 500_000), (5000, 3)])
def test_substring_dedup_in_many_buckets(spark, monkeypatch, bucket, settled):
    whole = sorted(map(tuple, substring.digests(frame(spark, ROWS)).collect()), key=str)
    monkeypatch.setattr(substring, "BUCKET", bucket)
    monkeypatch.setattr(substring, "SETTLED", settled)
    assert sorted(map(tuple, substring.digests(frame(spark, ROWS)).collect()), key=str) == whole


def test_substring_ids_with_several_texts_keep_them(spark):
    p = " ".join(f"p{i}" for i in range(40))
    rows = [(1, p), (2, p + " two"), (3, "three " + p), (3, p + " drei"), (4, p), (4, p)]
    got = Counter((r.doc_id, r.n_removed) for r in substring.digests(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == {(1, 0): 1, (2, 40): 1, (3, 0): 2, (4, 40): 2}


def test_windows_are_told_apart_by_checks_too():
    h = np.arange(1, 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = substring.checks(h, 13)
    assert len(c) == 87 and len(set(c.tolist())) == 87 and (substring.checks(h[5:40], 13) == c[5:28]).all() and len(substring.checks(h[:5], 13)) == 0


def test_archives_of_both_kinds_are_read(spark, tmp_path):
    rows = [("http://h/a b", b"x\nhttp://h 0.0.0.0 2 text/html 3\n"), (None, b""), ("http://h/#part", bytes(range(256)) * 20)]
    (tmp_path / "a.arc").write_bytes(arc.arc_file(rows, 1))
    parts = [arc.version_block(2, "20240101000000", "b.arc")] + [arc.arc_record(u, p, 2, "20010203040506", "b.arc", 0) for u, p in rows]
    (tmp_path / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # a member a record
    (tmp_path / "c.arc.gz").write_bytes(gzip.compress(arc.arc_file(rows[:1], 2)))
    got = arc.read_arc(spark, str(tmp_path)).collect()
    by_file = defaultdict(list)
    for r in sorted(got, key=lambda r: r.place):
        by_file[r.file.rsplit("/", 1)[1]].append((r.url, bytes(r.payload), r.date))
    assert [p for _, p, _ in by_file["a.arc"]] == [p for _, p in rows] == [p for _, p, _ in by_file["b.arc.gz"]]
    assert by_file["b.arc.gz"][0][::2] == ("http://h/a%20b", "2001-02-03T04:05:06Z") and len(by_file["c.arc.gz"]) == 1
    ids = {r.id for r in arc.with_ids(arc.read_arc(spark, str(tmp_path))).collect()}
    assert len(ids) == 7 and all(re.fullmatch("[0-9a-f]{64}", i) for i in ids)


def test_warc_is_readable_by_its_standard_headers(spark, tmp_path):
    same = "s" * 100
    df = spark.createDataFrame([(5, "http://h/5#top", same), (7, "http://h/7", same), (None, "http://h/n", "é")], "page_id long, url string, html string").coalesce(1)
    arc.write_arc(df, f"{tmp_path}/arc")
    records = arc.typed(arc.with_ids(arc.read_arc(spark, f"{tmp_path}/arc"), df.schema["page_id"].dataType))
    arc.write_warc(records, f"{tmp_path}/warc")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "warc").glob("*.gz"))).decode()
    heads = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:]) for h in re.findall(r"WARC/1\.1\r\n.*?(?=\r\n\r\n)", text, re.S)]
    assert heads[0]["WARC-Type"] == "warcinfo"
    revisit = next(h for h in heads if h["WARC-Type"] == "revisit")
    assert arc.id_of(revisit["WARC-Record-ID"]) == "7" and arc.id_of(revisit["WARC-Refers-To"]) == "5"
    assert revisit["WARC-Refers-To"] in {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert {h["WARC-Target-URI"] for h in heads[1:]} == {"http://h/5#top", "http://h/7", "http://h/n"}
    assert not [k for h in heads for k in h if not k.startswith(("WARC-", "Content-"))]
    one = [bytes(r.member) for r in arc.members(records).collect()]
    assert len(one) == 3 and all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in one)
    assert len(re.findall(b"WARC/1.1\r\n", gzip.GzipFile(fileobj=io.BytesIO(b"".join(one))).read())) == 3


@pytest.mark.parametrize("kind, ids", [("string", ["a:b c/ü", "=x", "+", "%41"]), ("int", [1, 2, 3, -4])])
def test_through_warc_keeps_ids_of_any_type(spark, kind, ids):
    df = spark.createDataFrame([(i, "http://h", f"page {k}") for k, i in enumerate(ids)], f"page_id {kind}, url string, html string")
    got = arc.through_warc(df)
    assert got.schema["page_id"].dataType.simpleString() == kind and {r.page_id for r in got.collect()} == set(ids)


def test_mixing_orders_rows_that_share_an_id(spark):
    rows = [(1, "a", "x " * 3), (1, "a", "y " * 5), (1, "a", "z " * 3), (2, "a", "w")] * 2
    schema = "doc_id long, source string, text string"
    one, two = (sorted((r.doc_id, r.start, r.n_tokens) for r in mixing.mix(spark.createDataFrame(rows[::o], schema).repartition(n)).collect()) for o, n in ((1, 2), (-1, 3)))
    assert one == two and len(one) == 8


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixed(spark, [(i, f"s{i}", "a b") for i in range(4)])


@pytest.mark.parametrize("change, why", [
    (lambda s: s.update(normalizer={"type": "NFC"}), "normalizer"),
    (lambda s: s["pre_tokenizer"].update(add_prefix_space=True), "split"),
    (lambda s: s.update(pre_tokenizer={"type": "Whitespace"}), "split"),
    (lambda s: s["model"].update(byte_fallback=True), "model"),
    (lambda s: s["added_tokens"][0].update(lstrip=True), "added tokens"),
])
def test_other_tokenizer_files_are_refused(change, why):
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check(spec)
    change(spec)
    with pytest.raises(ValueError, match=why):
        bpe.check(spec)


def test_token_counts_of_texts_above_the_split(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat  on\na mat, à côté. " * 40_000, "x" * 1_200_000, "日本 " * 400_000, None, ""]
    got = {r.doc_id: r for r in token_counts.count_tokens(with_clashes(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(sp.encode(t or "")))
    assert token_counts.count_tokens(with_clashes(spark, texts).filter("false"), path).count() == 0
