import pytest
from pyspark.sql import functions as F

from paperloom.plans.surrogate import Tables
from paperloom.sources import files, html
from paperloom.streaming import changes

PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><a href="/x">menu</a></nav>
<table><tr><th>Sr.</th><th>Subject of order</th><th>Date</th></tr>
<tr><td colspan=3>Section A</td></tr><tr><td>1</td><td>Fees &amp; charges <a href="a.pdf">PDF</a> <a href="b.pdf">Annex</a></td><td>1.2.2024</td></tr>
<tr><td>2<td>No end tags <a href="a.pdf">again</a><td>2.2.2024</tr></table>
<h2>Acts</h2><ul><li><a href="act.pdf">The Act (2.5 MB)</a><li><a href="rules.pdf">Rules</a></ul><p>Last&nbsp;line</p></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, '<a href="hub">Hub</a>')], "page_id int, html string")


def test_tables(pages):
    rows = html.table(pages)
    got = {(r.page_id, r.row_no): r for r in rows.collect()}
    assert set(got) == {(1, i) for i in range(4)}
    assert got[1, 2].cells == ["1", "Fees & charges PDF Annex", "1.2.2024"] and got[1, 3].cells[1] == "No end tags again"
    named = {r.row_no: r for r in html.by_header(rows, "page_id", {"title": ["subject", "title"], "date": ["date"], "gone": ["nothing"]}).collect()}
    assert (named[2].title, named[2].date, named[2].gone) == ("Fees & charges PDF Annex", "1.2.2024", None)
    assert {r.row_no: r.section for r in html.carried(rows, "page_id").collect()} == {0: None, 2: "Section A", 3: "Section A"}
    assert {(r.row_no, r.url) for r in html.one_per_link(rows, "page_id").collect()} == {(2, "a.pdf"), (2, "b.pdf")}
    assert {(r.row_no, r.title) for r in html.unpivoted(rows, "page_id").collect()} >= {(2, "1 - Subject of order"), (2, "1 - Date")}
    assert {(r.page_id, r.url) for r in html.hubs(pages).collect()} == {(4, "hub")}


def test_sections_and_text(pages):
    got = [tuple(r.s) for r in pages.filter("page_id = 1").select(F.explode(html.sections("html")).alias("s")).collect()]
    assert ("Acts", "act.pdf", "The Act", "2.5 MB") in got and ("Acts", "rules.pdf", "Rules", None) in got
    out = {r.page_id: r.t for r in pages.select("page_id", html.clean_text("html").alias("t")).collect()}
    assert "menu" not in out[1] and "no" not in out[1].split("\n")[0] and out[1].endswith("Last line") and "Fees & charges" in out[1] and out[2] is None and out[3] == ""


def test_cards(spark):
    card = lambda icon, extra, link: f'<div class="announcementbox"><span class="material-symbols-outlined">{icon}</span><p class="mb-0">Title</p>{extra}<small class="ptype" aria-label="05-01-2026"></small><div class="type-size"><small aria-label="1 MB"></small></div>{link}</div>'
    page = card("description", "", '<a id="btn-1" type="pdf" href="x.pdf">d</a>') + card("file_copy", '<div class="counter-box">5</div>', '<a class="btn download-btn" href="grp">g</a>')
    got = [tuple(r.c) for r in spark.createDataFrame([(page,)], "html string").select(F.explode(html.cards("html")).alias("c")).collect()]
    assert got == [("Title", False, None, "05-01-2026", "1 MB", "x.pdf"), ("Title", True, 5, "05-01-2026", "1 MB", "grp")]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title\n1,"two\nlines, ""q"""\n2\n3,x,y\n4,ok\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv"), ["id", "title"]).collect()] == [("1", 'two\nlines, "q"'), ("4", "ok")]
    (tmp_path / "b.json").write_text('[{"title": "a", "needs_download": true},\n {"title": "b"}]')
    assert sorted(r.title for r in files.json_array(spark, str(tmp_path / "b.json")).collect()) == ["a", "b"]
    df = spark.createDataFrame([(1, ["x", "y"], "drop")], "id int, tags array<string>, other string")
    files.write_csv(df, str(tmp_path / "c"), ["id", "tags", "none"])
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "c"), ["id", "tags", "none"]).collect()] == [("1", "x,y", None)]
    files.write_json(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 1


def test_feeds(spark):
    body = spark.createDataFrame([('{"data": {"rows": [{"Title": "a", "d": "1^2"}, {"name": "b"}]}}',)], "body string")
    got = files.feed_items(body, "body", "$.data.rows", {"title": ["Title", "name"], "d": ["d"]})
    assert [tuple(r) for r in got.collect()] == [("a", "1^2"), ("b", None)]
    assert tuple(got.select(files.packed_cell(F.col("d"), "^", ["x", "y", "z"]).alias("p")).first().p) == ("1", "2", None)
    deep = body.select(files.deep_list(F.col("body"), F.lit("Title")).alias("l")).first().l
    assert deep.startswith('[{"Title"')
    js = spark.createDataFrame([("doc('a','1'); doc('b','2');",)], "s string")
    got = js.select(F.explode(files.script_records(F.col("s"), {"t": r"doc\('(\w)", "n": r",'(\d)"})).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("a", "1"), ("b", "2")]
    nested = spark.createDataFrame([("s", [("g", [("n", ["x", "", "y"])])])], "site string, groups array<struct<g:string,items:array<struct<name:string,tags:array<string>>>>>")
    assert [tuple(r) for r in files.nested_items(nested, "groups", "items", ["tags"]).collect()] == [("s", "g", "n", "x; y")]


def test_paging(spark):
    p = spark.createDataFrame([("s", 1, "A", 10), ("s", 2, "B", 10), ("s", 3, "A", 10), ("s", 4, "C", 3), ("s", 5, "D", 10)], "site string, page int, body string, n int")
    assert sorted(r.page for r in files.without_repeats(p, "site", "page", F.col("body")).collect()) == [1, 2]
    assert sorted(r.page for r in files.until_short(p, "site", "page", F.col("n"), 10).collect()) == [1, 2, 3, 4]
    meta = spark.createDataFrame([("s", 5)], "site string, pages int")
    assert files.with_meta(p, meta, "site").count() == 5
    with pytest.raises(Exception, match="no sidecar"):
        files.with_meta(p, meta.filter("false"), "site").collect()
    new = files.unseen(p, p.filter("body = 'B'").select("body"), "body", ["page"])
    assert sorted((r.body, r.page) for r in new.collect()) == [("A", 1), ("C", 4), ("D", 5)]
    env = files.envelope(p.select("page", "body"), F.lit("now")).first().value
    assert '"count":5' in env
    with pytest.raises(Exception, match="too many"):
        files.envelope(p, F.lit("now"), 2).collect()


def _stream(spark, events, path):
    events.repartition(4).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 10).parquet(path)


def test_stream_change_log_equals_batch(spark, small, tmp_path):
    events = Tables(spark, small).events()
    log = changes.stream_change_log(_stream(spark, events, str(tmp_path / "in")))
    q = log.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("changes").select("document_id", "event_id", "field_changed", "old_value", "new_value").collect()}
    want = {tuple(r) for r in changes.change_log(events).drop("ts").collect()}
    assert got == want and len(want) > 100


def test_ingest_stream_adds_each_key_once(spark, small, tmp_path):
    events = Tables(spark, small).events().select("document_id", "event_id", "status")
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src) if _ else _stream(spark, events, src)
        changes.ingest_stream(stream, target, str(tmp_path / f"cp{_}"), ["document_id"]).awaitTermination()
        assert spark.read.parquet(target).count() == events.select("document_id").distinct().count()


def test_fingerprints(spark):
    items = spark.createDataFrame([(1, "a.pdf", True, "e", None), (2, "a.pdf", True, "new", "m"), (3, "a.pdf", False, None, None), (4, "page", True, "e", None), (5, "a.pdf", True, "e", "m"), (6, "a.pdf", True, "x", "y")], "document_id int, url string, head_ok boolean, etag string, last_modified string")
    held = spark.createDataFrame([(1, "e", None), (2, "old", "m"), (3, "e", None), (4, "e", None), (6, None, None)], "document_id int, etag string, last_modified string")
    assert {r.document_id: r.decision for r in changes.fingerprints(items, held).collect()} == {1: "unchanged", 2: "unchanged", 3: "failed", 4: "not_pdf", 5: "new", 6: "changed"}


def test_windowed_counts(spark, small, tmp_path):
    events = Tables(spark, small).events()
    assert changes.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_paged_source(spark):
    from paperloom.sources import paged

    paged.register(spark)
    df = spark.read.format("paged").options(fetch="paperloom.sources.paged:demo", pages="7", per_task="3").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.page, r.body) for r in df.collect()) == [(p, f"row {p}.{i}") for p in range(1, 8) for i in range(2)]


def test_retry():
    from paperloom.sources.retry import with_retry

    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("reset")
        return "done"

    assert with_retry(flaky, sleep=waits.append) == "done" and waits == [0.25, 1.0]
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError("bad input")), sleep=waits.append)
    with pytest.raises(TimeoutError):
        with_retry(lambda: (_ for _ in ()).throw(TimeoutError()), delays=(1,), sleep=waits.append)


def test_near_top(spark):
    from paperloom.functions import text

    df = spark.createDataFrame([(["a" * 50, "b" * 60, "c" * 30, "d" * 5], [1.0, 0.9, 0.5, 0.1])], "p array<string>, s array<double>")
    kept = lambda cap: [x[0] for x in df.select(text.near_top(F.col("p"), F.col("s"), cap).alias("k")).first().k]
    assert kept(1000) == ["a", "b", "c"] and kept(90) == ["a", "c"] and kept(10) == ["a", "b", "c", "d"]
    df2 = df.select(text.own_label(F.lit("PDF"), F.lit(" The order ")).alias("x"))
    assert df2.first().x == "The order"
