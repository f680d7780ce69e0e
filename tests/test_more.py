"""Adapters, sources that end by themselves, change capture, fuzzy clusters against the plain pass."""

import random
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from paperloom import queries
from paperloom.functions import text, urls
from paperloom.operators import audit, dedup, ingest, maintain, registry
from paperloom.schemas import NORMALIZED, enum_violations
from paperloom.sources import paged
from paperloom.streaming import changes


def one(spark, code, row, extra=""):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'map<string,string>' if isinstance(v, dict) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items()) + extra
    df = ingest.ADAPTERS[code](spark.createDataFrame([tuple(row.values())], schema))
    assert df.schema.fieldNames() == NORMALIZED.fieldNames() and [f.dataType for f in df.schema] == [f.dataType for f in NORMALIZED]
    return df.first()


CASES = [
    ("detail-page-feed", {"id": "1", "title": "T", "link": "http://d", "pdf_link": "http://f.pdf", "date": "Mar 05, 2024", "category": "c", "scraped_at": "s"}, {"published_date": "2024-03-05", "source_url": "http://d", "file_url": "http://f.pdf", "file_extension_hint": "pdf", "needs_download": True, "category_hint": "c"}),
    ("detail-page-feed", {"id": "1", "title": "T", "link": None, "pdf_link": "", "date": "soon", "category": None, "scraped_at": "s"}, {"published_date": "soon", "source_url": "", "file_url": None, "file_extension_hint": None, "needs_download": False}),
    ("file-only-feed", {"id": "1", "title": "T", "pdf_link": "u", "publish_date": "03/05/2024", "category": "c", "scraped_at": "s"}, {"published_date": "2024-03-05", "source_url": "u"}),
    ("file-only-feed", {"id": "1", "title": "T", "pdf_link": "u", "publish_date": "25/03/2024", "category": "c", "scraped_at": "s"}, {"published_date": "25/03/2024"}),
    ("petition-orders", {"id": "1", "subject": "", "petition_no": "9/2024", "date_order": "", "date_posted": "05.03.2024", "category": "c", "pdf_url": "u", "pdf_digest": "d", "scraped_at": "s"}, {"title": "9/2024", "published_date": "2024-03-05", "raw_text": "d", "raw_text_source": "pdf_excerpt", "needs_download": False}),
    ("petition-regulations", {"id": "1", "reg_name": "R", "noti_pdf_url": "u", "pdf_digest": None, "scraped_at": "s"}, {"published_date": None, "category_hint": "Regulation", "needs_download": True, "raw_text_source": None}),
    ("tribunal-judgments", {"id": "1", "cause_title": "A v B", "petition_no": "9", "date_of_decision": "", "date_uploaded": "01.02.2023", "pdf_url": "u", "pdf_text": "", "scraped_at": "s"}, {"title": "A v B", "published_date": "2023-02-01", "needs_download": True, "category_hint": None}),
    ("tribunal-judgments", {"id": "1", "cause_title": "", "petition_no": "9", "date_of_decision": "", "date_uploaded": "", "pdf_url": "u", "pdf_text": "x", "scraped_at": "s"}, {"title": "9", "published_date": None, "needs_download": False}),
    ("multi-body-records", {"id": "1", "title": "Expo", "url": "", "source": "BODY", "category": "EVENTS", "published_date": "2024-01-01", "details": {"Venue": "Hall", "Fee": " "}, "listing_url": "http://l", "status": "", "scraped_at": "s"}, {"published_date": None, "source_url": "http://l", "category_hint": "BODY_EVENTS", "raw_text": "Venue: Hall", "needs_download": False, "status_hint": None}),
    ("multi-body-records", {"id": "1", "title": "Tender", "url": "http://f.pdf", "source": "BODY", "category": "TENDERS", "published_date": "2024-01-01", "details": {"A": "b"}, "listing_url": "http://l", "status": "Open", "scraped_at": "s"}, {"published_date": "2024-01-01", "file_url": "http://f.pdf", "raw_text": None, "needs_download": True, "status_hint": "Open"}),
    ("service-circulars", {"title": "T", "file_url": "http://f.pdf", "listing_url": "http://l?page=7", "site_category": "c", "issued_by": "b", "services_path": "", "published_date": "5 March 2024", "scraped_at": "s"}, {"source_url": "http://l", "published_date": "2024-03-05", "category_hint": "c | b"}),
    ("programme-calls", {"source_id": "1", "source_cluster": "calls", "listing_url": "http://l", "title": "T", "file_url": "", "html_url": "http://node/1", "published_date": None, "status_hint": "Open", "scraped_at": "s"}, {"file_url": "http://node/1", "source_url": "http://node/1", "status_hint": "Open", "needs_download": True}),
    ("reference-listing", {"id": "1", "category": "c", "short_description": "D", "reference_no": "R/1", "last_updated": "05-03-2024", "detail_page": "", "pdf_link": "http://f.pdf", "scraped_at": "s"}, {"title": "D [R/1]", "published_date": "2024-03-05", "source_url": "http://f.pdf"}),
    ("card-listing", {"title": "T", "is_group": False, "published_date_raw": "05.03.2024", "link": "http://f.pdf", "listing_url": "http://l", "scraped_at": "s"}, {"published_date": "2024-03-05", "source_url": "http://l"}),
    ("category-table", {"title": "T", "category": "", "date": "5-Mar-2024", "detail_link": "http://d", "file_link": "", "scraped_at": "s"}, {"published_date": "2024-03-05", "category_hint": None, "needs_download": False}),
    ("faq-listing", {"faq_id": "7", "title_text": "Q", "published_date": "Mar 05, 2024", "category": "c", "url": "http://q", "pdf_link": "", "scraped_at": "s"}, {"source_id": "7", "published_date": "2024-03-05", "file_url": None, "needs_download": True}),
]


@pytest.mark.parametrize("code, row, want", CASES)
def test_adapters(spark, code, row, want):
    got = one(spark, code, row)
    assert got.regulator_code == code and {k: got[k] for k in want} == want


def test_a_group_card_must_be_expanded(spark):
    row = {"title": "T", "is_group": True, "published_date_raw": "05.03.2024", "link": "u", "listing_url": "l", "scraped_at": "s"}
    with pytest.raises(Exception, match="expanded"):
        one(spark, "card-listing", row)


def test_grouped_notices_prefer_the_archive(spark):
    rows = [(1, "Type approval for devices (Active)", "a.pdf", "p", "home", "", "", "s"), (2, "Type approval for devices", "b.pdf", "p", "archive", "Active", "", "s"), (3, "Something else", "", "p", "home", "", "", "s")]
    df = spark.createDataFrame(rows, "position long, title string, pdf_link string, source_page string, source_section string, status string, listed_date string, scraped_at string")
    got = sorted((r.title, r.file_url, r.status_hint, r.published_date, len(r.source_id)) for r in ingest.ADAPTERS["grouped-notices"](df).collect())
    assert got == [("Something else", None, None, None, 16), ("Type approval for devices", "b.pdf", "Active", None, 16)]


def plain_clusters(rows, threshold=0.85):
    """One greedy pass over each feed, as the rule says it."""
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", re.sub(r"\(expired\)|\(active\)", "", t.lower()))).strip(" ")
    groups, out = {}, {}
    for feed, p, title, date, status in sorted(rows, key=lambda r: (r[0], r[1])):
        t, date, status = norm(title), (date or "").strip(), (status or "").strip()
        for g in groups.setdefault(feed, []):
            fits = not (date and g[2] and date != g[2]) and not (status and g[3] and status != g[3])
            if fits and (t == g[1] or SequenceMatcher(None, t, g[1]).ratio() >= threshold):
                g[2], g[3] = g[2] or date, g[3] or status
                out[feed, p] = g[0]
                break
        else:
            groups[feed].append([p, t, date, status])
            out[feed, p] = p
    return out


@pytest.mark.parametrize("seed, tile", [(1, 512), (2, 7), (3, 20)])
def test_fuzzy_clusters_equal_the_plain_pass(spark, seed, tile):
    rng = random.Random(seed)
    words = "notice of the extension last date for filing returns under scheme rules 2024 amendment order public draft".split()
    bases = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    rows = []
    for p in range(150):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abc xyz.")
        rows.append((rng.choice(["f", "f", "g", "h"]), p, "".join(t), rng.choice(["", "", "2024-01-01", "2024-02-02"]), rng.choice(["", "Active", "Expired", None])))
    df = spark.createDataFrame(rows, "feed string, position long, title string, listed_date string, status string").repartition(3)
    got = {(r.feed, r.position): r.cluster for r in dedup.fuzzy_clusters(df, tile=tile).collect()}
    assert got == plain_clusters(rows)


@pytest.mark.parametrize("seed, longest", [(1, 60), (2, 9), (3, 150)])
def test_candidates_hold_every_pair_of_alike_titles(seed, longest):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abc dé9_漢") for _ in range(rng.randint(0, longest))) for _ in range(15)]
    titles = set(bases)
    for _ in range(150):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            t.insert(rng.randrange(len(t) + 1), rng.choice("abc xyz"))
            t.pop(rng.randrange(len(t)))
        titles.add("".join(t))
    titles = sorted(titles, key=lambda t: rng.random())
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.85
    half = len(titles) // 2
    for a, b in ((titles, titles), (titles[:half], titles[half:])):
        x, y = dedup.Tile(a), dedup.Tile(b)
        found = set(zip(*(k.tolist() for k in dedup.candidates(x, x if a is b else y, a is b, 0.85))))
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                if a is not b or i < j:
                    want = ratio(p, q), ratio(q, p)
                    assert not any(want) or (i, j) in found, (p, q)
                    assert (dedup.alike(p, q, 0.85), dedup.alike(q, p, 0.85)) == want


@pytest.mark.parametrize("tile", [512, 15])
def test_links_of_near_copies_are_forests(spark, tile):
    rows = [(i, "f", "notice of the extension of the last date " + w) for i, w in enumerate(f"{a}{b}" for a in "abcdef" for b in "uvwxyz")]
    df = spark.createDataFrame(rows, "tid long, feed string, norm string")
    edges = dedup.similar_titles(df, 0.85, tile).collect()
    n = -(-len(rows) // tile)
    assert len(edges) < len(rows) * n  # not one for each of the 630 pairs
    near = {i: {i} for i in range(len(rows))}
    for a, b in edges:
        near[a] = near[b] = near[a] | near[b]
        for k in near[a]:
            near[k] = near[a]
    assert len(near[0]) == len(rows)


def test_representatives_need_no_window_over_a_cluster(spark):
    rows = [("f", 1, 1, "b", "x", "home"), ("f", 2, 1, "b", "x", "archive"), ("f", 3, 1, "a", "y", "archive"), ("f", 4, 1, "a", None, "archive"), ("f", 6, 5, "a", "x", "home"), ("f", 5, 5, "b", "x", None), (None, 7, 7, None, "x", "archive")]
    df = spark.createDataFrame(rows, "feed string, position long, cluster long, title string, pdf_link string, source_section string")
    got = dedup.representatives(df, ["archive"])
    assert got.columns == df.columns
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(rows[k][1:] for k in (3, 5, 6))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_queries_over_the_documents(spark, small):
    from paperloom.plans.surrogate import Tables

    listing = queries._listing(Tables(spark, small)).collect()
    want = plain_clusters([(r.feed, r.position, r.title, r.listed_date, r.status) for r in listing])
    got = {(r.feed, r.position): r.cluster for r in queries.QUERIES["fuzzy_title_clusters"](spark, small).collect()}
    assert got == want
    section = {(r.feed, r.position): r.source_section for r in listing}
    title = {(r.feed, r.position): r.title for r in listing}
    best = {}
    for (feed, p), c in want.items():
        first = section[feed, p] == "archive"
        key = (0, title[feed, p], "x", p) if first else (1, "", "", p)
        best[feed, c] = min(best.get((feed, c), key), key)
    reps = {(r.feed, r.cluster): r.position for r in queries.QUERIES["fuzzy_representatives"](spark, small).collect()}
    assert reps == {k: v[3] for k, v in best.items()}


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.tables = set(), 0

    def handle_starttag(self, tag, attrs):
        self.tables += tag == "tr"
        if tag == "a" and dict(attrs).get("href"):
            self.found.add(dict(attrs)["href"])


def test_hub_links_are_those_of_pages_without_tables(spark, small):
    want = set()
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        seen = Links()
        seen.feed(r.html or "")
        if not seen.tables:
            want |= {(r.page_id, u) for u in seen.found}
    got = queries.QUERIES["page_hub_links"](spark, small)
    assert {(r.page_id, r.url) for r in got.collect()} == want and want


def test_clean_text_keeps_every_visible_word(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.QUERIES["page_clean_text"](spark, small).collect():
        assert "<" not in r.text or "&lt;" in pages[r.page_id]
        for p in re.findall(r"<p>([^<&]+)</p>", pages[r.page_id])[:5]:
            assert re.sub(r"\s+", " ", p).strip() in r.text


def test_a_paged_source_finds_its_end(spark):
    paged.register(spark)
    got = spark.read.format("paged").option("fetch", "paperloom.sources.paged:demo_site").option("sites", "x, y").option("full", "2").load().collect()
    assert sorted(map(tuple, got)) == sorted((p, f"{s} {p}.{i}") for s in "xy" for p, n in ((1, 2), (2, 2), (3, 1)) for i in range(n))
    pages = {1: [("a",)], 2: [("b",)], 3: [("a",)], 4: [("c",)]}
    waits = []
    assert [p for p, _ in paged.until_end(lambda p: pages.get(p, []), delay=2, sleep=waits.append)] == [1, 2] and waits == [2, 2]  # page 3 repeats page 1
    assert [p for p, _ in paged.until_end(lambda p: ([(p,)], p < 3))] == [1, 2, 3]  # the pager ends
    assert [p for p, _ in paged.until_end(lambda p: [(p,)], most=4)] == [1, 2, 3, 4]
    assert list(paged.until_end(lambda p: [])) == []


def test_polling_tries_again_at_the_next_tick():
    seen, waits, errors = [], [], []

    def tick():
        seen.append(1)
        if len(seen) == 2:
            raise ConnectionError("reset")

    assert changes.poll(tick, 60, ticks=4, sleep=waits.append, failed=errors.append) == 1
    assert len(seen) == 4 and waits == [60, 60, 60] and isinstance(errors[0], ConnectionError)


STORE = "id string, title string, source_url string, subject string, instrument_type string, status string, kept boolean, etag string, last_checked timestamp"


def test_capture_upserts_and_logs_four_fields(spark):
    store = spark.createDataFrame([("a", "A", "u1", "s1", "i1", "Open", True, "e", None), ("b", "B", "u2", "s1", "i1", "Open", True, "e", None)], STORE)
    batch = spark.createDataFrame([("a", "A2", "changed", "s2", "i1", None, False, "f"), ("c", "C", "u3", "s1", "i2", "Open", True, "g")], "id string, title string, source_url string, subject string, instrument_type string, status string, kept boolean, etag string")
    after, log = changes.capture(store, batch, F.lit("2024-01-01").cast("timestamp"))
    got = {r.id: r for r in after.collect()}
    assert (got["a"].title, got["a"].source_url, got["a"].status, got["a"].kept, got["a"].etag) == ("A2", "u1", None, False, "f")
    assert got["b"].last_checked is None and got["c"].source_url == "u3" and got["c"].last_checked is not None
    assert sorted((r.document_id, r.field_changed, r.old_value, r.new_value) for r in log.collect()) == [("a", "kept", "1", "0"), ("a", "status", "Open", None), ("a", "subject", "s1", "s2")]


def test_run_log_is_appended_once(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "2024-01-01 00:00:00", "2024-01-01 00:01:30"), ("r2", "2024-01-02 00:00:00", None)], "run_id string, started_at string, finished_at string")
    runs = runs.select("run_id", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp"))
    changes.append_runs(runs, f"{tmp_path}/log")
    changes.append_runs(runs, f"{tmp_path}/log")
    assert sorted((r.run_id, r.seconds) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("r1", 90.0), ("r2", None)]


def test_a_mapping_is_linked_whole_or_not_at_all(spark):
    tag = spark.createDataFrame([("t1", 1, "SUBJECT", "n", "old")], "tag_id string, regulator_id int, facet string, name string, concept string")
    good = spark.createDataFrame([("new", 1, "SUBJECT", "n")], "concept string, regulator_id int, facet string, name string")
    assert [r.concept for r in maintain.relink_whole(tag, good).collect()] == ["new"]
    with pytest.raises(ValueError, match="unresolved"):
        maintain.relink_whole(tag, good.withColumn("name", F.lit("m")))


def test_registrations(spark):
    rows = [registry.registration("A", "case-orders", ["no"]), registry.registration("B", "faq-listing", skip_scheduled="first run")]
    table = registry.registry(spark, rows)
    assert [(r.code, r.has_detection, r.timeout_ms) for r in table.orderBy("code").collect()] == [("A", True, 2_700_000), ("B", False, 2_700_000)]
    assert [(r.code, r.skipped) for r in registry.planned(table, "schedule").orderBy("code").collect()] == [("A", None), ("B", "first run")]
    assert [(r.code, r.skipped) for r in registry.planned(table, "schedule", ["B"]).collect()] == [("B", None)]
    with pytest.raises(ValueError, match="no adapter"):
        registry.registration("C", "unheard")
    with pytest.raises(ValueError, match="twice"):
        registry.registry(spark, rows[:1] * 2)


@pytest.mark.parametrize("mark", text.BLOCK_MARKS)
def test_every_block_mark_counts(spark, mark):
    page = spark.range(1).select(text.is_blocked(F.lit(200), F.lit("A page of many plain words. " * 20 + mark.title())))
    assert page.first()[0] is True


def test_enums_and_new_rows(spark):
    df = spark.createDataFrame([("SUBJECT",), ("OTHER",), (None,)], "facet string")
    assert [r.facet for r in enum_violations(df, "facet", "facet").collect()] == ["OTHER"]
    docs = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-02 09:59:59"), (2, "2023-12-31 23:59:59")], "regulator_id int, first_ingested string").withColumn("first_ingested", F.col("first_ingested").cast("timestamp"))
    names = spark.createDataFrame([(1, "A"), (2, "B")], "regulator_id int, code string")
    assert [tuple(r) for r in audit.new_since(docs, names, F.lit("2024-01-01 10:00:00").cast("timestamp")).collect()] == [("A", 2)]
    assert spark.range(1).select(urls.first_link(F.lit(""), F.lit(None), F.lit("e"))["kind"]).first()[0] == "external"
