import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom import queries
from paperloom.operators import browse, dedup, ingest, maintain, quality, sample
from paperloom.plans.surrogate import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["regulator_tag_counts", "tags_by_facet", "tag_usage_total", "tag_coverage", "review_resolution"])
def test_no_nested_loop_join(spark, small, name):
    text = plan(queries.QUERIES[name](spark, small))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(queries.QUERIES["browse_domain"](spark, small))
    assert "PushedFilters" in text and "l_comment" not in text
    scan = [x for x in text.split("\n") if "lineitem" in x]
    assert all("l_quantity" not in x for x in scan)


CLUSTER = "feed string, position long, title string, listed_date string, status string, source_section string, pdf_link string"


def test_fuzzy_clusters_keep_conflicting_status_apart(spark):
    t = "Notification for acceptance of test reports under the scheme"
    rows = [("f", 1, t, "2022-08-24", "Active", "archive_a", "x"), ("f", 2, t + " (Expired)", "2022-08-24", "Expired", "home", "y"), ("f", 3, t, "", "", "home", "z"), ("g", 1, t, "2022-08-24", "Expired", "home", "w")]
    for n in (1, 8):
        got = {(r.feed, r.position): r.cluster for r in dedup.fuzzy_clusters(spark.createDataFrame(rows, CLUSTER).repartition(n)).collect()}
        assert got == {("f", 1): 1, ("f", 2): 2, ("f", 3): 1, ("g", 1): 1}


def test_group_inherits_missing_date_and_status(spark):
    rows = [("f", 1, "Extension of the last date", "", "", "home", "a"), ("f", 2, "Extension of the last date.", "2024-01-01", "", "arch", "b"), ("f", 3, "Extension of the last date", "2024-02-02", "", "arch", "c")]
    d = dedup.fuzzy_clusters(spark.createDataFrame(rows, CLUSTER))
    assert {r.position: r.cluster for r in d.collect()} == {1: 1, 2: 1, 3: 3}
    best = dedup.representatives(d, ["arch"])
    assert {(r.cluster, r.position) for r in best.collect()} == {(1, 2), (3, 3)}


STATUS = [
    # status label, hint, subject, scopes of the tag, want name, want reason
    ("Draft / Under Consultation", "Active", None, {}, "In Force", "ok"),
    ("In Force", "Expired", None, {}, "Superseded / Repealed", "ok"),
    ("In Force", "Open", None, {}, None, "no_match"),
    ("In Force", "Unheard", None, {}, "In Force", "ok"),
    ("In Force", None, None, {}, "In Force", "ok"),
    ("Draft / Under Consultation", None, None, {}, "Draft / Under Consultation", "ok"),
    ("Nonsense", None, None, {}, None, "no_match"),
    ("In Force", None, "s1", {"In Force": ["s1", "s2"]}, "In Force", "ok"),
    ("In Force", None, "s3", {"In Force": ["s1", "s2"]}, "In Force", "scope_mismatch"),
    ("In Force", None, None, {"In Force": ["s1"]}, "In Force", "ok"),
    ("Draft / Under Consultation", "Active", "s3", {"In Force": ["s1"]}, "In Force", "scope_mismatch"),
]


@pytest.mark.parametrize("label, hint, subject, scopes, name, reason", STATUS)
def test_status_resolution(spark, label, hint, subject, scopes, name, reason):
    names = ["In Force", "Superseded / Repealed", "Draft / Under Consultation"]
    tags = spark.createDataFrame([(1, n, n, scopes.get(n, [])) for n in names], "regulator_id int, name string, tag_id string, applies_to array<string>")
    row = spark.createDataFrame([(1, label, hint, subject)], "regulator_id int, status_label string, status_hint string, subject_id string")
    got = ingest.resolve_status(row, tags).first()
    assert (got["status_id"], got["status_reason"]) == (name, reason)


def test_review_reasons_order(spark):
    row = spark.range(1)
    c = ingest.review_reasons(F.lit(0.5), F.lit(None).cast("string"), F.lit("i"), F.lit("no_match"), F.lit(True), F.lit(True))
    assert row.select(c).first()[0] == ["low_confidence", "model_returned_invalid_subject_tag", "model_returned_invalid_status_tag", "text_extraction_failed", "unparseable_published_date"]
    assert row.select(ingest.review_reasons(F.lit(0.75), F.lit("s"), F.lit("i"), F.lit("ok"), F.lit(False), F.lit(False))).first()[0] == []


def test_published_flags_what_does_not_parse(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-03",), ("May-2025",), ("",), (None,)], "s string")
    d, bad = ingest.published(F.col("s"))
    assert [tuple(r) for r in df.select(d, bad).collect()] == [(None, True), (dt.date(2024, 2, 3), False), (None, True), (None, False), (None, False)]


def test_document_codes_go_on(spark):
    rows = spark.createDataFrame([("R", "S", None, dt.date(2024, 1, 1), i) for i in range(3)], "code string, subject_code string, instrument_code string, published_date date, i int")
    have = spark.createDataFrame([("R-S-UNK-2024-998",), ("R-S-UNK-2024-7",)], "document_code string")
    assert sorted(r.document_code for r in ingest.document_codes(rows, have, "2025-01-01", ["i"]).collect()) == ["R-S-UNK-2024-1000", "R-S-UNK-2024-1001", "R-S-UNK-2024-999"]


def test_model_output_is_checked(spark):
    rows = spark.createDataFrame([('{"keep": true, "subject": "A", "confidence": 90}',), ('text {"keep": true, "subject": "Z", "confidence": 0.9} more',), ("broken",), (None,)], "raw string")
    got = [(r.subject, r.confidence, r.review_reasons) for r in ingest.validated(rows, {"subject": ["A"]}).collect()]
    assert got[0] == ("A", 0.9, []) and got[1][2] == ["out_of_vocabulary_subject"] and got[2][2] == ["unreadable_model_output"] == got[3][2]


def test_adapters_give_the_record(spark):
    from paperloom.schemas import NORMALIZED

    c = "feed section source_url title case_no published_date terms file_url source_id scraped_at"
    row = spark.createDataFrame([("regulations_draft_x", "Sec", "u", "Petition", "4 of 2026", "2026-01-05", "Order", "http://h/a.pdf", "id", "t")], ", ".join(f"{x} string" for x in c.split()))
    got = ingest.ADAPTERS["case-orders"](row)
    assert got.schema.names == NORMALIZED.names
    r = got.first()
    assert (r.title, r.status_hint, r.category_hint, r.file_extension_hint) == ("Petition [Case No. 4 of 2026]", "Draft", "Order | Sec", "pdf")


def test_first_and_last_wins_for_any_partitioning(spark, small):
    e = Tables(spark, small).events()
    for last in (False, True):
        out = [{(r.document_id, r.event_id) for r in dedup.one_per_key(e.repartition(n), ["document_id"], ["ts", "event_id"], last).collect()} for n in (1, 8)]
        assert out[0] == out[1]


def test_attachments(spark):
    a = "array<struct<url:string,name:string>>"
    rows = spark.createDataFrame([(1, "Order", []), (2, "Order", [("u1", "Q3"), ("u2", "Q3"), ("u3", "Licence 06 of 2026")]), (3, "Lone", None)], f"id int, title string, attachments {a}")
    got = sorted((r.id, r.attachment_index, r.title, r.file_url, r.attachment_count) for r in dedup.explode_attachments(rows).collect())
    assert got == [(1, 0, "Order", None, 0), (2, 0, "Order", "u1", 3), (2, 1, "Q3 — Order", "u2", 3), (2, 2, "Licence 06 of 2026", "u3", 3), (3, 0, "Lone", None, 0)]
    links = spark.createDataFrame([([("a", "x"), ("b", "y"), ("a", "z")],)], "l array<struct<url:string,label:string>>")
    assert [(x.url, x.label) for x in links.select(dedup.distinct_links(F.col("l")).alias("l")).first().l] == [("a", "x"), ("b", "y")]


def test_group_rows_are_refused(spark):
    rows = spark.createDataFrame([("a", False), ("b", True)], "t string, is_group boolean")
    with pytest.raises(Exception, match="expanded first"):
        dedup.refuse_groups(rows).collect()


ORDERS = [("a", "PMA/IN-SPACe/AUTH/2024/90", "In Force", 1), ("b", "PMA/IN-SPACAE/AUTH/2024/90B Amendment No. 1", "In Force", 2), ("c", "PMA/IN-SPACe/AUTH/2024/91 read with Amendment No 2", None, 3), ("d", "PMA/IN-SPACe/AUTH/2024/92A Amendment No. 1", None, 4), ("e", "PMA/IN-SPACe/AUTH/2024/93", "Repealed", 5), ("f", "PMA/IN-SPACe/AUTH/2024/93A amendment no.1", None, 6)]


def test_amendments_are_idempotent_and_never_downgrade(spark):
    rows = spark.createDataFrame(ORDERS, "entry_id string, title string, status string, position int")
    assert {r.entry_id: r.outcome for r in maintain.amendment_targets(rows).collect()} == {"b": "updated", "c": "updated", "d": "not_found", "f": "skipped"}
    once = maintain.amend(rows)
    want = {"a": "Amended", "b": "In Force", "c": "Amended", "d": None, "e": "Repealed", "f": None}
    assert {r.entry_id: r.status for r in once.collect()} == want == {r.entry_id: r.status for r in maintain.amend(once).collect()}


def test_rules_are_idempotent(spark):
    rows = spark.createDataFrame([("a", "Fee Order 2020", "In Force"), ("b", "Other", "In Force")], "entry_id string, title string, status string")
    rules = spark.createDataFrame([("a", "fee order", "In Force", "Superseded"), ("b", "fee", "In Force", "X"), ("z", "q", "In Force", "X")], "entry_id string, title_contains string, from_status string, to_status string")
    assert {r.entry_id: r.outcome for r in maintain.status_rules(rows, rules).collect()} == {"a": "fixed", "b": "title_changed", "z": "not_found"}
    once = maintain.apply_rules(rows, rules)
    assert {r.entry_id: r.status for r in once.collect()} == {"a": "Superseded", "b": "In Force"}
    assert {r.entry_id: r.outcome for r in maintain.status_rules(once, rules).collect()}["a"] == "already_changed"


def test_review_decisions(spark):
    entry = spark.createDataFrame([("e1", 1, None, None, True, ["x"]), ("e2", 1, None, None, True, ["x"])], "entry_id string, regulator_id int, subject_id string, instrument_id string, needs_review boolean, review_reasons array<string>")
    tag = spark.createDataFrame([("s", "SUBJECT", 1), ("i", "INSTRUMENT_TYPE", 1), ("i2", "INSTRUMENT_TYPE", 2)], "tag_id string, facet string, regulator_id int")
    d = spark.createDataFrame([("e1", "s", "i"), ("e2", "s", "i2"), ("e9", "s", "i"), ("e2", "", "i"), ("e2", "i", "i")], "entry_id string, subject_id string, instrument_id string")
    assert sorted(r.outcome for r in maintain.review_decisions(d, entry, tag).collect()) == ["accepted", "bad_instrument", "bad_subject", "entry_not_found", "missing_tag"]
    got = {r.entry_id: (r.subject_id, r.needs_review, r.review_reasons, r.classified_by) for r in maintain.apply_decisions(entry, d.filter("entry_id = 'e1'"), tag).collect()}
    assert got == {"e1": ("s", False, [], "human_review"), "e2": (None, True, ["x"], "model")}


def test_upsert_cascade_orphans_mapping(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, "w")], "k string, n int, v string")
    assert sorted(map(tuple, maintain.upsert(old, new, ["k"]).collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]
    doc, entry = spark.createDataFrame([("d1",), ("d2",)], "document_id string"), spark.createDataFrame([("e1", "d1"), ("e2", "d2")], "entry_id string, document_id string")
    links = spark.createDataFrame([("e1", "e2"), ("e2", "e1"), ("e2", "e2")], "from_id string, to_id string")
    d, e, l = maintain.cascade_delete(doc, entry, links, doc.filter("document_id = 'd1'"))
    assert (d.count(), e.count(), [tuple(r) for r in l.collect()]) == (1, 1, [("e2", "e2")])
    kids = spark.createDataFrame([("a", None), ("b", "a"), ("c", "zz")], "name string, parent string")
    assert [r["name"] for r in maintain.orphans(kids, "parent", "name").collect()] == ["c"]
    tag = spark.createDataFrame([(1, "F", "n"), (2, "F", "n")], "regulator_id int, facet string, name string")
    m = spark.createDataFrame([("c1", 1, "F", "n"), ("c1", 2, "F", "n"), ("c2", 2, "F", "n"), ("c1", 3, "F", "q")], "concept string, regulator_id int, facet string, name string")
    assert sorted(r.why for r in maintain.mapping_violations(m, tag).collect()) == ["one_regulator", "two_concepts", "unresolved"]


def test_public_rows_hold_no_flagged_one(spark, small):
    t = Tables(spark, small)
    rows = browse.joined(t.entry(), t.document(), t.regulator())
    assert browse.public(rows).filter("needs_review").count() == 0
    flagged = rows.filter("needs_review").select("entry_id").first()[0]
    assert browse.detail(rows, flagged, True).count() == 0 and browse.detail(rows, flagged, False).count() >= 1


def test_filter_values():
    assert browse.to_list(None) == [] and browse.to_list(" a ") == ["a"] and browse.to_list(["", " b", None and 1 or "c "]) == ["b", "c"]
    assert browse.pages(0) == 1 and browse.pages(26) == 2


def test_quotas_sum_and_break_ties(spark):
    for weights in ([1.0, 1.0, 1.0], [100.0, 1.0, 1.0], [0.3, 0.3, 0.4, 7.0]):
        w = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(weights)], "stratum string, weight double")
        got = {r.stratum: r.quota for r in sample.quotas(w, 10).collect()}
        assert sum(got.values()) == 10
    w = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "stratum string, weight double")
    assert {r.stratum: r.quota for r in sample.quotas(w, 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_samples_do_not_depend_on_partitions(spark, small):
    d = Tables(spark, small).normalized()
    picks = [{r.doc_id for r in sample.uniform(d.repartition(n), "doc_id", 30, 3).collect()} for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 30
    p = spark.range(1, 21).withColumnRenamed("id", "page")
    assert 1 in {r.page for r in sample.pages(p, "page", 5, 1).collect()} and sample.pages(p, "page", 5, 1).count() == 5


def test_run_status_and_skip(spark):
    c = spark.range(1)
    s = lambda f, b, x, e: c.select(quality.run_status(F.lit(f), F.lit(b), F.lit(x), F.lit(e).cast("string"))).first()[0]
    assert [s(0, 2, 0, None), s(5, 2, 0, None), s(5, 0, 1, None), s(0, 0, 0, None), s(5, 2, 0, "boom")] == ["BLOCKED", "PARTIAL", "PARTIAL", "SUCCESS", "ERROR"]
    k = lambda t, e: c.select(quality.skip_reason(F.lit("why"), F.lit(t), F.lit(e))).first()[0]
    assert k("schedule", False) == "why" and k("schedule", True) is None and k("manual", False) is None
    runs = spark.createDataFrame([("r1", "ERROR"), ("r1", "SUCCESS"), ("r2", "ERROR")], "run_id string, status string")
    assert {r.run_id: r.failed for r in quality.job_failed(runs).collect()} == {"r1": False, "r2": True}


def test_document_list_score(spark):
    df = spark.createDataFrame([('{"data": [{"title": "a", "order_date": 1}, {}]}',), ('[{"title": "a"}, {"title": "b"}]',), ('{"items": [{"title": 1}]}',), ("nonsense",), (None,)], "b string")
    assert [r[0] for r in df.select(quality.document_list_score(F.col("b"))).collect()] == ["high", "medium", "low", "low", "low"]


def test_edges_resolve(spark):
    edges = spark.createDataFrame([("e1", None, "AMENDS", "src-1", False), ("e2", None, "AMENDS", "none", False)], "from_id string, to_id string, type string, target_hint string, resolved boolean")
    docs = spark.createDataFrame([("src-1", "e9")], "source_id string, entry_id string")
    assert {r.from_id: (r.to_id, r.resolved) for r in maintain.resolve_edges(edges, docs).collect()} == {"e1": ("e9", True), "e2": (None, False)}
