"""The registry: every query over the fixture views, with its DuckDB SQL where SQL can say it.

Each entry binds an operator to the views of ``plans.surrogate``; the SQL is written apart from the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, text, urls
from .operators import audit, browse, dedup, ingest, maintain, overview, quality, registry, sample
from .plans.surrogate import ASOF, Tables, as_events, sql
from .session import scratch
from .sources import html
from .streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _iso(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that no client reads them as timestamps."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(oracle: str | None = None, day: str | None = None):
    """Registers f(Tables) under its name, with its SQL; ``day`` names the SQL's date column."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: _iso(f(Tables(spark, sf_dir)))
        if oracle:
            text = sql(oracle)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE (CAST({day} AS VARCHAR) AS {day}) FROM ({text})" if day else text
        return f

    return register


def variant(name: str, f: Callable[[Tables], DataFrame], oracle: str | None = None, day: str | None = None) -> None:
    f.__name__ = name
    query(oracle, day)(f)


def _rows(t: Tables, titles: bool = False) -> DataFrame:
    return browse.joined(t.entry(), t.document(), t.regulator(), t.title() if titles else None)


# Counts by regulator and domain
for _flag, _name in ((False, "public_counts_by_regulator"), (True, "flagged_counts_by_regulator")):
    variant(
        _name,
        lambda t, flag=_flag: overview.counts_by_regulator(t.entry(), t.document(), t.regulator(), flag),
        f"SELECT code, count(*) AS n FROM entry_v JOIN document_v USING (document_id) JOIN regulator_v USING (regulator_id) WHERE needs_review = {str(_flag).lower()} GROUP BY code",
    )

_OVERVIEW = """SELECT domain_id, domain_name, code, count(CASE WHEN NOT needs_review THEN 1 END) AS published, count(entry_id) AS total
FROM domain_v JOIN regulator_v USING (domain_id) LEFT JOIN document_v USING (regulator_id) LEFT JOIN entry_v USING (document_id) GROUP BY ALL"""


@query(_OVERVIEW)
def domain_overview(t):
    return overview.domain_overview(t.domain(), t.regulator(), t.document(), t.entry())


@query(f"SELECT domain_id, domain_name, CAST(to_json(list({{'code': code, 'published': published, 'total': total}} ORDER BY code)) AS VARCHAR) AS regulators FROM ({_OVERVIEW}) GROUP BY 1, 2")
def domain_overview_nested(t):
    rows = overview.nested_by(domain_overview(t), ["domain_id", "domain_name"], ["code", "published", "total"], "regulators")
    return rows.withColumn("regulators", F.to_json("regulators"))


@query(f"SELECT domain_name, CAST(sum(published) AS BIGINT) AS published FROM ({_OVERVIEW}) GROUP BY domain_name")
def domain_totals(t):
    return overview.totals(domain_overview(t), ["domain_name"], "published")


_USES = """uses AS (SELECT t.facet, t.tag_id, t.name, t.regulator_id, count(CASE WHEN NOT e.needs_review THEN 1 END) AS published, count(e.entry_id) AS total
FROM tag_v t LEFT JOIN entry_v e ON e.subject_id = t.tag_id OR e.instrument_id = t.tag_id GROUP BY ALL)"""


@query(f"WITH {_USES} SELECT facet, tag_id, name, published, total FROM uses WHERE regulator_id = 7")
def regulator_tag_counts(t):
    return overview.regulator_tags(t.tag(), t.entry(), 7)


@query(f"WITH {_USES} SELECT code, tag_id, name, published, total FROM uses JOIN regulator_v USING (regulator_id) WHERE facet = 'SUBJECT'")
def tags_by_facet(t):
    return overview.tags_by_facet(t.tag(), t.entry(), t.regulator(), "SUBJECT")


@query("SELECT count(CASE WHEN NOT needs_review THEN 1 END) AS published, count(CASE WHEN needs_review THEN 1 END) AS flagged FROM entry_v JOIN document_v USING (document_id) WHERE regulator_id = 7")
def regulator_published_flagged(t):
    return overview.published_and_flagged(t.entry(), t.document(), 7)


@query(f"WITH o AS ({_OVERVIEW}) SELECT a.code, b.code AS sibling, b.published FROM o a JOIN o b ON a.domain_id = b.domain_id AND a.code <> b.code")
def regulator_siblings(t):
    return overview.siblings(t.regulator(), t.document(), t.entry())


# Browsing
_JOINED = "entry_v JOIN document_v USING (document_id) JOIN regulator_v USING (regulator_id)"
_ORDERS = {
    "newest": "published_date DESC NULLS LAST, created DESC, entry_id",
    "oldest": "published_date ASC NULLS LAST, created, entry_id",
    "regulator": "code, published_date DESC NULLS LAST, entry_id",
}
_SHOWN = ["entry_id", "code", "published_date", "status"]
for _sort, _by in _ORDERS.items():
    variant(f"browse_{_sort}", lambda t, s=_sort: browse.page(browse.public(_rows(t)), browse.Filters(sort=s, page=3)).select(*_SHOWN), f"SELECT entry_id, code, published_date, status FROM {_JOINED} WHERE NOT needs_review ORDER BY {_by} LIMIT 25 OFFSET 50", "published_date")


@query(f"SELECT entry_id, code, published_date, title FROM {_JOINED} JOIN title_v USING (part_key) WHERE NOT needs_review ORDER BY title, entry_id LIMIT 25", "published_date")
def browse_title(t):
    return browse.page(browse.public(_rows(t, True)), browse.Filters(sort="title")).select("entry_id", "code", "published_date", "title")


_BROWSES = {
    "browse_filtered_multi": (browse.Filters(regulator=[" NATION_3", "NATION_8", ""], domain="1", status=["In Force"], page=2), "code IN ('NATION_3', 'NATION_8') AND status = 'In Force'", 25),
    "browse_domain": (browse.Filters(domain=["1", "3"]), "domain_id IN (1, 3)", 0),
    "browse_date_range": (browse.Filters(date_from="1997-03-01", date_to="1997-03-31", page=0), "published_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'", 0),
    "browse_bad_bound": (browse.Filters(date_from="not a date", date_to="1996-01-31"), "published_date <= DATE '1996-01-31'", 0),
    "browse_one_subject": (browse.Filters(subject="S-17", instrument=None), "subject_id = 'S-17'", 0),
}
for _name, (_f, _where, _skip) in _BROWSES.items():
    variant(_name, lambda t, f=_f: browse.page(browse.public(_rows(t)), f).select(*_SHOWN), f"SELECT entry_id, code, published_date, status FROM {_JOINED} WHERE NOT needs_review AND {_where} ORDER BY {_ORDERS['newest']} LIMIT 25 OFFSET {_skip}", "published_date")


@query(f"SELECT entry_id, title, published_date FROM {_JOINED} JOIN title_v USING (part_key) WHERE NOT needs_review AND contains(lower(title), 'blue') ORDER BY {_ORDERS['newest']} LIMIT 25", "published_date")
def browse_search(t):
    return browse.page(browse.public(_rows(t, True)), browse.Filters(search="  BLUE ")).select("entry_id", "title", "published_date")


@query(f"SELECT entry_id, published_date FROM {_JOINED} WHERE NOT needs_review AND published_date BETWEEN DATE '{ASOF}' - 30 AND DATE '{ASOF}'", "published_date")
def browse_last_n_days(t):
    return browse.public(_rows(t)).filter(browse.last_days(F.col("published_date"), ASOF, 30)).select("entry_id", "published_date")


@query(f"SELECT count(*) AS total, 1 AS page, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS page_count FROM {_JOINED} WHERE NOT needs_review AND code = 'NATION_7'")
def browse_page_count(t):
    return browse.page_count(browse.public(_rows(t)), browse.Filters(regulator="NATION_7"))


@query(f"SELECT entry_id, code, CAST(ceil(row_number() OVER (PARTITION BY code ORDER BY {_ORDERS['newest']}) / 25) AS BIGINT) AS page FROM {_JOINED} WHERE NOT needs_review AND domain_id = 2")
def browse_numbered(t):
    return browse.numbered(browse.public(_rows(t)), browse.Filters(domain="2")).select("entry_id", "code", "page")


@query(f"SELECT entry_id, code, needs_review, published_date FROM {_JOINED} WHERE needs_review ORDER BY {_ORDERS['newest']} LIMIT 25", "published_date")
def review_queue(t):
    return browse.page(browse.review_queue(_rows(t)), browse.Filters()).select("entry_id", "code", "needs_review", "published_date")


@query(f"WITH x AS (SELECT min(entry_id) AS lo FROM entry_v WHERE NOT needs_review) SELECT entry_id, code, status, list_sort(review_reasons) AS review_reasons FROM {_JOINED} JOIN x ON entry_id = lo WHERE NOT needs_review")
def entry_detail_public(t):
    least = t.entry().filter(~F.col("needs_review")).agg(F.min("entry_id").alias("entry_id"))
    return browse.public(_rows(t).join(least, "entry_id")).select("entry_id", "code", "status", F.array_sort("review_reasons").alias("review_reasons"))


@query(f"""WITH p AS (SELECT entry_id, subject_id, instrument_id, published_date FROM {_JOINED} WHERE NOT needs_review ORDER BY {_ORDERS['newest']} LIMIT 25)
SELECT entry_id, CASE WHEN s.tag_id IS NOT NULL THEN CAST(to_json({{'tag_id': s.tag_id, 'name': s.name}}) AS VARCHAR) END AS subject, CASE WHEN i.tag_id IS NOT NULL THEN CAST(to_json({{'tag_id': i.tag_id, 'name': i.name}}) AS VARCHAR) END AS instrument, published_date
FROM p LEFT JOIN tag_v s ON s.tag_id = subject_id LEFT JOIN tag_v i ON i.tag_id = instrument_id""", "published_date")
def entry_nested(t):
    rows = browse.nested(browse.page(browse.public(_rows(t)), browse.Filters()), t.tag())
    return rows.select("entry_id", F.to_json("subject").alias("subject"), F.to_json("instrument").alias("instrument"), "published_date")


@query("SELECT facet, regulator_id, name, tag_id FROM tag_v WHERE status = 'ACTIVE'")
def tag_options_active(t):
    return browse.tag_options(t.tag())


@query("SELECT facet, regulator_id, name, tag_id FROM tag_v WHERE regulator_id IN (3, 4)")
def tag_options_all_of_two(t):
    return browse.tag_options(t.tag(), ["3", "4"], include_inactive=True)


@query("SELECT facet, regulator_id, list({'name': name, 'tag_id': tag_id} ORDER BY name, tag_id)::VARCHAR IS NOT NULL AS has_tags, count(*) AS n FROM tag_v WHERE status = 'ACTIVE' GROUP BY 1, 2")
def tag_options_by_regulator(t):
    rows = overview.nested_by(browse.tag_options(t.tag()), ["facet", "regulator_id"], ["name", "tag_id"], "tags")
    return rows.select("facet", "regulator_id", F.col("tags").isNotNull().alias("has_tags"), F.size("tags").cast("long").alias("n"))


@query("SELECT entry_id FROM entry_v JOIN document_v USING (document_id) JOIN tag_v ON tag_id = subject_id AND tag_v.regulator_id = document_v.regulator_id WHERE tag_id = 'S-30' AND NOT needs_review")
def tag_page_entries(t):
    return browse.tag_page(_rows(t), t.tag(), "S-30", "SUBJECT").select("entry_id")


@query("SELECT entry_id FROM entry_v WHERE false")
def tag_page_wrong_facet(t):
    return browse.tag_page(_rows(t), t.tag(), "S-30", "INSTRUMENT_TYPE").select("entry_id")


@query("SELECT tag_id FROM tag_v JOIN regulator_v USING (regulator_id) WHERE domain_id = 2 AND code IN ('NATION_2', 'NATION_7', 'NATION_9')")
def narrowed_options(t):
    return browse.narrowed(t.domain(), t.regulator(), t.tag(), ["2"], ["NATION_2", "NATION_7", "NATION_9"]).select("tag_id")


@query("SELECT regulator_id, code FROM regulator_v")
def regulator_options(t):
    return t.regulator().select("regulator_id", "code").orderBy("code")


@query(f"SELECT code, count(*) AS n FROM {_JOINED} WHERE confidence < 0.7 GROUP BY code")
def sql_scan(t):
    """Raw SQL with bound parameters over the views."""
    return t.spark.sql("SELECT code, count(*) AS n FROM {rows} WHERE confidence < :limit GROUP BY code", rows=_rows(t), args={"limit": 0.7})


# Audits
@query("SELECT count(DISTINCT document_id) AS documents, count(*) AS entries, count(CASE WHEN needs_review THEN 1 END) AS flagged FROM entry_v")
def verify_totals(t):
    return audit.totals(t.entry())


@query("SELECT 'documents' AS table_name, count(*) AS n FROM document_v UNION ALL SELECT 'entries', count(*) FROM entry_v UNION ALL SELECT 'tags', count(*) FROM tag_v")
def verify_table_sizes(t):
    return audit.table_sizes(documents=t.document(), entries=t.entry(), tags=t.tag())


@query("SELECT needs_review, coalesce(status, '(unclassified)') AS label, count(*) AS n FROM entry_v GROUP BY ALL")
def verify_review_breakdown(t):
    return t.entry().groupBy("needs_review", F.coalesce("status", F.lit("(unclassified)")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(review_reasons) AS reason FROM entry_v) GROUP BY reason")
def verify_reason_counts(t):
    return audit.reason_counts(t.entry())


@query("SELECT coalesce(name, '(untagged)') AS label, count(*) AS n FROM entry_v LEFT JOIN tag_v ON tag_id = subject_id GROUP BY 1")
def verify_subject_distribution(t):
    return audit.tag_distribution(t.entry(), t.tag())


@query("SELECT coalesce(status, '(untagged)') AS label, count(*) AS n FROM entry_v GROUP BY 1")
def verify_status_distribution(t):
    return audit.distribution(t.entry(), "status")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def verify_duplicate_ids(t):
    return audit.duplicates(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT name, count(DISTINCT regulator_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(regulator_id AS VARCHAR))), ',') AS groups FROM tag_v GROUP BY name HAVING count(DISTINCT regulator_id) > 1")
def verify_cross_regulator_ids(t):
    return audit.shared_across(t.tag().withColumn("regulator_id", F.col("regulator_id").cast("string")), "name", "regulator_id")


@query("SELECT entry_id, published_date, status FROM entry_v JOIN document_v USING (document_id) ORDER BY published_date DESC NULLS LAST, entry_id LIMIT 8", "published_date")
def verify_latest_sample(t):
    return audit.latest(t.entry(), t.document(), 8)


@query("SELECT entry_id, coalesce(confidence, 1.0) AS confidence FROM entry_v ORDER BY 2, entry_id LIMIT 20")
def lowest_confidence(t):
    return audit.lowest_confidence(t.entry(), 20)


@query(f"WITH {_USES} SELECT facet, tag_id, total AS n FROM uses")
def tag_usage_total(t):
    return audit.usage_per_tag(t.tag(), t.entry())


@query("""WITH u AS (SELECT t.facet, t.tag_id, count(e.entry_id) AS n, sum(e.confidence) AS c FROM tag_v t LEFT JOIN entry_v e ON e.subject_id = t.tag_id OR e.instrument_id = t.tag_id GROUP BY ALL)
SELECT facet, count(*) AS tags, count(CASE WHEN n > 0 THEN 1 END) AS fired, count(CASE WHEN n = 0 THEN 1 END) AS never, round(100.0::DOUBLE * count(CASE WHEN n > 0 THEN 1 END) / count(*), 1) AS fired_pct, round(sum(c) / sum(n), 4) AS mean_confidence FROM u GROUP BY facet""")
def tag_coverage(t):
    return audit.coverage(t.tag(), t.entry())


@query("""SELECT category_hint AS hint, coalesce(status, '(none)') AS assigned, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY category_hint) AS BIGINT) AS hint_total
FROM entry_v JOIN document_v USING (document_id) GROUP BY 1, 2""")
def hint_crosstab(t):
    return audit.crosstab(t.entry().join(t.document(), "document_id"), "category_hint", "status")


@query("""SELECT facet, name, count(DISTINCT code) AS n, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM tag_v JOIN regulator_v USING (regulator_id) GROUP BY 1, 2 HAVING count(DISTINCT code) >= 2""")
def shared_tag_names(t):
    return audit.shared_names(t.tag(), t.regulator())


@query("SELECT concept, count(DISTINCT name) AS names, count(*) AS members FROM tag_v WHERE concept IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1")
def near_duplicate_concepts(t):
    return audit.mixed_concepts(t.tag())


_DECLARED = "SELECT tag_id, CASE WHEN regulator_id = 3 THEN 'moved' ELSE concept END AS concept FROM tag_v WHERE facet = 'SUBJECT' AND regulator_id <> 5"
_STORED = "SELECT tag_id, concept FROM tag_v WHERE facet = 'SUBJECT'"


@query(f"SELECT *, 'declared' AS side FROM ({_DECLARED} EXCEPT ALL {_STORED}) UNION ALL SELECT *, 'stored' FROM ({_STORED} EXCEPT ALL {_DECLARED})")
def concept_drift(t):
    stored = t.tag().filter("facet = 'SUBJECT'").select("tag_id", "concept", "regulator_id")
    declared = stored.filter("regulator_id <> 5").select("tag_id", F.when(F.col("regulator_id") == 3, "moved").otherwise(F.col("concept")).alias("concept"))
    return audit.drift(declared, stored.select("tag_id", "concept"))


@query("SELECT facet, count(*) AS tags, count(concept) AS mapped, round(100.0::DOUBLE * count(concept) / count(*), 1) AS mapped_pct FROM tag_v GROUP BY facet")
def concept_mapping_share(t):
    return audit.concept_share(t.tag())


@query("SELECT regulator_id, coalesce(concept, '(unversioned)') AS version, count(*) AS n FROM tag_v GROUP BY 1, 2")
def live_versions(t):
    return audit.versions(t.tag(), "concept")


@query(f"SELECT code, count(*) AS n FROM document_v JOIN regulator_v USING (regulator_id) WHERE first_ingested >= TIMESTAMP '{ASOF}' - INTERVAL 24 HOURS GROUP BY code")
def new_last_24h(t):
    return audit.new_since(t.document(), t.regulator(), F.lit(ASOF).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))


@query("""SELECT code, count(CASE WHEN facet = 'SUBJECT' THEN 1 END) AS subject, count(CASE WHEN facet = 'INSTRUMENT_TYPE' THEN 1 END) AS instrument_type
FROM tag_v JOIN regulator_v USING (regulator_id) WHERE status = 'ACTIVE' GROUP BY code""")
def tag_facet_pivot(t):
    return audit.facet_pivot(t.tag(), t.regulator(), ["SUBJECT", "INSTRUMENT_TYPE"])


_STATS = """WITH s AS (SELECT kept, value > 50 AS needs_review, status, CAST(k AS VARCHAR) AS k FROM store_v),
p AS (SELECT 'status' AS dimension, coalesce(status, '(none)') AS label, kept, needs_review FROM s UNION ALL SELECT 'k', coalesce(k, '(none)'), kept, needs_review FROM s UNION ALL SELECT '*', '*', kept, needs_review FROM s),
c AS (SELECT dimension, label, count(CASE WHEN kept THEN 1 END) AS n, count(CASE WHEN NOT kept THEN 1 END) AS dropped, count(CASE WHEN needs_review THEN 1 END) AS flagged FROM p GROUP BY 1, 2)
SELECT *, CASE WHEN n > 0 THEN round(100.0::DOUBLE * flagged / n, 1) ELSE 0.0 END AS flag_pct_of_kept, CASE WHEN n + dropped > 0 THEN round(100.0::DOUBLE * flagged / (n + dropped), 1) ELSE 0.0 END AS flag_pct_of_all FROM c"""


@query(_STATS)
def store_stats(t):
    return audit.store_stats(t.store().withColumn("needs_review", F.col("value") > 50), ["status", "k"])


@query("SELECT feed, count(*) AS n, count(CASE WHEN n_chars > 1000 THEN 1 END) AS needs_download, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS no_file FROM normalized_v GROUP BY feed")
def run_summary(t):
    return audit.run_summary(t.normalized(), "feed", F.col("n_chars") > 1000, F.col("doc_id") % 3 != 0)


_FILE = "SELECT CAST(document_id AS VARCHAR) AS source_id, status_hint AS title, CASE WHEN document_id % 31 = 0 THEN 'May-1997' ELSE CAST(published_date AS VARCHAR) END AS published_date FROM document_v"


@query(f"""WITH f AS ({_FILE}), m AS (SELECT count(*) AS rows, count(CASE WHEN title IS NULL OR title = '' THEN 1 END) AS missing_title, count(CASE WHEN published_date IS NULL OR published_date = '' THEN 1 END) AS missing_published_date,
count(source_id) - count(DISTINCT source_id) AS repeated_ids, count(CASE WHEN published_date <> '' THEN 1 END) AS dated, count(CASE WHEN published_date <> '' AND NOT regexp_full_match(published_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 1 END) AS not_iso,
count(CASE WHEN regexp_full_match(published_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND published_date > '{ASOF}' THEN 1 END) AS future FROM f)
UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE n""")
def file_validation(t):
    raw = F.when(F.col("document_id") % 31 == 0, "May-1997").otherwise(F.col("published_date").cast("string"))
    rows = t.document().select(F.col("document_id").cast("string").alias("source_id"), F.col("status_hint").alias("title"), raw.alias("published_date"))
    return quality.file_validation(rows, ["title", "published_date"], ASOF)


ORACLE_SQL["file_validation"] = ORACLE_SQL["file_validation"].replace("\nUNPIVOT m", "\nSELECT * FROM (UNPIVOT m") + ")"


@query("SELECT feed, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM (SELECT feed, lang, count(*) AS n FROM normalized_v GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 3 AND max(n) * 2 > sum(n)")
def dominant_url_check(t):
    return audit.dominant(t.normalized(), "feed", "lang")


# Ingestion
@query("SELECT document_id FROM document_v WHERE document_id NOT IN (SELECT document_id FROM entry_v)")
def known_anti_join(t):
    return ingest.fresh(t.document(), t.entry().select("document_id").distinct(), ["document_id"]).select("document_id")


@query("SELECT document_id FROM document_v WHERE document_id IN (SELECT document_id FROM entry_v WHERE confidence < 0.65)")
def sample_semi_join(t):
    return t.document().join(t.entry().filter("confidence < 0.65").select("document_id"), "document_id", "left_semi").select("document_id")


_CHOICE = """SELECT entry_id, regulator_id, subject_id, confidence, CASE WHEN status_hint = 'O' THEN 'Open' WHEN status_hint = 'P' THEN 'Pending' END AS status_hint, coalesce(status, 'Unknown') AS status_label
FROM entry_v JOIN document_v USING (document_id)"""
_STATUS_TAGS = """SELECT regulator_id, name, name || '-' || regulator_id AS tag_id, CASE WHEN name = 'Amended' THEN ['S-1', 'S-2', 'S-3', 'S-4', 'S-5'] ELSE [] END AS applies_to
FROM regulator_v, (VALUES ('In Force'), ('Amended'), ('Open / Accepting Applications')) v(name) WHERE NOT (regulator_id % 5 = 0 AND name LIKE 'Open%')"""
_RESOLVED = f"""WITH c AS ({_CHOICE}), st AS ({_STATUS_TAGS}), r AS (SELECT c.*, tag_id AS status_id, CASE WHEN tag_id IS NULL THEN 'no_match' WHEN subject_id IS NOT NULL AND len(applies_to) > 0 AND NOT list_contains(applies_to, subject_id) THEN 'scope_mismatch' ELSE 'ok' END AS status_reason
FROM c LEFT JOIN st ON st.regulator_id = c.regulator_id AND st.name = CASE WHEN status_hint = 'Open' THEN 'Open / Accepting Applications' ELSE status_label END)"""


def _choices(t):
    rows = t.entry().join(t.document(), "document_id")
    hint = F.when(F.col("status_hint") == "O", "Open").when(F.col("status_hint") == "P", "Pending")
    return rows.select("entry_id", "regulator_id", "subject_id", "instrument_id", "confidence", "published_date", hint.alias("status_hint"), F.coalesce("status", F.lit("Unknown")).alias("status_label"))


def _status_tags(t):
    names = F.explode(F.array(*map(F.lit, ("In Force", "Amended", "Open / Accepting Applications"))))
    rows = t.regulator().select("regulator_id", names.alias("name")).filter(~((F.col("regulator_id") % 5 == 0) & F.col("name").startswith("Open")))
    scope = F.when(F.col("name") == "Amended", F.array(*(F.lit(f"S-{i}") for i in range(1, 6)))).otherwise(F.array().cast("array<string>"))
    return rows.select("regulator_id", "name", F.concat_ws("-", "name", "regulator_id").alias("tag_id"), scope.alias("applies_to"))


@query(_RESOLVED + " SELECT status_reason, status_id, count(*) AS n FROM r GROUP BY 1, 2")
def status_resolution(t):
    return ingest.resolve_status(_choices(t), _status_tags(t)).groupBy("status_reason", "status_id").agg(F.count("*").alias("n"))


@query(_RESOLVED + """ SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN confidence < 0.75 THEN 'low_confidence' END, CASE WHEN subject_id IS NULL THEN 'model_returned_invalid_subject_tag' END,
CASE WHEN status_reason = 'no_match' THEN 'model_returned_invalid_status_tag' END, CASE WHEN status_reason = 'scope_mismatch' THEN 'status_subject_scope_mismatch' END, CASE WHEN false THEN '' END], lambda x: x IS NOT NULL), '|') AS reasons FROM r) GROUP BY 1""")
def review_reasons(t):
    rows = ingest.resolve_status(_choices(t), _status_tags(t))
    no = F.lit(False)
    reasons = ingest.review_reasons(F.col("confidence"), F.col("subject_id"), F.col("instrument_id"), F.col("status_reason"), no, no)
    return rows.select(F.array_join(reasons, "|").alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT document_id, code || '-' || substr(category_hint, 1, 1) || '-' || coalesce(status_hint, 'UNK') || '-' || coalesce(year(published_date), 1998) AS prefix FROM document_v JOIN regulator_v USING (regulator_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY document_id) + CASE WHEN prefix LIKE 'NATION_3-1-%' THEN 998 ELSE 0 END AS n FROM r)
SELECT document_id, prefix || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS document_code FROM s""")
def document_codes(t):
    rows = t.document().join(t.regulator(), "regulator_id").select("document_id", "code", F.substring("category_hint", 1, 1).alias("subject_code"), F.col("status_hint").alias("instrument_code"), "published_date")
    years = t.spark.range(1990, 2010).select(F.explode(F.array(*map(F.lit, "FOP"))).alias("s"), F.col("id").alias("y"))
    existing = years.select(F.concat(F.lit("NATION_3-1-"), "s", F.lit("-"), "y", F.lit("-998")).alias("document_code"))
    return ingest.document_codes(rows, existing, ASOF, ["document_id"]).select("document_id", "document_code")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN title END AS text, doc_id % 5 = 0 OR (doc_id % 3 <> 0 AND doc_id % 2 = 0) AS extraction_failed FROM normalized_v WHERE title <> '' OR doc_id % 3 <> 0")
def text_choice(t):
    c = F.col("doc_id")
    rows = t.normalized().filter("title <> '' OR doc_id % 3 <> 0").select("doc_id", (c % 5 == 0).alias("extraction_failed"), F.when(c % 3 == 0, F.col("title")).alias("raw_text"), F.lit("html_page").alias("raw_text_source"), F.lit(True).alias("needs_download"), F.when(c % 2 == 0, F.lit("https://x/y.pdf")).alias("file_url"))
    return ingest.chosen_text(rows).select("doc_id", "text", "extraction_failed")


@query("""SELECT CASE WHEN length(trim(title)) >= 58 THEN 'direct' WHEN n_chars >= 500 THEN 'ocr' ELSE 'failed' END AS route, count(*) AS n FROM normalized_v GROUP BY 1""")
def extraction_routing(t):
    rows = t.normalized().withColumn("ocr", F.repeat(F.lit("x"), F.col("n_chars").cast("int")))
    return rows.groupBy(ingest.route(F.col("title"), F.col("ocr"), 58, 500).alias("route")).agg(F.count("*").alias("n"))


@query("SELECT regulator_id, facet FROM (SELECT regulator_id FROM regulator_v), (VALUES ('SUBJECT'), ('INSTRUMENT_TYPE'), ('STATUS')) f(facet) EXCEPT SELECT regulator_id, facet FROM tag_v WHERE status = 'ACTIVE'")
def missing_facets(t):
    return ingest.missing_facets(t.tag(), t.regulator())


@query("""WITH r AS (SELECT p_partkey AS k, p_name AS subject, CAST(p_size % 25 AS INTEGER) AS regulator_id FROM part), n AS (SELECT regulator_id, name, min(tag_id) AS tag_id FROM tag_v WHERE facet = 'SUBJECT' GROUP BY 1, 2)
SELECT k, tag_id FROM r LEFT JOIN n ON n.name = r.subject AND n.regulator_id = r.regulator_id""")
def tag_by_name(t):
    rows = t.raw("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("subject"), (F.col("p_size") % 25).cast("int").alias("regulator_id"))
    return ingest.resolve_tags(rows, t.tag(), "SUBJECT", "subject", "tag_id").select("k", "tag_id")


@query("""SELECT event_id, CASE WHEN status IN ('click', 'view') THEN status END AS subject, value > 50 AND status IN ('click', 'view') OR status NOT IN ('click', 'view') AS needs_review FROM event_v""")
def model_output(t):
    raw = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.lit(True).alias("keep"), F.col("status").alias("subject"), F.lit(90.0).alias("confidence"), (F.col("value") > 50).alias("needs_review"))), F.lit(" done"))
    rows = t.events().select("event_id", raw.alias("raw"))
    return ingest.validated(rows, {"subject": ["click", "view"]}).select("event_id", "subject", "needs_review")


@query("SELECT regulator_id, facet, CAST(to_json(list({'value': name, 'meaning': coalesce(concept, '')} ORDER BY name, coalesce(concept, ''))) AS VARCHAR) AS tags FROM tag_v GROUP BY 1, 2")
def prompt_tag_lists(t):
    return ingest.prompt_tags(t.tag().withColumn("definition", F.col("concept")))


_LADDER = "CASE WHEN contains(t, 'draft') AND contains(t, 'rule') THEN 'draft_rule' " + " ".join(f"WHEN contains(t, '{w}') THEN '{k}'" for w, k in text.DOCUMENT_TYPES) + " ELSE 'other' END"


@query(f"""SELECT doc_id, '{{"keep":true,"instrument_type":"' || {_LADDER} || '","confidence":0.5,"needs_review":false}}' AS raw FROM (SELECT doc_id, lower(title) AS t FROM normalized_v)""")
def classified_titles(t):
    return ingest.classified(t.normalized()).select("doc_id", "raw")


# Duplicates
_FIRST = "SELECT document_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts {0}, event_id {0}) AS r FROM event_v) WHERE r = 1"
variant("dedup_first_wins", lambda t: dedup.one_per_key(t.events(), ["document_id"], ["ts", "event_id"]).select("document_id", "event_id", "status"), _FIRST.format("ASC"))
variant("dedup_last_wins", lambda t: dedup.one_per_key(t.events(), ["document_id"], ["ts", "event_id"], last=True).select("document_id", "event_id", "status"), _FIRST.format("DESC"))


@query("""SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY (p_size > 40)::INT DESC, p_partkey) AS r, p_name IN (SELECT min(p_name) FROM part UNION SELECT max(p_name) FROM part) AS listed FROM part) WHERE NOT listed OR r = 1""")
def known_duplicate_merge(t):
    part = t.raw("part").select("p_partkey", F.col("p_name").alias("title"), "p_size")
    ends = part.agg(F.array(F.min("title"), F.max("title")).alias("t")).select(F.explode("t").alias("title"))
    return dedup.known_duplicates(part, ends, F.col("p_size") > 40, "p_partkey").select("p_partkey")


@query("""WITH e AS (SELECT event_id, status AS title, CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['Notice'] ELSE ['Q1', 'Licence 06 of 2026'] END AS names FROM event_v),
x AS (SELECT event_id, title, 0 AS attachment_index, len(names) AS attachment_count, NULL AS name FROM e WHERE len(names) = 0
UNION ALL SELECT event_id, title, i - 1, len(names), names[i] FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM e))
SELECT event_id, CAST(attachment_index AS INTEGER) AS attachment_index, CAST(attachment_count AS INTEGER) AS attachment_count, CASE WHEN attachment_index = 0 THEN title WHEN regexp_matches(name, '(?i)\\d{4}|case\\s*no|licence|license|regulation') THEN name ELSE name || ' — ' || title END AS title FROM x""")
def attachment_explode(t):
    named = lambda *names: F.array(*(F.struct(F.lit(f"u/{n}").alias("url"), F.lit(n).alias("name")) for n in names))
    k = F.col("k") % 3
    lists = F.when(k == 0, F.array().cast("array<struct<url:string,name:string>>")).when(k == 1, named("Notice")).otherwise(named("Q1", "Licence 06 of 2026"))
    rows = t.events().select("event_id", F.col("status").alias("title"), lists.alias("attachments"))
    return dedup.explode_attachments(rows).select("event_id", "attachment_index", "attachment_count", "title")


def _listing(t):
    rows = t.normalized().select("feed", F.col("doc_id").alias("position"), "title", (F.col("n_chars") % 4).cast("string").alias("listed_date"), F.when(F.col("lang") == "en", "Active").otherwise("").alias("status"))
    return rows.withColumn("source_section", F.when(F.col("position") % 5 == 0, "archive").otherwise("home")).withColumn("pdf_link", F.lit("x"))


@query()
def fuzzy_title_clusters(t):
    return dedup.fuzzy_clusters(_listing(t)).select("feed", "position", "cluster")


@query()
def fuzzy_representatives(t):
    return dedup.representatives(dedup.fuzzy_clusters(_listing(t)), ["archive"]).select("feed", "cluster", "position")


@query("SELECT p_partkey, p_partkey <> first AS copy FROM part JOIN (SELECT p_name, p_brand, min(p_partkey) AS first FROM part GROUP BY 1, 2) USING (p_name, p_brand)")
def copies_after_rekey(t):
    rows = t.raw("part").select(F.concat_ws("|", "p_name", "p_brand").alias("key"), "p_partkey")
    return dedup.copies_after_rekey(rows, "key", "p_partkey").select("p_partkey", "copy")


# Maintenance
@query("""WITH s AS (SELECT p_partkey AS source_id, lower(p_name) AS t FROM part), n AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1000000 ELSE 0 END AS source_id, lower(p_name) AS t FROM part)
SELECT n.source_id, CASE WHEN ns IS NULL THEN 'new' WHEN ns > 1 OR nn > 1 THEN 'ambiguous' ELSE 'remap' END AS outcome, CASE WHEN ns = 1 AND nn = 1 THEN lo END AS stored_id
FROM n JOIN (SELECT t, count(*) AS nn FROM n GROUP BY t) USING (t) LEFT JOIN (SELECT t, count(*) AS ns, min(source_id) AS lo FROM s GROUP BY t) USING (t) WHERE n.source_id NOT IN (SELECT source_id FROM s)""")
def remap_one_to_one(t):
    part = t.raw("part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"))
    scraped = part.withColumn("source_id", F.col("source_id") + F.when(F.col("source_id") % 2 == 0, 1000000).otherwise(0))
    return maintain.remap(scraped, part, F.lower("title"))


@query("SELECT entry_id, coalesce(status, 'Default ' || category_hint) AS status FROM entry_v JOIN document_v USING (document_id)")
def status_backfill(t):
    rows = t.entry().join(t.document(), "document_id").select("entry_id", "category_hint", "status")
    mapping = rows.select("category_hint").distinct().withColumn("status", F.concat(F.lit("Default "), "category_hint"))
    return maintain.backfill(rows, mapping, ["category_hint"], "status").select("entry_id", "status")


_ORDERS_AS_TITLES = "SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, 'PMA/IN-SPACe/AUTH/2024/' || (o_orderkey % 500) || CASE WHEN o_orderkey % 11 = 0 THEN 'A' ELSE '' END || CASE WHEN o_orderkey % 13 = 0 THEN ' Amendment No. 1' ELSE '' END AS title, CASE o_orderstatus WHEN 'F' THEN 'In Force' WHEN 'P' THEN 'Amended' END AS status, o_orderkey AS position FROM orders"


def _titled_orders(t):
    k = F.col("o_orderkey")
    title = F.concat(F.lit("PMA/IN-SPACe/AUTH/2024/"), k % 500, F.when(k % 11 == 0, "A").otherwise(""), F.when(k % 13 == 0, " Amendment No. 1").otherwise(""))
    status = F.when(F.col("o_orderstatus") == "F", "In Force").when(F.col("o_orderstatus") == "P", "Amended")
    return t.raw("orders").select(k.cast("string").alias("entry_id"), title.alias("title"), status.alias("status"), k.alias("position"))


@query(f"""WITH r AS ({_ORDERS_AS_TITLES}), n AS (SELECT *, position % 500 AS number FROM r), b AS (SELECT number, arg_max(entry_id, position) AS base_id, max(position) AS p FROM n WHERE position % 11 <> 0 GROUP BY 1)
SELECT a.entry_id, base_id, CASE WHEN base_id IS NULL THEN 'not_found' WHEN x.status = 'Amended' THEN 'already' WHEN coalesce(x.status, 'In Force') <> 'In Force' THEN 'skipped' ELSE 'updated' END AS outcome
FROM n a LEFT JOIN b USING (number) LEFT JOIN r x ON x.entry_id = base_id WHERE a.title LIKE '%Amendment%'""")
def amendment_chain(t):
    return maintain.amendment_targets(_titled_orders(t)).select("entry_id", "base_id", "outcome")


@query(f"""WITH r AS ({_ORDERS_AS_TITLES}), n AS (SELECT *, position % 500 AS number FROM r), b AS (SELECT number, arg_max(entry_id, position) AS base_id FROM n WHERE position % 11 <> 0 GROUP BY 1),
u AS (SELECT DISTINCT base_id FROM n JOIN b USING (number) WHERE title LIKE '%Amendment%') SELECT entry_id, CASE WHEN entry_id IN (SELECT base_id FROM u) AND coalesce(status, 'In Force') = 'In Force' THEN 'Amended' ELSE status END AS status FROM r""")
def amendment_applied(t):
    return maintain.amend(_titled_orders(t)).select("entry_id", "status")


_RULES = "SELECT CAST(o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN 'auth/2024' ELSE 'tender' END AS title_contains, 'In Force' AS from_status, 'Superseded' AS to_status FROM orders"


@query(f"""WITH r AS ({_ORDERS_AS_TITLES}), x AS ({_RULES}) SELECT x.entry_id, to_status, CASE WHEN title IS NULL THEN 'not_found' WHEN NOT contains(lower(title), title_contains) THEN 'title_changed' WHEN status IS DISTINCT FROM from_status THEN 'already_changed' ELSE 'fixed' END AS outcome FROM x LEFT JOIN r USING (entry_id)""")
def status_rule_fix(t):
    k = F.col("o_orderkey")
    rules = t.raw("orders").select((k + F.when(k % 50 == 0, 100000000).otherwise(0)).cast("string").alias("entry_id"), F.when(k % 4 == 0, "auth/2024").otherwise("tender").alias("title_contains"), F.lit("In Force").alias("from_status"), F.lit("Superseded").alias("to_status"))
    return maintain.status_rules(_titled_orders(t), rules)


@query("""WITH d AS (SELECT entry_id, CASE WHEN confidence < 0.7 THEN 'S-' || (part_key + 25) ELSE subject_id END AS subject_id, instrument_id, regulator_id FROM entry_v JOIN document_v USING (document_id) WHERE needs_review)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN coalesce(d.subject_id, '') = '' THEN 'missing_tag' WHEN s.tag_id IS NULL THEN 'bad_subject' WHEN i.tag_id IS NULL THEN 'bad_instrument' ELSE 'accepted' END AS outcome
FROM d LEFT JOIN tag_v s ON s.tag_id = d.subject_id AND s.facet = 'SUBJECT' AND s.regulator_id = d.regulator_id LEFT JOIN tag_v i ON i.tag_id = d.instrument_id AND i.facet = 'INSTRUMENT_TYPE' AND i.regulator_id = d.regulator_id) GROUP BY 1""")
def review_resolution(t):
    entries = t.entry().join(t.document(), "document_id")
    decisions = entries.filter("needs_review").select("entry_id", "regulator_id", F.when(F.col("confidence") < 0.7, F.concat(F.lit("S-"), F.col("part_key") + 25)).otherwise(F.col("subject_id")).alias("subject_id"), "instrument_id")
    return maintain.review_decisions(decisions, entries, t.tag()).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts) + INTERVAL 1 DAY ELSE ts END AS ts FROM events")
def midnight_shift(t):
    ts, reached = F.col("ts"), F.col("event_id") % 4 == 0
    stored = F.when(reached, F.date_trunc("day", ts) + F.expr("INTERVAL '18:30' HOUR TO MINUTE")).otherwise(ts)
    return t.events().select("event_id", maintain.unshift(stored, reached).cast("timestamp_ntz").alias("ts"))


@query("SELECT document_id, CASE WHEN category_hint NOT LIKE '1%' THEN published_date END AS published_date FROM document_v", "published_date")
def event_dates_cleared(t):
    rows = t.document().select("document_id", "published_date", "category_hint")
    return maintain.clear_dates(rows, rows.filter("category_hint LIKE '1%'"), "document_id", "published_date").select("document_id", "published_date")


@query("SELECT document_id, published_date FROM document_v WHERE day(published_date) <= 12 AND month(published_date) <= 12", "published_date")
def ambiguous_dates(t):
    return t.document().filter(dates.ambiguous(F.col("published_date"))).select("document_id", "published_date")


@query("""WITH r AS (SELECT document_id, CASE WHEN document_id % 2 = 0 THEN strftime(published_date, '%d/%m/%Y') ELSE strftime(published_date, '%m/%d/%Y') END AS raw, published_date AS d FROM document_v)
SELECT document_id, CASE WHEN raw IS NULL THEN NULL WHEN document_id % 2 = 0 OR document_id % 3 = 0 OR day(d) > 12 THEN d ELSE make_date(year(d), day(d), month(d)) END AS rebuilt,
CASE WHEN raw IS NULL THEN 'no_raw_row' WHEN day(d) <= 12 AND document_id % 3 = 0 THEN 'evidence' WHEN day(d) <= 12 THEN 'convention_ddmm' WHEN document_id % 2 = 0 THEN 'unambiguous_ddmm' ELSE 'unambiguous_mmdd' END AS basis FROM r""", "rebuilt")
def dot_date_rebuild(t):
    named = F.concat(F.lit("Notice dated "), F.date_format("published_date", "dd-MM-yyyy"), F.lit(" on licences"))
    d = t.document().select("document_id", "published_date", F.when(F.col("document_id") % 3 == 0, named).otherwise("").alias("title"))
    raw = d.filter("published_date IS NOT NULL").select("document_id", F.when(F.col("document_id") % 2 == 0, F.date_format("published_date", "dd/MM/yyyy")).otherwise(F.date_format("published_date", "MM/dd/yyyy")).alias("raw_date"))
    return maintain.rebuild_dates(d, raw, "document_id", F.lit(ASOF).cast("date")).select("document_id", "rebuilt", "basis")


@query(f"SELECT document_id, CASE WHEN published_date <= DATE '{ASOF}' THEN published_date END AS issued FROM document_v WHERE published_date IS NOT NULL", "issued")
def issue_date_extract(t):
    d = F.col("published_date")
    body = F.concat(F.lit("Ref. 12/3/1999.\n  Dated:   "), F.when(F.col("document_id") % 2 == 0, F.date_format(d, "d MMMM yyyy")).otherwise(F.date_format(d, "dd-MM-yyyy")), F.lit("\nvalid till 01-01-1950"))
    rows = t.document().filter("published_date IS NOT NULL")
    return rows.select("document_id", dates.issue_date(body, F.lit(ASOF).cast("date"))["date"].alias("issued"))


# Scalars
@query("SELECT document_id, sha1(regulator_id || '|' || coalesce(file_url, '') || '|' || category_hint) AS source_id, substr(sha1(document_id || '||' || coalesce(file_url, '')), 1, 20) AS short_id FROM document_v")
def sha1_source_ids(t):
    return t.document().select("document_id", text.stable_id(F.col("regulator_id"), F.col("file_url"), F.col("category_hint")).alias("source_id"), text.stable_id(F.col("document_id"), F.col("file_url"), sep="||", length=20).alias("short_id"))


@query("SELECT CASE document_id % 4 WHEN 0 THEN 'direct-file' WHEN 1 THEN 'flipbook' WHEN 2 THEN 'external-reference' ELSE 'none' END AS kind, document_id % 4 = 0 AS pdf, count(*) AS n FROM document_v GROUP BY 1, 2")
def file_kinds(t):
    return t.document().groupBy(urls.file_kind(F.col("file_url")).alias("kind"), urls.is_pdf(F.col("file_url")).alias("pdf")).agg(F.count("*").alias("n"))


@query("SELECT CASE document_id % 4 WHEN 0 THEN 'ISRO' WHEN 1 THEN 'DOS' END AS entity, count(*) AS n FROM document_v GROUP BY 1")
def issuing_entity(t):
    return t.document().groupBy(urls.issuing_entity(F.col("file_url")).alias("entity")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN contains(t, 'draft') AND contains(t, 'rule') THEN 'draft_rule' WHEN contains(t, 'draft') THEN 'draft' WHEN contains(t, 'circular') THEN 'circular' WHEN contains(t, 'order') THEN 'order' ELSE 'other' END AS kind
FROM (SELECT p_partkey, lower(p_name || ' ' || CASE p_size % 5 WHEN 0 THEN 'Draft Rules' WHEN 1 THEN 'Draft' WHEN 2 THEN 'Circular order' WHEN 3 THEN 'ORDER' ELSE '' END) AS t FROM part)""")
def document_type_ladder(t):
    extra = F.element_at(F.array(*map(F.lit, ("Draft Rules", "Draft", "Circular order", "ORDER", ""))), (F.col("p_size") % 5 + 1).cast("int"))
    return t.raw("part").select("p_partkey", text.document_type(F.concat_ws(" ", "p_name", extra)).alias("kind"))


@query("""SELECT k, codes, count(*) AS n FROM (SELECT p_size % 4 AS k, CASE p_size % 4 WHEN 0 THEN 'code_on_wages|social_security_code' WHEN 1 THEN 'osh_code' WHEN 2 THEN 'industrial_relations_code' ELSE 'other' END AS codes FROM part) GROUP BY 1, 2""")
def labour_codes(t):
    titles = F.element_at(F.array(*map(F.lit, ("Minimum Wage and Pension rules", "Safety of dock labour", "Lockout notice", "Plain note"))), (F.col("p_size") % 4 + 1).cast("int"))
    return t.raw("part").groupBy((F.col("p_size") % 4).alias("k"), F.array_join(text.labour_codes(titles), "|").alias("codes")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM normalized_v")
def matching_titles(t):
    return t.normalized().select("doc_id", text.matching_title(F.col("title")).alias("norm"))


@query("SELECT doc_id, rtrim(substr(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> '')[1:8], '-'), 1, 80), '-') AS slug FROM normalized_v")
def title_slugs(t):
    return t.normalized().select("doc_id", text.slug(F.col("title")).alias("slug"))


@query("SELECT document_id, coalesce(strftime(published_date, '%d-%m-%Y'), 'No date') AS shown, coalesce(published_date > DATE '1998-01-01', false) AS unverified FROM document_v")
def displayed_dates(t):
    d = F.col("published_date")
    return t.document().select("document_id", dates.display(d).alias("shown"), F.coalesce(d > F.lit(ASOF).cast("date"), F.lit(False)).alias("unverified"))


@query("""SELECT document_id, CASE WHEN document_id % 5 = 4 THEN NULL ELSE published_date END AS parsed FROM document_v WHERE published_date IS NOT NULL""", "parsed")
def dates_of_many_forms(t):
    d = F.col("published_date")
    raw = F.element_at(F.array(F.date_format(d, "dd.MM.yyyy"), F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM, yyyy")), F.date_format(d, "ddMMM yyyy"), F.date_format(d, "d-MMM-yyyy"), F.lit("31.02.2024")), (F.col("document_id") % 5 + 1).cast("int"))
    return t.document().filter("published_date IS NOT NULL").select("document_id", dates.free(raw).alias("parsed"))


@query(f"SELECT document_id, CASE WHEN published_date >= DATE '{ASOF}' THEN 'Open' WHEN published_date IS NOT NULL THEN 'Closed' END AS state, year(published_date) AS y FROM document_v")
def open_or_closed(t):
    d = F.col("published_date")
    return t.document().select("document_id", dates.open_or_closed(d, F.lit(ASOF).cast("date")).alias("state"), dates.last_year(F.date_format(d, "dd/MM/yyyy")).alias("y"))


# Samples
_HASH = "sha1('7|' || {0}), {0}"


@query(f"SELECT doc_id FROM normalized_v ORDER BY {_HASH.format('doc_id')} LIMIT 100")
def uniform_sample(t):
    return sample.uniform(t.normalized(), "doc_id", 100, 7).select("doc_id")


_WEIGHTS = "SELECT feed, CAST(count(*) * CASE feed WHEN 'src0' THEN 40 WHEN 'src1' THEN 3 ELSE 1 END AS DOUBLE) AS weight FROM normalized_v GROUP BY feed"
_QUOTAS = f"""w AS ({_WEIGHTS}), x AS (SELECT feed, 200.0::DOUBLE * weight / (SELECT sum(weight) FROM w) AS e FROM w),
q AS (SELECT feed, CAST(floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, feed) <= 200 - (SELECT sum(floor(e)) FROM x) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x)"""


def _weights(t):
    factor = F.when(F.col("feed") == "src0", 40).when(F.col("feed") == "src1", 3).otherwise(1)
    return t.normalized().groupBy("feed").agg(F.count("*").alias("n")).select("feed", (F.col("n") * factor).cast("double").alias("weight"))


@query(f"WITH {_QUOTAS} SELECT feed, weight, quota FROM q JOIN w USING (feed)")
def sample_quotas(t):
    return sample.quotas(_weights(t), 200, "feed")


@query(f"WITH {_QUOTAS} SELECT doc_id, feed FROM (SELECT doc_id, feed, row_number() OVER (PARTITION BY feed ORDER BY {_HASH.format('doc_id')}) AS r FROM normalized_v) JOIN q USING (feed) WHERE r <= quota")
def stratified_sample(t):
    return sample.stratified(t.normalized(), "feed", "doc_id", _weights(t), 200, 7).select("doc_id", "feed")


_HALF = f"""WITH h AS (SELECT document_id, published_date < DATE '1995-06-01' AS old, row_number() OVER (PARTITION BY coalesce(published_date < DATE '1995-06-01', false) ORDER BY {_HASH.format('document_id')}) AS r FROM document_v),
c AS (SELECT least(3000, count(CASE WHEN old THEN 1 END)) AS na, least(3000, count(*) - count(CASE WHEN old THEN 1 END)) AS nb FROM h), k AS (SELECT least(greatest(1500, 3000 - nb), na) AS ta, nb FROM c)
SELECT document_id, coalesce(old, false) AS first_side FROM h, k WHERE (coalesce(old, false) AND r <= ta) OR (NOT coalesce(old, false) AND r <= least(3000 - ta, nb))"""


@query(_HALF)
def half_half_sample(t):
    return sample.half_and_half(t.document(), "document_id", F.col("published_date") < "1995-06-01", 3000, 7).select("document_id", "first_side")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER w - 1 AS i, greatest(1, count(*) OVER (PARTITION BY feed) // 10) AS s FROM normalized_v WINDOW w AS (PARTITION BY feed ORDER BY doc_id)) WHERE i % s = 0 AND i // s < 10")
def systematic_sample(t):
    return sample.systematic(t.normalized(), "feed", "doc_id").select("doc_id")


@query(f"SELECT document_id FROM document_v WHERE year(published_date) > 1998 - 3")
def recent_years_census(t):
    return sample.recent_years(t.document(), F.year("published_date"), 1998).select("document_id")


# Changes
_LOG = """WITH v AS (SELECT document_id, event_id, ts, status, CAST(CAST(kept AS INTEGER) AS VARCHAR) AS kept, row_number() OVER w AS r, lag(status) OVER w AS ps, lag(CAST(CAST(kept AS INTEGER) AS VARCHAR)) OVER w AS pk FROM event_v WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
l AS (SELECT document_id, event_id, ts, 'status' AS field_changed, ps AS old_value, status AS new_value FROM v WHERE r > 1 AND ps IS DISTINCT FROM status UNION ALL SELECT document_id, event_id, ts, 'kept', pk, kept FROM v WHERE r > 1 AND pk IS DISTINCT FROM kept)"""


@query(_LOG + " SELECT document_id, event_id, field_changed, old_value, new_value FROM l")
def change_log(t):
    return changes.change_log(t.events()).drop("ts")


@query(_LOG + " SELECT document_id, event_id, field_changed, old_value, new_value FROM l")
def change_log_stream(t):
    """The change log once more, as a stream with state for each document, run over what is there."""
    files = f"{t.dir}/events*.parquet"
    raw = t.spark.readStream.schema(t.raw("events").schema).parquet(files)
    target = scratch(t.spark, "change-log")
    changes.replay(changes.stream_change_log(as_events(raw)), f"{target}/rows", f"{target}/checkpoint")
    return t.spark.read.schema(changes.CHANGE).parquet(f"{target}/rows")


@query(_LOG + " SELECT s.document_id, s.status, max(l.ts) AS changed_at FROM l JOIN store_v s USING (document_id) WHERE field_changed = 'status' AND l.ts >= TIMESTAMP '2024-01-25' GROUP BY 1, 2")
def status_changes_since(t):
    return changes.status_changes_since(changes.change_log(t.events()), t.store(), "2024-01-25").withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query("SELECT document_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS r FROM event_v) WHERE r = 1 AND status = 'purchase'")
def first_insert_alerts(t):
    return changes.first_inserts(t.events(), F.col("status") == "purchase").select("document_id", "event_id")


@query("""SELECT event_id AS document_id, CASE WHEN event_id % 10 = 9 THEN 'new' WHEN event_id % 4 <> 0 THEN 'not_pdf' WHEN k % 5 = 0 THEN 'failed' WHEN k % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS decision FROM event_v""")
def fingerprint_skip(t):
    e, k, i = t.events(), F.col("k"), F.col("event_id")
    items = e.select(i.alias("document_id"), F.when(i % 4 == 0, "https://x/A.PDF").otherwise("https://x/page").alias("url"), (k % 5 != 0).alias("head_ok"), F.concat(F.lit("e"), k % 2).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    held = e.filter("event_id % 10 <> 9").select(i.alias("document_id"), F.lit("e0").alias("etag"), F.lit("m").alias("last_modified"))
    return changes.fingerprints(items, held)


@query("""WITH s AS (SELECT document_id, min(event_id) AS stop FROM event_v WHERE k = 0 GROUP BY 1) SELECT e.document_id, event_id FROM event_v e LEFT JOIN s USING (document_id) WHERE stop IS NULL OR event_id < stop""")
def newest_first_stop(t):
    e = t.events()
    return changes.early_stop(e, e.filter("k = 0").select("event_id"), "event_id", "document_id", "event_id").select("document_id", "event_id")


@query("SELECT CASE WHEN n = 0 AND k % 2 = 0 THEN 'BLOCKED' WHEN k % 2 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS run_status, count(*) AS c FROM (SELECT k, k % 3 AS n FROM event_v) GROUP BY 1")
def run_statuses(t):
    k = F.col("k")
    return t.events().groupBy(quality.run_status(k % 3, (k + 1) % 2, F.lit(0), F.lit(None).cast("string")).alias("run_status")).agg(F.count("*").alias("c"))


# Pages and vectors
@query()
def page_clean_text(t):
    return t.raw("pages").select("page_id", html.clean_text("html").alias("text"))


@query("""SELECT page_id, 'Annual files' AS heading, '/f/' || page_id || '.pdf' AS url, 'Report' AS label, '2.5 MB' AS size FROM pages UNION ALL SELECT page_id, 'Forms', '/form', 'Form A', NULL FROM pages WHERE page_id % 2 = 0""")
def page_sections(t):
    """The fixture's pages hold no links under headings, so each gets a list of files and every other one a form."""
    files = F.concat(F.lit('<h2>Annual <b>files</b></h2><ul><li><a href="/f/'), "page_id", F.lit('.pdf">Report (2.5 MB)</a></li></ul>'))
    forms = F.when(F.col("page_id") % 2 == 0, '<h3>Forms</h3><a href="/form">Form A</a>').otherwise("")
    pages = t.raw("pages").select("page_id", F.concat("html", files, forms).alias("html"))
    return pages.select("page_id", F.explode(html.sections("html")).alias("s")).select("page_id", "s.*")


@query()
def page_hub_links(t):
    return html.hubs(t.raw("pages").select("page_id", "html"))


@query("""WITH b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}'), lambda x: trim(x, ' ')), lambda x: len(x) > 40)) AS c, generate_subscripts(list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}'), lambda x: trim(x, ' ')), lambda x: len(x) > 40), 1) AS i FROM documents),
s AS (SELECT *, lower(c) AS l FROM b), k AS (SELECT *, (len(l) - len(replace(l, 'the', ''))) // 3 + (len(l) - len(replace(l, 'and', ''))) // 3 + (len(l) - len(replace(l, 'tion', ''))) // 4 AS n FROM s),
r AS (SELECT *, row_number() OVER w AS rank, sum(len(c)) OVER (PARTITION BY doc_id ORDER BY n DESC, i ROWS UNBOUNDED PRECEDING) AS used FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, i))
SELECT doc_id, coalesce(string_agg(c, chr(10) || chr(10) ORDER BY i), '') AS digest FROM documents LEFT JOIN (SELECT doc_id, c, i FROM r WHERE rank = 1 OR used <= 600) USING (doc_id) GROUP BY doc_id""")
def keyword_digest(t):
    blocks = text.chunks(F.regexp_replace("text", "\n", "\n\n"), 40)
    return t.raw("documents").select("doc_id", text.digest(blocks, ["the", "and", "tion"], 600).alias("digest"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id IN (0, 1, 2, 3)), c AS (SELECT vec_id, max(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[])) AS s FROM embeddings, q GROUP BY vec_id)
SELECT vec_id, round(s, 4) AS score FROM c WHERE s >= 0.35 * (SELECT max(s) FROM c)""")
def cosine_top_chunks(t):
    """Vectors whose best cosine with four query vectors reaches 35 percent of the top one."""
    e = t.raw("embeddings")
    asked = e.filter(F.col("vec_id").isin(0, 1, 2, 3)).agg(F.collect_list("embedding").alias("asked"))  # one row, four vectors
    best = F.array_max(F.transform("asked", lambda q: text.cosine(F.col("embedding"), q)))
    scored = e.join(F.broadcast(asked)).select("vec_id", best.alias("s"))
    top = scored.agg(F.max("s").alias("top"))
    return scored.join(F.broadcast(top)).filter(F.col("s") >= 0.35 * F.col("top")).select("vec_id", F.round("s", 4).alias("score"))


# Further predicates, roles, set operations and scalars
@query("SELECT document_id, file_url FROM document_v WHERE published_date IS NULL AND file_url IS NOT NULL")
def undated_with_file(t):
    return t.document().filter("published_date IS NULL AND file_url IS NOT NULL").select("document_id", "file_url")


@query("SELECT tag_id FROM tag_v WHERE starts_with(name, 'blue')")
def prefix_tags(t):
    return t.tag().filter(F.col("name").startswith("blue")).select("tag_id")


@query("SELECT s.name AS subject, i.name AS instrument, count(*) AS n FROM entry_v LEFT JOIN tag_v s ON s.tag_id = subject_id LEFT JOIN tag_v i ON i.tag_id = instrument_id GROUP BY 1, 2")
def role_names(t):
    pairs = t.entry().groupBy("subject_id", "instrument_id").agg(F.count("*").alias("n"))
    return audit.roles(pairs, t.tag()).groupBy("subject", "instrument").agg(F.sum("n").alias("n"))


@query("SELECT tag_id, concept, n FROM tag_v LEFT JOIN (SELECT concept, count(*) AS n FROM tag_v WHERE concept IS NOT NULL GROUP BY 1) USING (concept)")
def tags_with_concept(t):
    sizes = t.tag().filter("concept IS NOT NULL").groupBy("concept").agg(F.count("*").alias("n"))
    return t.tag().join(sizes, "concept", "left").select("tag_id", "concept", "n")


@query("SELECT count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM (SELECT code, count(*) AS total FROM entry_v JOIN document_v USING (document_id) JOIN regulator_v USING (regulator_id) GROUP BY 1)")
def grand_totals(t):
    return overview.entries_by_regulator(t.entry(), t.document()).agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("SELECT name, (row_number() OVER (ORDER BY first, name) - 1) % 12 AS tone FROM (SELECT name, min(tag_id) AS first FROM tag_v WHERE facet = 'SUBJECT' GROUP BY 1)")
def tag_tones(t):
    return audit.tone_cycle(t.tag().filter("facet = 'SUBJECT'"), "name", "tag_id").withColumn("tone", F.col("tone").cast("long"))


@query("SELECT document_id FROM (SELECT document_id FROM entry_v WHERE needs_review UNION SELECT document_id FROM document_v WHERE published_date IS NULL)")
def known_ids_union(t):
    return t.entry().filter("needs_review").select("document_id").union(t.document().filter("published_date IS NULL").select("document_id")).distinct()


@query("SELECT regulator_id FROM regulator_v EXCEPT SELECT regulator_id FROM document_v WHERE published_date > DATE '2001-07-20'")
def uncovered_regulators(t):
    return t.regulator().select("regulator_id").subtract(t.document().filter("published_date > '2001-07-20'").select("regulator_id"))


@query("SELECT 'a' AS feed, document_id AS id, category_hint AS hint FROM document_v UNION ALL SELECT 'b', doc_id, NULL FROM normalized_v")
def feeds_united(t):
    a = t.document().select(F.lit("a").alias("feed"), F.col("document_id").alias("id"), F.col("category_hint").alias("hint"))
    return a.unionByName(t.normalized().select(F.lit("b").alias("feed"), F.col("doc_id").alias("id")), allowMissingColumns=True)


_DOOMED = "SELECT document_id FROM document_v WHERE regulator_id = 3"


@query(f"""SELECT 'documents' AS what, count(*) AS n FROM document_v WHERE regulator_id <> 3 UNION ALL SELECT 'entries', count(*) FROM entry_v WHERE document_id NOT IN ({_DOOMED})
UNION ALL SELECT 'links', count(*) FROM (SELECT document_id, lead(document_id) OVER (PARTITION BY part_key ORDER BY document_id, entry_id) AS other FROM entry_v) WHERE other IS NOT NULL AND document_id NOT IN ({_DOOMED}) AND other NOT IN ({_DOOMED})""")
def cascade_delete(t):
    entry = t.entry()
    following = F.lead("entry_id").over(Window.partitionBy("part_key").orderBy("document_id", "entry_id"))
    links = entry.select(F.col("entry_id").alias("from_id"), following.alias("to_id")).filter("to_id IS NOT NULL")
    d, e, kept = maintain.cascade_delete(t.document(), entry, links, t.document().filter("regulator_id = 3").select("document_id"))
    return audit.table_sizes(documents=d, entries=e, links=kept).withColumnRenamed("table_name", "what")


@query("""WITH m AS (SELECT concept, regulator_id, facet, name || CASE WHEN regulator_id = 4 THEN '?' ELSE '' END AS name FROM tag_v WHERE concept IS NOT NULL), k AS (SELECT regulator_id, facet, name, count(DISTINCT concept) AS n FROM m GROUP BY ALL)
SELECT 'unresolved' AS why, count(*) AS n FROM m WHERE regulator_id = 4 UNION ALL SELECT 'two_concepts', count(*) FROM k WHERE n > 1
UNION ALL SELECT 'one_regulator', count(*) FROM (SELECT concept FROM m GROUP BY 1 HAVING count(DISTINCT regulator_id) < 2) HAVING count(*) > 0""")
def mapping_violations(t):
    tag = t.tag()
    mapping = tag.filter("concept IS NOT NULL").select("concept", "regulator_id", "facet", F.when(F.col("regulator_id") == 4, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"))
    return maintain.mapping_violations(mapping, tag).groupBy("why").agg(F.count("*").alias("n"))


_NOISY = ["Chair delivered a keynote address", "Member paid a courtesy call", "Judged the final round", "Rules"]
_NOISY_SQL = "SELECT doc_id, title || ' ' || ['" + "', '".join(_NOISY) + "'][doc_id % 4 + 1] AS t FROM normalized_v"


@query(f"""SELECT doc_id, '{{0}}' AS source, NOT regexp_matches(t, '(?i){{1}}') AS kept, CASE WHEN regexp_matches(t, '(?i){{1}}') THEN 'dropped_by_prefilter' END AS method FROM ({_NOISY_SQL}) UNION ALL
SELECT doc_id, '{{2}}', NOT regexp_matches(t, '(?i){{3}}'), CASE WHEN regexp_matches(t, '(?i){{3}}') THEN 'dropped_by_prefilter' END FROM ({_NOISY_SQL})""".format(*(x for k, v in text.NOISE_RULES.items() for x in (k, "|".join(v)))))
def prefilter_kept(t):
    title = F.concat_ws(" ", "title", F.element_at(F.array(*map(F.lit, _NOISY)), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = t.normalized().select("doc_id", title.alias("title"))
    a, b = (audit.kept_or_dropped(rows.withColumn("source", F.lit(k)), text.worth_reading(F.col("title"), k)) for k in text.NOISE_RULES)
    return a.unionByName(b).select("doc_id", "source", "kept", "method")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'recruitment/vacancy advertisement' WHEN 1 THEN 'newsletter' WHEN 2 THEN 'monthly achievement/progress report' END AS reason FROM normalized_v""")
def title_scope(t):
    extra = F.element_at(F.array(*map(F.lit, ("Walk-in interview, newsletter", "E-Newsletter 5", "Monthly progress report", "Rules"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.normalized().select("doc_id", text.scope(F.concat_ws(" ", "title", extra))["reason"].alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name || ' [Case No. ' || p_brand || ']' ELSE 'Case No. ' || p_brand END AS title FROM part""")
def case_titles(t):
    k = F.col("p_size") % 3
    return t.raw("part").select("p_partkey", text.title_with_case(F.when(k != 2, F.col("p_name")), F.when(k != 0, F.col("p_brand"))).alias("title"))


@query("SELECT p_partkey, p_name || ' ' || (1990 + p_size) AS title FROM part")
def filename_titles(t):
    url = F.concat(F.lit("https://h/up/"), F.col("p_size"), F.lit(".-"), F.translate("p_name", " ", "_"), F.lit("-"), F.col("p_size") + 1990, F.lit("-"), F.col("p_partkey") % 9 + 1, F.lit(".pdf"))
    return t.raw("part").select("p_partkey", text.title_from_filename(url).alias("title"))


@query("SELECT c_custkey, 'Name: ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'Segment: ' || c_mktsegment END || chr(10) || 'end' AS block, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' | ' || c_mktsegment END AS hint FROM customer")
def labelled_blocks(t):
    seg = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return t.raw("customer").select("c_custkey", text.labelled_block(("Name", F.col("c_name")), ("Segment", seg), note="end").alias("block"), text.category_hint(F.col("c_name"), seg).alias("hint"))


@query("SELECT doc_id, (len(text) - len(replace(text, 'the', ''))) // 3 AS n, CASE WHEN len(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS cut, len(list_filter(string_split(text, chr(10)), lambda x: len(trim(x, ' ')) > 80)) AS blocks FROM documents")
def text_measures(t):
    body = F.regexp_replace("text", "\n", "\n\n")
    return t.raw("documents").select("doc_id", text.occurrences(F.col("text"), "the").cast("long").alias("n"), text.truncated(F.col("text"), 500, "...").alias("cut"), F.size(text.chunks(body)).cast("long").alias("blocks"))


@query("SELECT doc_id, (len(t) - len(replace(t, 'the', ''))) // 3 + (len(t) - len(replace(t, 'tion', ''))) // 4 AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def keyword_scores(t):
    return t.raw("documents").select("doc_id", text.keyword_score(F.col("text"), ["the", "tion"]).cast("long").alias("score"))


@query("SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'pdf' END AS extension, CASE document_id % 4 WHEN 0 THEN 'https://www.isro.gov.in/files/' || document_id || '.pdf' ELSE file_url END AS canonical, CASE document_id % 4 WHEN 0 THEN document_id || '.pdf' WHEN 3 THEN NULL ELSE CAST(document_id AS VARCHAR) END AS filename FROM document_v")
def url_parts(t):
    u = F.col("file_url")
    return t.document().select("document_id", urls.extension(u).alias("extension"), urls.canonical(u).alias("canonical"), F.when(u.isNotNull(), urls.filename(u)).alias("filename"))


@query("SELECT p_partkey, p_size AS page, 'https://h/' || p_type || '/cpppdata?url=' || rtrim(to_base64(encode('https://h/' || p_type || '/cpppdata?page=' || p_size)), '=') AS url FROM (SELECT p_partkey, p_size, lower(replace(p_type, ' ', '-')) AS p_type FROM part)")
def page_addresses(t):
    url = urls.page_url("https://h", F.lower(F.translate("p_type", " ", "-")), F.col("p_size"))
    return t.raw("part").select("p_partkey", urls.page_of(url).alias("page"), url.alias("url"))


@query("""SELECT document_id, CAST(published_date AS VARCHAR) AS a, CASE WHEN epoch(published_date) + 18000 >= 100000000 THEN CAST(published_date AS VARCHAR) END AS b, CAST(published_date AS VARCHAR) AS c,
CAST(make_date(year(published_date), CASE WHEN day(published_date) <= 12 THEN day(published_date) ELSE month(published_date) END, CASE WHEN day(published_date) <= 12 THEN month(published_date) ELSE day(published_date) END) AS VARCHAR) AS c2,
strftime(published_date, '%Y-%m-01') AS d, CAST(published_date AS VARCHAR) AS e FROM document_v WHERE published_date IS NOT NULL""")
def date_readers(t):
    d = F.col("published_date")
    rows = t.document().filter(d.isNotNull())
    a = dates.compact_or_epoch(F.date_format(d, "yyyyMMdd"))
    epoch = F.unix_timestamp(d.cast("timestamp") + F.expr("INTERVAL 5 HOURS"))
    b = dates.compact_or_epoch(F.when(epoch >= 100_000_000, epoch).cast("string"))  # under nine digits it is no epoch, and eight read as a day
    c = dates.month_first(F.date_format(d, "M/d/yyyy"))
    c2 = dates.month_first(F.date_format(d, "d/M/yyyy"))  # reads month first where it can
    month = dates.with_partial(F.date_format(d, "MMMM-yyyy"))
    e = dates.in_title(F.concat(F.lit("List as on "), F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM, yyyy")))
    return rows.select("document_id", a.cast("string").alias("a"), b.cast("string").alias("b"), c.alias("c"), c2.alias("c2"), month.alias("d"), e.cast("string").alias("e"))


@query("SELECT document_id, strftime(published_date, '%Y-%m-%d') AS start, strftime(published_date + 3, '%Y-%m-%d') AS finish, '15:00' AS at FROM document_v WHERE published_date IS NOT NULL")
def tender_ranges(t):
    d = F.col("published_date")
    shown = F.concat(F.lit("Monday, "), F.date_format(d, "MMM d, yyyy"), F.lit(" - to Friday, "), F.date_format(F.date_add(d, 3), "MMM d, yyyy"), F.lit(" - 15:00"))
    r = dates.tender_range(shown)
    return t.document().filter(d.isNotNull()).select("document_id", r["start"].cast("string").alias("start"), r["end"].cast("string").alias("finish"), r["time"].alias("at"))


@query("SELECT event_id, CASE k % 3 WHEN 0 THEN 'f' || event_id WHEN 1 THEN 'b' WHEN 2 THEN NULL END AS url, CASE k % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'flipbook' ELSE 'none' END AS kind FROM event_v")
def link_priority(t):
    k = F.col("k") % 3
    link = urls.first_link(F.when(k == 0, F.concat(F.lit("f"), "event_id")), F.when(k <= 1, "b"), F.lit(""))
    return t.events().select("event_id", link["url"].alias("url"), link["kind"].alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS label FROM customer")
def own_labels(t):
    return t.raw("customer").select("c_custkey", text.own_label(F.when(F.col("c_custkey") % 2 == 0, F.lit(" Click Here ")).otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("label"))


@query("SELECT document_id, CASE WHEN published_date <= DATE '1998-01-01' THEN CAST(published_date AS VARCHAR) END AS heard FROM document_v")
def hearing_dates(t):
    return t.document().select("document_id", dates.not_after(F.col("published_date"), F.lit(ASOF).cast("date")).cast("string").alias("heard"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS site FROM pages), m AS (SELECT site, min(page_id) AS last FROM p WHERE url LIKE '%page=2%' GROUP BY 1)
SELECT page_id, url FROM p LEFT JOIN m USING (site) WHERE last IS NULL OR page_id <= last""")
def pages_until_marker(t):
    from .sources import files

    rows = t.raw("pages").select(F.parse_url("url", F.lit("HOST")).alias("site"), "page_id", "url")
    return files.until_short(rows, "site", "page_id", F.when(F.col("url").contains("page=2"), 0).otherwise(1), 1).select("page_id", "url")


@query("SELECT event_id, CASE WHEN value > 100 THEN 'blocked' ELSE 'fine' END AS state FROM event_v")
def blocked_pages(t):
    html_text = F.when(F.col("value") > 100, F.lit("Access Denied " * 30)).otherwise(F.lit("plain words on a page " * 20))
    return t.events().select("event_id", F.when(text.is_blocked(F.lit(200), html_text), "blocked").otherwise("fine").alias("state"))


# Reports, maintenance and sources that no query above runs
@query("""WITH c AS (SELECT feed, lang, count(*) AS u, count(CASE WHEN title IS NOT NULL AND title <> '' THEN 1 END) AS w FROM normalized_v GROUP BY 1, 2), s AS (SELECT feed, CAST(sum(u) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS whole, max(u) AS most FROM c GROUP BY 1)
SELECT *, n >= 5 AND whole = n AND NOT (n >= 3 AND most * 2 > n) AS ok FROM s""")
def parser_report(t):
    return quality.parser_check(t.normalized(), "feed", ["title"], "lang", 5)


@query(f"SELECT document_id, file_url FROM document_v WHERE file_url IS NOT NULL ORDER BY {_HASH.format('document_id')} LIMIT 40")
def link_check_sample(t):
    return quality.link_sample(t.document(), "document_id", "file_url", 40, 7).select("document_id", "file_url")


@query("SELECT count(*) AS rows, count(CASE WHEN document_id % 4 = 0 THEN 1 END) AS needs_download, count(*) - count(file_url) AS no_file, count(*) - count(published_date) AS no_date FROM document_v")
def adapter_totals(t):
    return quality.adapter_totals(t.document().withColumn("needs_download", F.col("document_id") % 4 == 0))


@query("""WITH r AS (SELECT document_id AS run_id, min(ts) AS started_at, max(ts) AS finished_at FROM event_v GROUP BY 1), o AS (SELECT document_id AS run_id, count(*) AS sources, CAST(sum(k % 5) AS BIGINT) AS ingested, count(CASE WHEN k % 3 = 0 THEN 1 END) AS errors FROM event_v WHERE document_id % 2 = 0 GROUP BY 1)
SELECT run_id, CAST(floor(epoch(finished_at) - epoch(started_at)) AS BIGINT) AS seconds, coalesce(sources, 0) AS sources, coalesce(ingested, 0) AS ingested, coalesce(errors, 0) AS errors, coalesce(sources = errors, false) AS failed FROM r LEFT JOIN o USING (run_id)""")
def run_history(t):
    e = t.events()
    runs = e.groupBy(F.col("document_id").alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    results = e.filter("document_id % 2 = 0").select(F.col("document_id").alias("run_id"), F.when(F.col("k") % 3 == 0, "ERROR").otherwise("SUCCESS").alias("status"), (F.col("k") % 5).alias("ingested"))
    return changes.run_history(changes.run_log(runs), results).drop("started_at").withColumn("seconds", F.floor("seconds"))


@query("SELECT tag_id, CASE WHEN regulator_id % 2 = 0 THEN upper(concept) END AS concept FROM tag_v")
def relinked_tags(t):
    tags = t.tag().withColumn("name", F.concat_ws("/", "name", "tag_id"))  # names of their own, so that no two concepts claim one
    rows = tags.filter("concept IS NOT NULL AND regulator_id % 2 = 0").select("regulator_id", "facet", "name", F.upper("concept").alias("concept"))
    return maintain.relink_whole(tags, rows).select("tag_id", "concept")


_CENSUS = f"""WITH h AS (SELECT doc_id, feed, coalesce(n_chars < 1000, false) AS short, row_number() OVER (PARTITION BY n_chars < 1000 ORDER BY {_HASH.format('doc_id')}) AS r FROM normalized_v WHERE feed = 'src0'),
c AS (SELECT least(30, count(CASE WHEN short THEN 1 END)) AS na, least(30, count(*) - count(CASE WHEN short THEN 1 END)) AS nb FROM h), k AS (SELECT least(greatest(15, 30 - nb), na) AS ta, nb FROM c)
SELECT doc_id, feed FROM h, k WHERE (short AND r <= ta) OR (NOT short AND r <= least(30 - ta, nb)) UNION ALL SELECT doc_id, feed FROM normalized_v WHERE feed IN ('src1', 'src2')"""


@query(_CENSUS)
def census_sample(t):
    return sample.census_and_sample(t.normalized(), "feed", ["src1", "src2"], "src0", "doc_id", F.col("n_chars") < 1000, 30, 7).select("doc_id", "feed")


@query("SELECT page_id FROM pages WHERE page_id = 1 UNION ALL SELECT page_id FROM (SELECT page_id FROM pages WHERE page_id <> 1 ORDER BY sha1('7|' || page_id), page_id LIMIT 9)")
def page_sample(t):
    return sample.pages(t.raw("pages"), "page_id", 10, 7).select("page_id")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE p_name || '/' || p_brand END AS ref_no, CASE p_size % 3 WHEN 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS tender_id FROM part")
def reference_cells(t):
    k = F.col("p_size") % 3
    s = text.reference_segments(F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws("/", "p_name", "p_partkey")).otherwise(F.concat_ws("/", "p_name", "p_brand", "p_partkey")))
    return t.raw("part").select("p_partkey", s["ref_no"].alias("ref_no"), s["tender_id"].alias("tender_id"))


@query("SELECT p_partkey, 'https://h/list' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '?page=x' END AS feed FROM part")
def listing_feeds(t):
    url = F.concat(F.lit("https://h/list?page="), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("x"))
    return t.raw("part").select("p_partkey", urls.without_page(url).alias("feed"))


@query(f"""WITH s AS ({_STATUS_TAGS}) SELECT regulator_id, array_to_string(list_sort(applies_to), '|') AS scope, CAST(to_json(list({{'value': name, 'meaning': ''}} ORDER BY name)) AS VARCHAR) AS tags FROM s GROUP BY 1, 2""")
def prompt_status_groups(t):
    return ingest.prompt_status_groups(_status_tags(t).withColumn("facet", F.lit("STATUS")).withColumn("definition", F.lit(None).cast("string")))


def _stored_and_new(t):
    row = lambda df: df.select(F.col("document_id").alias("id"), F.col("status"), (F.col("k") % 4).cast("string").alias("subject"), F.when(F.col("value") > 50, "a").otherwise("b").alias("instrument_type"), "kept", F.col("ts").alias("ingested_at"))
    e = t.events()
    store = row(dedup.one_per_key(e, ["document_id"], ["ts", "event_id"])).withColumn("etag", F.lit("old")).withColumn("last_checked", F.lit(None).cast("timestamp"))
    return store.filter("id % 5 <> 0"), row(dedup.one_per_key(e, ["document_id"], ["ts", "event_id"], last=True)).filter("id % 7 <> 0")


_SN = """WITH x AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS z FROM event_v),
f AS (SELECT document_id AS id, status, CAST(k % 4 AS VARCHAR) AS subject, CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS instrument_type, CAST(CAST(kept AS INTEGER) AS VARCHAR) AS kept, ts FROM x WHERE a = 1 AND document_id % 5 <> 0),
l AS (SELECT document_id AS id, status, CAST(k % 4 AS VARCHAR) AS subject, CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS instrument_type, CAST(CAST(kept AS INTEGER) AS VARCHAR) AS kept, ts FROM x WHERE z = 1 AND document_id % 7 <> 0)"""


@query(_SN + """, p AS (SELECT f.id, 'subject' AS field_changed, f.subject AS old_value, l.subject AS new_value FROM f JOIN l USING (id) UNION ALL SELECT f.id, 'instrument_type', f.instrument_type, l.instrument_type FROM f JOIN l USING (id)
UNION ALL SELECT f.id, 'status', f.status, l.status FROM f JOIN l USING (id) UNION ALL SELECT f.id, 'kept', f.kept, l.kept FROM f JOIN l USING (id))
SELECT id AS document_id, field_changed, old_value, new_value FROM p WHERE old_value IS DISTINCT FROM new_value""")
def captured_changes(t):
    store, batch = _stored_and_new(t)
    return changes.capture(store, batch, F.lit(ASOF).cast("timestamp"))[1].drop("changed_at")


@query(_SN + " SELECT id, coalesce(l.status, f.status) AS status, coalesce(l.subject, f.subject) AS subject, coalesce(f.ts, l.ts) AS ingested_at, CASE WHEN f.id IS NOT NULL THEN 'old' END AS etag, l.id IS NOT NULL AS checked FROM f FULL JOIN l USING (id)")
def captured_store(t):
    store, batch = _stored_and_new(t)
    after = changes.capture(store, batch, F.lit(ASOF).cast("timestamp"))[0]
    return after.select("id", "status", "subject", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), "etag", F.col("last_checked").isNotNull().alias("checked"))


@query("SELECT event_id AS document_id, CASE WHEN event_id % 4 = 0 AND k % 5 <> 0 AND k % 2 = 0 THEN 'm2' ELSE 'm' END AS last_modified FROM event_v WHERE event_id % 10 <> 9")
def touched_fingerprints(t):
    e, k, i = t.events(), F.col("k"), F.col("event_id")
    items = e.select(i.alias("document_id"), F.when(i % 4 == 0, "https://x/A.PDF").otherwise("https://x/page").alias("url"), (k % 5 != 0).alias("head_ok"), F.concat(F.lit("e"), k % 2).alias("etag"), F.lit("m2").alias("last_modified"))
    store = e.filter("event_id % 10 <> 9").select(i.alias("document_id"), F.lit("e0").alias("etag"), F.lit("m").alias("last_modified"), F.lit(None).cast("timestamp").alias("last_checked"))
    after = changes.touch_checked(store, items, changes.fingerprints(items, store), F.lit(ASOF).cast("timestamp"), "document_id")
    return after.select("document_id", "last_modified")


_SOURCES = [("A", "tender-listing", ["[BLOCKED]"], 20 * registry.MINUTES, None), ("B", "case-orders", [], registry.DEFAULT_TIMEOUT, "a first run reads everything"), ("C", "file-only-feed", ["refused", "403"], registry.DEFAULT_TIMEOUT, None)]


@query("SELECT * FROM (VALUES ('A', 'tender-listing', CAST(1200000 AS BIGINT), NULL), ('B', 'case-orders', 2700000, 'a first run reads everything'), ('C', 'file-only-feed', 2700000, NULL)) v(code, adapter, timeout_ms, skipped)")
def source_plan(t):
    return registry.planned(registry.registry(t.spark, [registry.registration(*s) for s in _SOURCES]), "schedule")


@query("""WITH r AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS code, k, value FROM event_v)
SELECT event_id, CASE WHEN value > 90 AND code = 'A' THEN 'ERROR' WHEN code <> 'B' AND k % 2 = 0 AND k % 5 = 0 THEN 'BLOCKED' WHEN code <> 'B' AND k % 2 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS run_status FROM r""")
def source_outcomes(t):
    sources = registry.registry(t.spark, [registry.registration(*s) for s in _SOURCES])
    k = F.col("k")
    code = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C")
    said = F.when(k % 2 == 0, F.concat(F.lit("page 1 "), F.when(code == "A", "[BLOCKED]").otherwise("refused"))).otherwise("fine")
    outputs = t.events().select(code.alias("code"), said.alias("output"), (k % 5).alias("found"), F.lit(0).alias("failed"), F.when(F.col("value") > 90, 1500).otherwise(60).alias("seconds"), F.lit(None).cast("string").alias("error"), "event_id")
    rows = outputs.join(F.broadcast(sources), "code")
    return rows.select("event_id", registry.status_of(rows).alias("run_status"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'NIT 12/2024 (' || p_name || ')' ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN 'positive' ELSE 'draft' END AS tone, 'https://h/a/' || p_partkey AS url FROM part")
def organisations_tones_links(t):
    k = F.col("p_size") % 3
    title = text.title_with_organisation(F.when(k == 0, F.col("p_name")).when(k == 1, "NIT 12/2024").otherwise(""), F.when(k != 0, F.col("p_name")))
    tone = urls.status_tone(F.when(F.col("p_size") % 2 == 0, "In Force (amended)").otherwise("Draft / Open"))
    return t.raw("part").select("p_partkey", title.alias("title"), tone.alias("tone"), urls.absolute(F.lit("https://h/a/b"), F.col("p_partkey").cast("string")).alias("url"))


@query("SELECT document_id, '01-01-' || year(published_date) AS first_day, published_date AS said FROM document_v WHERE published_date IS NOT NULL", "said")
def years_and_title_days(t):
    d = F.col("published_date")
    title = F.concat(F.lit("Order of "), F.when(F.col("document_id") % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "d.M.yyyy")), F.lit(" and 31/12/1999"))
    return t.document().filter(d.isNotNull()).select("document_id", dates.bare_year_to_first(F.year(d).cast("string")).alias("first_day"), dates.day_first_in_title(title).alias("said"))


@query("SELECT document_id, CASE WHEN document_id % 3 = 0 THEN published_date END AS d, document_id % 3 = 1 AS unparseable FROM document_v WHERE published_date IS NOT NULL", "d")
def published_flags(t):
    k = F.col("document_id") % 3
    d, bad = ingest.published(F.when(k == 0, F.date_format("published_date", "yyyy-M-d")).when(k == 1, F.date_format("published_date", "MMMM yyyy")).otherwise(""))
    return t.document().filter("published_date IS NOT NULL").select("document_id", d.alias("d"), F.coalesce(bad, F.lit(False)).alias("unparseable"))


@query("SELECT document_id AS run_id, min(CAST(k % 3 = 0 AS INTEGER)) = 1 AS failed FROM event_v GROUP BY 1")
def failed_jobs(t):
    return quality.job_failed(t.events().select(F.col("document_id").alias("run_id"), F.when(F.col("k") % 3 == 0, "ERROR").otherwise("SUCCESS").alias("status")))


@query("SELECT event_id, CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS score FROM event_v")
def list_scores(t):
    item = lambda *keys: "{" + ", ".join(f'"{x}": "1"' for x in keys) + "}"
    k = F.col("k") % 3
    body = F.when(k == 0, F.lit("[" + ", ".join([item("title", "pub_date")] * 2) + "]")).when(k == 1, F.lit('{"data": [' + ", ".join([item("name", "x")] * 2) + "]}")).otherwise(F.lit('{"data": [' + item("title", "date") + "]}"))
    return t.events().select("event_id", quality.document_list_score(body).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, 'first' AS label FROM part")
def distinct_link_labels(t):
    link = lambda u, label: F.struct(u.alias("url"), F.lit(label).alias("label"))
    links = F.array(link(F.lit("u"), "first"), link(F.lit("u"), "again"), link(F.when(F.col("p_size") % 2 == 0, "v").otherwise("u"), "other"))
    kept = dedup.distinct_links(links)
    return t.raw("part").select("p_partkey", F.size(kept).cast("int").alias("n"), kept[0]["label"].alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS name, p_size FROM part UNION ALL SELECT p_partkey + 1000000, p_brand, NULL FROM part WHERE p_partkey % 10 = 0")
def upserted_parts(t):
    """Added parts are told by a key column of their own: their numbers can be those of parts where there are over a million."""
    part, size = t.raw("part").withColumn("added", F.lit(False)), F.lit(None).cast("int").alias("p_size")
    new = part.filter("p_partkey % 2 = 0").select("p_partkey", "added", F.col("p_brand").alias("name"), size)
    more = part.filter("p_partkey % 10 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.lit(True).alias("added"), F.col("p_brand").alias("name"), size)
    return maintain.upsert(part.select("p_partkey", "added", F.col("p_name").alias("name"), "p_size"), new.union(more), ["p_partkey", "added"]).drop("added")


@query("SELECT DISTINCT name, parent FROM (SELECT p_brand AS name, p_type AS parent FROM part)")
def orphan_names(t):
    return maintain.orphans(t.raw("part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("parent")).distinct(), "parent", "name").select("name", "parent")


@query("SELECT document_id, min(event_id) AS event_id FROM event_v WHERE document_id % 3 <> 0 GROUP BY 1")
def unseen_items(t):
    from .sources import files

    e = t.events().select("document_id", "event_id")
    return files.unseen(e, e.filter("document_id % 3 = 0").select("document_id").distinct(), "document_id", ["event_id"])


@query("SELECT entry_id, status FROM entry_v WHERE document_id % 40 = 0 AND status IS NOT NULL")
def files_round_trip(t):
    """Entries of some documents through a JSON file, a CSV file and a store copy, which drops what is not kept."""
    from .sources import files

    base = scratch(t.spark, "files")
    rows = t.entry().filter("document_id % 40 = 0").select("entry_id", "status", F.col("status").isNotNull().alias("kept"))
    files.write_json(rows, f"{base}/json")
    read = t.spark.read.schema(rows.schema).json(f"{base}/json")
    files.write_csv(read, f"{base}/csv", ["entry_id", "status", "kept"])
    files.csv(t.spark, f"{base}/csv", ["entry_id", "status", "kept"]).write.parquet(f"{base}/store")
    return files.store(t.spark, path=f"{base}/store").select("entry_id", "status")


@query("""SELECT 'order-' || o_orderkey AS source_id, 'Petition [Case No. ' || o_orderkey || ']' AS title, CASE o_orderkey % 3 WHEN 0 THEN 'Repealed' WHEN 1 THEN 'Draft' END AS status_hint, 'terms | section' AS category_hint FROM orders""")
def case_orders_normalized(t):
    k = F.col("o_orderkey")
    feed = F.when(k % 3 == 0, "regulations_repealed_x").when(k % 3 == 1, "regulations_draft").otherwise("orders")
    raw = t.raw("orders").select(feed.alias("feed"), F.concat(F.lit("order-"), k).alias("source_id"), F.lit("Petition").alias("title"), k.cast("string").alias("case_no"), F.lit("https://h/p").alias("source_url"), F.lit("2024-01-01").alias("published_date"), F.lit("https://h/f.pdf").alias("file_url"), F.lit("terms").alias("terms"), F.lit("section").alias("section"), F.lit("now").alias("scraped_at"))
    return ingest.ADAPTERS["case-orders"](raw).select("source_id", "title", "status_hint", "category_hint")


@query("SELECT 'id-' || p_partkey AS source_id, CASE p_partkey % 3 WHEN 0 THEN '2024-03-05' WHEN 1 THEN 'soon' END AS published_date, p_partkey % 2 = 0 AS needs_download, CASE WHEN p_partkey % 2 = 0 THEN 'pdf' END AS file_extension_hint FROM part")
def detail_pages_normalized(t):
    k = F.col("p_partkey")
    raw = t.raw("part").select(F.concat(F.lit("id-"), k).alias("id"), F.col("p_name").alias("title"), F.lit("https://h/d").alias("link"), F.when(k % 2 == 0, "https://h/f.pdf").otherwise("").alias("pdf_link"), F.when(k % 3 == 0, "Mar 5, 2024").when(k % 3 == 1, "soon").otherwise("").alias("date"), F.lit("c").alias("category"), F.lit("now").alias("scraped_at"))
    return ingest.ADAPTERS["detail-page-feed"](raw).select("source_id", "published_date", "needs_download", "file_extension_hint")
