"""Ingestion: tag and status resolution, review reasons, document codes, text choice, outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..schemas import NORMALIZED

ACCEPT = 0.75
# A source's own status and the status tag it stands for.
HINTS = {
    "Active": "In Force",
    "Expired": "Superseded / Repealed",
    "Open": "Open / Accepting Applications",
    "Closed": "Closed / Applications Closed",
    "Repealed": "Repealed",
    "Draft": "Draft / Under Consultation",
    "Live": "Live / Open",
    "Corrigendum Issued": "Corrigendum Issued",
}


def normalized(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows as NORMALIZED records; fields that are not given are null, needs_download is true by default."""
    defaults = {"needs_download": F.lit(True)}
    return rows.select(*(columns.get(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in NORMALIZED.fields))


#: Adapters by regulator code: functions from raw rows to NORMALIZED rows.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(code: str):
    def register(f):
        ADAPTERS[code] = f
        return f

    return register


@adapter("tender-listing")
def _tenders(rows: DataFrame) -> DataFrame:
    c = F.col
    block = text.labelled_block(("Tender title", c("title")), ("Issuing organisation", c("organisation")), ("Reference number", c("ref_no")), ("Tender ID", c("tender_id")), ("e-Published date", c("published_date")), ("Bid submission closing date", c("closing_date")), ("Tender opening date", c("opening_date")), ("Portal section", c("section")))
    return normalized(rows, regulator_code=F.lit("tender-listing"), source_id=c("source_id"), title=text.title_with_organisation(c("title"), c("organisation")), source_url=c("source_url"), published_date=F.date_format(dates.free(c("published_date")), "yyyy-MM-dd"), category_hint=text.category_hint(c("instrument_hint"), c("section"), c("organisation")), status_hint=c("status_hint"), raw_text=block, raw_text_source=F.lit("html_page"), needs_download=F.lit(False), scraped_at=c("scraped_at"))


@adapter("case-orders")
def _orders(rows: DataFrame) -> DataFrame:
    c = F.col
    feed = c("feed")
    status = F.when(feed.startswith("regulations_repealed") | feed.startswith("guidelines_repealed"), "Repealed").when(feed.startswith("regulations_draft"), "Draft")
    return normalized(rows, regulator_code=F.lit("case-orders"), source_id=c("source_id"), title=text.title_with_case(c("title"), c("case_no")), source_url=c("source_url"), published_date=c("published_date"), file_url=c("file_url"), file_extension_hint=urls.extension_hint(c("file_url")), category_hint=text.category_hint(c("terms"), c("section")), status_hint=status, scraped_at=c("scraped_at"))


@adapter("month-first-feed")
def _month_first(rows: DataFrame) -> DataFrame:
    c = F.col
    return normalized(rows, regulator_code=F.lit("month-first-feed"), source_id=c("id"), title=c("title"), source_url=c("pdf_url"), published_date=dates.month_first(c("publish_date")), file_url=c("pdf_url"), file_extension_hint=urls.extension(c("pdf_url")), category_hint=c("category"), scraped_at=c("scraped_at"))


@adapter("partial-dates-feed")
def _partial(rows: DataFrame) -> DataFrame:
    c = F.col
    link = F.coalesce("pdf_link", "flipbook_link", "external_link")
    return normalized(rows, regulator_code=F.lit("partial-dates-feed"), source_id=c("id"), title=c("title"), source_url=F.coalesce("detail_page_link", link), published_date=dates.with_partial(c("date")), file_url=link, file_extension_hint=urls.extension(c("pdf_link")), category_hint=text.category_hint(c("wing_category"), c("category")), scraped_at=c("created_at"))


@adapter("labour-feed")
def _labour(rows: DataFrame) -> DataFrame:
    c = F.col
    return normalized(rows, regulator_code=c("regulator"), source_id=text.stable_id(c("regulator"), c("source_url"), c("title")), title=c("title"), source_url=c("source_url"), published_date=F.coalesce(F.date_format(dates.basic(c("published_date")), "yyyy-MM-dd"), c("published_date")), file_url=F.when(urls.is_pdf(c("source_url")), c("source_url")), category_hint=text.category_hint(c("document_type"), c("labour_codes")), scraped_at=c("scraped_at"))


@adapter("document-store")
def _store(rows: DataFrame) -> DataFrame:
    """Kept rows of a package's own store."""
    c = F.col
    return normalized(rows.filter("kept"), regulator_code=F.lit("document-store"), source_id=c("id"), title=c("title"), source_url=F.coalesce("url", "id"), published_date=c("date"), file_url=c("url"), category_hint=c("subject"), status_hint=c("status"))


def iso_or_raw(raw: Column, read: Callable[[Column], Column]) -> Column:
    """ISO text of what reads as a date, else the raw text; null for empty text."""
    return F.when(raw != "", F.coalesce(F.date_format(read(raw), "yyyy-MM-dd"), raw))


def filled(c: Column) -> Column:
    """The text, null when it is empty."""
    return F.when(F.trim(c) != "", c)


def _file_feed(rows: DataFrame, code: str, read: Callable[[Column], Column], date: str, source_url: Column) -> DataFrame:
    """A feed of files: without a link there is nothing to download."""
    c, link = F.col, filled(F.col("pdf_link"))
    return normalized(rows, regulator_code=F.lit(code), source_id=c("id"), title=c("title"), source_url=F.coalesce(source_url, F.lit("")), published_date=iso_or_raw(c(date), read), file_url=link, file_extension_hint=F.when(link.isNotNull(), "pdf"), category_hint=c("category"), needs_download=link.isNotNull(), scraped_at=c("scraped_at"))


@adapter("detail-page-feed")
def _detail_pages(rows: DataFrame) -> DataFrame:
    """id, title, link (detail page), pdf_link, date, category, scraped_at."""
    return _file_feed(rows, "detail-page-feed", dates.free, "date", F.col("link"))


@adapter("file-only-feed")
def _file_only(rows: DataFrame) -> DataFrame:
    """id, title, pdf_link, publish_date (month first), category, scraped_at; the file is the source."""
    return _file_feed(rows, "file-only-feed", lambda c: dates.parse(F.trim(c), ["M/d/yyyy"]), "publish_date", F.col("pdf_link"))


def _excerpted(rows: DataFrame, code: str, title: Column, date: Column, link: Column, hint: Column, excerpt: Column) -> DataFrame:
    """A feed that brings an excerpt of the file; a missing one leaves the file to be read."""
    has = filled(excerpt)
    return normalized(rows, regulator_code=F.lit(code), source_id=F.col("id"), title=F.coalesce(title, F.lit("")), source_url=F.coalesce(link, F.lit("")), published_date=date, file_url=filled(link), file_extension_hint=F.lit("pdf"), category_hint=hint, raw_text=has, raw_text_source=F.when(has.isNotNull(), "pdf_excerpt"), needs_download=has.isNull(), scraped_at=F.col("scraped_at"))


@adapter("petition-orders")
def _petition_orders(rows: DataFrame) -> DataFrame:
    """id, subject, petition_no, date_order, date_posted, category, pdf_url, pdf_digest, scraped_at."""
    c = F.col
    date = F.coalesce(filled(c("date_order")), filled(c("date_posted")))
    return _excerpted(rows, "petition-orders", F.coalesce(filled(c("subject")), c("petition_no")), iso_or_raw(date, dates.basic), c("pdf_url"), c("category"), c("pdf_digest"))


@adapter("petition-regulations")
def _petition_regulations(rows: DataFrame) -> DataFrame:
    """id, reg_name, noti_pdf_url, pdf_digest, scraped_at; the list has no dates."""
    c = F.col
    return _excerpted(rows, "petition-regulations", c("reg_name"), F.lit(None), c("noti_pdf_url"), F.lit("Regulation"), c("pdf_digest"))


@adapter("tribunal-judgments")
def _judgments(rows: DataFrame) -> DataFrame:
    """id, cause_title, petition_no, date_of_decision, date_uploaded (dd.mm.yyyy), pdf_url, pdf_text, scraped_at."""
    c = F.col
    date = F.coalesce(filled(c("date_of_decision")), filled(c("date_uploaded")))
    return _excerpted(rows, "tribunal-judgments", F.coalesce(filled(c("cause_title")), c("petition_no")), iso_or_raw(date, lambda d: dates.parse(F.trim(d), ["d.M.yyyy"])), c("pdf_url"), F.lit(None), c("pdf_text"))


@adapter("grouped-notices")
def _grouped(rows: DataFrame) -> DataFrame:
    """position, title, pdf_link, source_page, source_section, status, listed_date, scraped_at: one row a document.

    The same notice is listed by several sections under other links; archives win.
    """
    from . import dedup

    c, link = F.col, filled(F.col("pdf_link"))
    feed = rows if "feed" in rows.columns else rows.withColumn("feed", F.lit("notices"))
    best = dedup.representatives(dedup.fuzzy_clusters(feed), ["archive"])
    return normalized(best, regulator_code=F.lit("grouped-notices"), source_id=text.stable_id(c("title"), c("pdf_link"), length=16), title=c("title"), source_url=c("source_page"), file_url=link, file_extension_hint=F.when(link.isNotNull(), "pdf"), category_hint=c("source_section"), status_hint=filled(c("status")), needs_download=link.isNotNull(), scraped_at=c("scraped_at"))


@adapter("multi-body-records")
def _multi_body(rows: DataFrame) -> DataFrame:
    """id, title, url, source, category, published_date, details (map of label to value), listing_url, status, scraped_at.

    An event's date is when it happens, so events have none. A record without a link is complete as its labelled details.
    """
    c, link = F.col, filled(F.col("url"))
    event = F.col("category") == "EVENTS"
    lines = F.array_join(F.transform(F.filter(F.map_entries("details"), lambda e: F.trim(e["value"]) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    block = F.when(link.isNull(), filled(lines))
    return normalized(rows, regulator_code=F.lit("multi-body-records"), source_id=c("id"), title=c("title"), source_url=F.coalesce(link, c("listing_url")), published_date=F.when(~event, filled(c("published_date"))), file_url=link, file_extension_hint=urls.extension(link), category_hint=F.concat_ws("_", "source", "category"), status_hint=filled(c("status")), raw_text=block, raw_text_source=F.when(block.isNotNull(), "html_page"), needs_download=link.isNotNull(), scraped_at=filled(c("scraped_at")))


@adapter("service-circulars")
def _circulars(rows: DataFrame) -> DataFrame:
    """title, file_url, listing_url (a page of a feed), site_category, issued_by, services_path, published_date, scraped_at.

    Pages of a feed shift, so the feed and not the page is the source; title and file name a circular.
    """
    c = F.col
    feed = urls.without_page(c("listing_url"))
    return normalized(rows, regulator_code=F.lit("service-circulars"), source_id=text.stable_id(F.lit("service-circulars"), feed, c("title"), c("file_url")), title=c("title"), source_url=feed, published_date=iso_or_raw(c("published_date"), dates.free), file_url=filled(c("file_url")), file_extension_hint=urls.extension(c("file_url")), category_hint=text.category_hint(c("site_category"), c("issued_by"), c("services_path")), needs_download=filled(c("file_url")).isNotNull(), scraped_at=c("scraped_at"))


@adapter("programme-calls")
def _calls(rows: DataFrame) -> DataFrame:
    """source_id, source_cluster, listing_url, title, file_url, html_url, published_date, status_hint, scraped_at."""
    c = F.col
    target = F.coalesce(filled(c("file_url")), filled(c("html_url")))
    return normalized(rows, regulator_code=F.lit("programme-calls"), source_id=c("source_id"), title=c("title"), source_url=F.coalesce(filled(c("html_url")), c("listing_url")), published_date=c("published_date"), file_url=target, file_extension_hint=urls.extension(target), category_hint=c("source_cluster"), status_hint=c("status_hint"), needs_download=target.isNotNull(), scraped_at=c("scraped_at"))


@adapter("reference-listing")
def _references(rows: DataFrame) -> DataFrame:
    """id, category, short_description, reference_no, last_updated, detail_page, pdf_link, scraped_at."""
    c, link = F.col, filled(F.col("pdf_link"))
    title = F.when(filled(c("reference_no")).isNotNull(), F.concat(c("short_description"), F.lit(" ["), c("reference_no"), F.lit("]"))).otherwise(c("short_description"))
    return normalized(rows, regulator_code=F.lit("reference-listing"), source_id=c("id"), title=title, source_url=F.coalesce(filled(c("detail_page")), link), published_date=iso_or_raw(c("last_updated"), dates.free), file_url=link, file_extension_hint=urls.extension(link), category_hint=c("category"), needs_download=link.isNotNull(), scraped_at=c("scraped_at"))


@adapter("card-listing")
def _card_listing(rows: DataFrame) -> DataFrame:
    """title, is_group, published_date_raw (dd.mm.yyyy), link, listing_url, scraped_at; a group row must be expanded before."""
    from . import dedup

    c = F.col
    rows = dedup.refuse_groups(rows)
    return normalized(rows, regulator_code=F.lit("card-listing"), source_id=text.stable_id(F.lit("card-listing"), c("link"), c("title")), title=c("title"), source_url=c("listing_url"), published_date=iso_or_raw(c("published_date_raw"), dates.basic), file_url=filled(c("link")), file_extension_hint=urls.extension(c("link")), needs_download=filled(c("link")).isNotNull(), scraped_at=c("scraped_at"))


@adapter("category-table")
def _category_table(rows: DataFrame) -> DataFrame:
    """title, category, date, detail_link, file_link, scraped_at."""
    c, link = F.col, filled(F.col("file_link"))
    return normalized(rows, regulator_code=F.lit("category-table"), source_id=text.stable_id(F.lit("category-table"), c("detail_link"), c("title")), title=c("title"), source_url=c("detail_link"), published_date=iso_or_raw(c("date"), dates.free), file_url=link, file_extension_hint=urls.extension(link), category_hint=filled(c("category")), needs_download=link.isNotNull(), scraped_at=c("scraped_at"))


@adapter("faq-listing")
def _faqs(rows: DataFrame) -> DataFrame:
    """faq_id, title_text, published_date, category, url, pdf_link, scraped_at; the page is the text where there is no file."""
    c, link = F.col, filled(F.col("pdf_link"))
    return normalized(rows, regulator_code=F.lit("faq-listing"), source_id=c("faq_id"), title=c("title_text"), source_url=c("url"), published_date=iso_or_raw(c("published_date"), dates.free), file_url=link, file_extension_hint=F.when(link.isNotNull(), "pdf"), category_hint=c("category"), scraped_at=c("scraped_at"))


def active_taxonomy(tag: DataFrame) -> DataFrame:
    return tag.filter("status = 'ACTIVE'").filter(F.col("facet").isin("SUBJECT", "INSTRUMENT_TYPE", "STATUS"))


def missing_facets(tag: DataFrame, regulator: DataFrame) -> DataFrame:
    """Regulators that lack active tags of a facet; ingestion refuses them."""
    wanted = regulator.select("regulator_id", F.explode(F.array(*map(F.lit, ("SUBJECT", "INSTRUMENT_TYPE", "STATUS")))).alias("facet"))
    return wanted.join(active_taxonomy(tag).select("regulator_id", "facet").distinct(), ["regulator_id", "facet"], "left_anti")


def resolve_tags(rows: DataFrame, tag: DataFrame, facet: str, name_col: str, out: str) -> DataFrame:
    """Tag id by exact name within the row's regulator, null when there is none."""
    names = tag.filter(F.col("facet") == facet).groupBy("regulator_id", F.col("name").alias(name_col)).agg(F.min("tag_id").alias(out))
    return rows.join(names, ["regulator_id", name_col], "left")


def hinted_name(hint: Column, label: Column, hints: dict[str, str] | None = None) -> Column:
    """The status name to look up: a recognised hint's, else the label. A recognised hint never falls back."""
    table = F.create_map(*(F.lit(x) for pair in (HINTS if hints is None else hints).items() for x in pair))
    return F.coalesce(F.element_at(table, hint), label)


def status_reason(tag_id: Column, applies_to: Column, subject_id: Column) -> Column:
    """no_match without a tag; scope_mismatch when the tag's scope lacks the subject (the tag is still returned); else ok."""
    scoped = subject_id.isNotNull() & (F.coalesce(F.size(applies_to), F.lit(0)) > 0) & ~F.array_contains(applies_to, subject_id)
    return F.when(tag_id.isNull(), "no_match").when(scoped, "scope_mismatch").otherwise("ok")


def resolve_status(rows: DataFrame, status_tags: DataFrame) -> DataFrame:
    """Rows with status_id and status_reason; status_tags: regulator_id, name, tag_id, applies_to."""
    named = rows.withColumn("_name", hinted_name(F.col("status_hint"), F.col("status_label")))
    tags = status_tags.select("regulator_id", F.col("name").alias("_name"), F.col("tag_id").alias("status_id"), "applies_to")
    out = named.join(tags, ["regulator_id", "_name"], "left").withColumn("status_reason", status_reason(F.col("status_id"), F.col("applies_to"), F.col("subject_id")))
    return out.drop("_name", "applies_to")


def review_reasons(confidence: Column, subject_id: Column, instrument_id: Column, reason: Column, failed: Column, unparseable: Column, accept: float = ACCEPT) -> Column:
    """Reasons in fixed order; an entry needs review when there is any."""
    flags = [
        (confidence < accept, "low_confidence"),
        (subject_id.isNull(), "model_returned_invalid_subject_tag"),
        (instrument_id.isNull(), "model_returned_invalid_instrument_tag"),
        (reason == "no_match", "model_returned_invalid_status_tag"),
        (reason == "scope_mismatch", "status_subject_scope_mismatch"),
        (failed, "text_extraction_failed"),
        (unparseable, "unparseable_published_date"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in flags)))


def published(raw: Column) -> tuple[Column, Column]:
    """Date of the raw text, and whether there was text that does not read as one."""
    t = F.trim(raw)
    d = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-M-d"))
    return d, raw.isNotNull() & (raw != "") & d.isNull()


def document_codes(rows: DataFrame, existing: DataFrame, asof: str, position: list[str]) -> DataFrame:
    """document_code REG-SUBJ-INST-YEAR-SEQ, numbered on from the largest existing code of each prefix.

    rows: code, subject_code, instrument_code, published_date. A prefix is one regulator, subject, type and year, so
    its window is small. The year of an undated row is asof's.
    """
    year = F.coalesce(F.year("published_date"), F.year(F.lit(asof).cast("date")))
    out = rows.withColumn("prefix", F.concat_ws("-", "code", F.coalesce("subject_code", F.lit("UNK")), F.coalesce("instrument_code", F.lit("UNK")), year))
    parts = existing.select(F.regexp_extract("document_code", r"^(.*)-(\d+)$", 1).alias("prefix"), F.regexp_extract("document_code", r"^(.*)-(\d+)$", 2).try_cast("long").alias("n"))
    largest = parts.groupBy("prefix").agg(F.max("n").alias("_last"))
    out = out.withColumn("_seq", F.row_number().over(Window.partitionBy("prefix").orderBy(*position))).join(largest, "prefix", "left")
    seq = (F.col("_seq") + F.coalesce("_last", F.lit(0))).cast("string")
    return out.withColumn("document_code", F.concat_ws("-", "prefix", F.when(F.length(seq) < 3, F.lpad(seq, 3, "0")).otherwise(seq))).drop("_seq", "_last", "prefix")


def chosen_text(rows: DataFrame, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """text, text_source, extraction_failed: a failed flag first, then raw text, then what ``extract`` reads from the file."""
    read = F.lit(None).cast("string") if extract is None else extract(F.col("file_url"))
    wants = F.coalesce("needs_download", F.lit(True)) & (F.coalesce("file_url", F.lit("")) != "")
    failed, raw = F.coalesce("extraction_failed", F.lit(False)), F.coalesce("raw_text", F.lit("")) != ""
    out = rows.withColumn("_read", F.when(~failed & ~raw & wants, F.trim(read)))
    got = F.coalesce("_read", F.lit("")) != ""
    out = out.withColumn("text", F.when(failed, None).when(raw, F.col("raw_text")).when(got, F.col("_read")))
    out = out.withColumn("text_source", F.when(failed, None).when(raw, F.col("raw_text_source")).when(got, "pdf_full"))
    return out.withColumn("extraction_failed", failed | (~raw & wants & ~got)).drop("_read")


def route(direct: Column, ocr: Column, least_direct: int = 200, least_ocr: int = 100) -> Column:
    """Where a text comes from: direct, ocr or failed."""
    return F.when(F.length(F.trim(direct)) >= least_direct, "direct").when(F.length(F.trim(ocr)) >= least_ocr, "ocr").otherwise("failed")


def classified(rows: DataFrame, classify: Callable | None = None) -> DataFrame:
    """Rows with a model's JSON in ``raw``; by default a rule: the document type of the title, confidence 0.5."""
    if classify is not None:
        return classify(rows)
    return rows.withColumn("raw", F.to_json(F.struct(F.lit(True).alias("keep"), text.document_type(F.col("title")).alias("instrument_type"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("status"), F.lit(0.5).alias("confidence"), F.lit(False).alias("needs_review"))))


MODEL = "keep boolean, subject string, instrument_type string, status string, confidence double, needs_review boolean, rationale string"


def validated(rows: DataFrame, vocabulary: dict[str, list[str]], raw: str = "raw") -> DataFrame:
    """A model's JSON checked: fields outside the vocabulary become null with a reason; confidence over 1 counts as percent.

    Text around the JSON is cut away; what still does not read is a failure of its own.
    """
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), MODEL)
    out = rows.withColumn("_m", parsed)
    bad = F.col("_m").isNull() | F.col("_m.keep").isNull()
    fields, reasons = {}, [F.when(bad, F.lit("unreadable_model_output"))]
    for name, allowed in vocabulary.items():
        v = F.col(f"_m.{name}")
        fields[name] = F.when(v.isin(allowed), v)
        reasons += [F.when(~bad & v.isNull(), F.lit(f"missing_{name}")), F.when(v.isNotNull() & ~v.isin(allowed), F.lit(f"out_of_vocabulary_{name}"))]
    reasons.append(F.when(F.col("_m.needs_review"), F.lit("model_flag")))
    c = F.col("_m.confidence")
    out = out.withColumns(fields).withColumn("confidence", F.when(c > 1, c / 100).otherwise(c)).withColumn("keep", F.coalesce("_m.keep", F.lit(True)))
    return out.withColumn("review_reasons", F.array_compact(F.array(*reasons))).withColumn("needs_review", F.size("review_reasons") > 0).drop("_m")


def outcome(known: Column, error: Column) -> Column:
    return F.when(known, "skipped_duplicate").when(error.isNotNull(), "error").otherwise("ingested")


def fresh(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known, first of each key within the batch decided by the caller's order."""
    return rows.join(known.select(*keys), keys, "left_anti")


def prompt_tags(tag: DataFrame) -> DataFrame:
    """JSON list of names and meanings by regulator and facet, for a model's prompt; taxonomies are small."""
    return tag.groupBy("regulator_id", "facet").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("name").alias("value"), F.coalesce("definition", F.lit("")).alias("meaning"))))).alias("tags"))


def prompt_status_groups(tag: DataFrame) -> DataFrame:
    """Status tags grouped by the set of subjects that they apply to."""
    scope = F.array_join(F.array_sort(F.coalesce("applies_to", F.array().cast("array<string>"))), "|")
    return tag.filter("facet = 'STATUS'").groupBy("regulator_id", scope.alias("scope")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("name").alias("value"), F.coalesce("definition", F.lit("")).alias("meaning"))))).alias("tags"))
