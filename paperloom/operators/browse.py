"""Faceted browsing: visibility, filters, stable order and paging."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 25


def to_list(value) -> list[str]:
    """None, one value or many as a list of trimmed, non-blank texts."""
    if value is None:
        return []
    many = value if isinstance(value, (list, tuple, set)) else [value]
    return [str(v).strip() for v in many if str(v).strip()]


@dataclass
class Filters:
    regulator: str | list[str] | None = None
    domain: str | list[str] | None = None
    subject: str | list[str] | None = None
    instrument: str | list[str] | None = None
    status: str | list[str] | None = None
    date_from: str | None = None
    date_to: str | None = None
    search: str | None = None
    sort: str = "newest"
    page: int = 1
    size: int = field(default=PAGE_SIZE)


def one_of(column: Column, values: list[str]) -> Column:
    return column == values[0] if len(values) == 1 else column.isin(values)


def _day(text: str | None):
    """A bound as a date, None where it does not read; bounds are inclusive days in UTC."""
    import datetime

    try:
        return datetime.date.fromisoformat((text or "").strip()[:10])
    except ValueError:
        return None


def within(d: Column, date_from: str | None, date_to: str | None) -> Column:
    """Inclusive range; nulls never match once a bound is given; unreadable bounds are ignored."""
    out = F.lit(True)
    if low := _day(date_from):
        out = out & (d >= F.lit(low))
    if high := _day(date_to):
        out = out & (d <= F.lit(high))
    return out if not (low or high) else out & d.isNotNull()


def last_days(d: Column, asof: str, days: int) -> Column:
    """The preset of the last days up to asof, which is always given."""
    day = F.lit(asof).cast("date")
    return d.between(F.date_sub(day, days), day)


def title_contains(title: Column, text: str) -> Column:
    return F.contains(F.lower(title), F.lit(text.strip().lower()))


def predicate(f: Filters) -> Column:
    """Conjunction over columns code, domain_id, subject_id, instrument_id, status, published_date, title. Regulators beat domains."""
    out = F.lit(True)
    if regs := to_list(f.regulator):
        out = out & one_of(F.col("code"), regs)
    elif domains := to_list(f.domain):
        out = out & one_of(F.col("domain_id").cast("string"), domains)
    for name in ("subject", "instrument"):
        if values := to_list(getattr(f, name)):
            out = out & one_of(F.col(f"{name}_id"), values)
    if values := to_list(f.status):
        out = out & one_of(F.col("status"), values)
    out = out & within(F.col("published_date"), f.date_from, f.date_to)
    if f.search and f.search.strip():
        out = out & title_contains(F.col("title"), f.search)
    return out


def order(sort: str) -> list[Column]:
    """Sort keys, always ended by the entry id."""
    date, made, key = F.col("published_date"), F.col("created"), F.col("entry_id")
    return {
        "oldest": [date.asc_nulls_last(), made.asc(), key.asc()],
        "title": [F.col("title").asc(), key.asc()],
        "regulator": [F.col("code").asc(), date.desc_nulls_last(), key.asc()],
    }.get(sort, [date.desc_nulls_last(), made.desc(), key.asc()])


def joined(entry: DataFrame, document: DataFrame, regulator: DataFrame, title: DataFrame | None = None) -> DataFrame:
    """Entries with their document and regulator; titles only where asked for."""
    rows = entry.join(document, "document_id").join(regulator, "regulator_id")
    return rows if title is None else rows.join(title, "part_key")


def public(rows: DataFrame) -> DataFrame:
    """Rows that readers may see. Callers cannot turn this off."""
    return rows.filter(~F.col("needs_review"))


def review_queue(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("needs_review"))


def page(rows: DataFrame, f: Filters) -> DataFrame:
    """One page in a total order: a top-k of offset + size rows, not a full sort."""
    n = max(1, f.page)
    return rows.filter(predicate(f)).orderBy(*order(f.sort)).offset((n - 1) * f.size).limit(f.size)


def page_count(rows: DataFrame, f: Filters) -> DataFrame:
    """total, page, page_count (at least 1)."""
    return rows.filter(predicate(f)).agg(F.count("*").alias("total")).select("total", F.lit(max(1, f.page)).alias("page"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / f.size)).alias("page_count"))


def numbered(rows: DataFrame, f: Filters) -> DataFrame:
    """All rows with their page number, for exports by one regulator at a time (the window is per regulator)."""
    w = Window.partitionBy("code").orderBy(*order(f.sort))
    return rows.filter(predicate(f)).withColumn("page", F.ceil(F.row_number().over(w) / f.size))


def detail(rows: DataFrame, entry_id: str, require_public: bool) -> DataFrame:
    """One entry; nothing when it is flagged and the reader is not a reviewer."""
    found = rows.filter(F.col("entry_id") == entry_id)
    return public(found) if require_public else found


def nested(rows: DataFrame, tag: DataFrame) -> DataFrame:
    """Entries with their tags as structs; two passes over one dimension, each by its own key."""
    t = tag.select("tag_id", F.struct("tag_id", "name").alias("t"))
    s, i = t.select(F.col("tag_id").alias("subject_id"), F.col("t").alias("subject")), t.select(F.col("tag_id").alias("instrument_id"), F.col("t").alias("instrument"))
    return rows.join(s, "subject_id", "left").join(i, "instrument_id", "left")


def tag_options(tag: DataFrame, regulator: str | list[int] | None = None, include_inactive: bool = False) -> DataFrame:
    """Subject and instrument tags, active only unless asked, by regulator and by name in the order of a locale."""
    rows = tag.filter(F.col("facet").isin("SUBJECT", "INSTRUMENT_TYPE"))
    if not include_inactive:
        rows = rows.filter(F.col("status") == "ACTIVE")
    if regulator is not None:
        rows = rows.filter(F.col("regulator_id").isin([int(r) for r in to_list(regulator)]))
    return rows.select("facet", "regulator_id", "name", "tag_id").orderBy("facet", "regulator_id", F.collate("name", "UNICODE"), "tag_id")


def tag_page(rows: DataFrame, tag: DataFrame, tag_id: str, facet: str) -> DataFrame:
    """Public entries of one tag within its regulator; nothing when the tag has another facet."""
    one = tag.filter((F.col("tag_id") == tag_id) & (F.col("facet") == facet)).select("tag_id", "regulator_id")
    key = "subject_id" if facet == "SUBJECT" else "instrument_id"
    return public(rows).join(one.withColumnRenamed("tag_id", key), [key, "regulator_id"])


def pages(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(total / size))


def narrowed(domain: DataFrame, regulator: DataFrame, tag: DataFrame, domains: list[str] | None = None, regulators: list[str] | None = None) -> DataFrame:
    """Tags that stay selectable once domains and regulators are chosen."""
    regs = regulator
    if wanted := to_list(domains):
        regs = regs.join(domain.filter(F.col("domain_id").cast("string").isin(wanted)).select("domain_id"), "domain_id", "left_semi")
    if wanted := to_list(regulators):
        regs = regs.filter(F.col("code").isin(wanted))
    return tag.join(regs.select("regulator_id"), "regulator_id", "left_semi")
