"""URL and file expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File endings that a browser opens as a document, addresses of PDF files and of flipbooks, hosts of bodies.
DOCUMENT = r"(?i)\.(pdf|xlsx|xls|csv|docx?|pptx?)(\?.*)?$"
PDF = r"(?i)\.pdf(\?.*)?$"
FLIPBOOK = r"(?i)/flipbook/\d+"
HOSTS = {"www.isro.gov.in": "ISRO", "isro.gov.in": "ISRO", "www.inspace.gov.in": "IN-SPACe", "inspace.gov.in": "IN-SPACe", "www.nsilindia.co.in": "NSIL", "nsilindia.co.in": "NSIL", "www.dos.gov.in": "DOS", "dos.gov.in": "DOS"}


def file_kind(url: Column) -> Column:
    return F.when(url.isNull() | (url == ""), "none").when(url.rlike(DOCUMENT), "direct-file").when(url.rlike(FLIPBOOK), "flipbook").otherwise("external-reference")


def is_pdf(url: Column) -> Column:
    return F.coalesce(url.rlike(PDF), F.lit(False))


def extension(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, DOCUMENT, 1))
    return F.when(found != "", found)


def extension_hint(url: Column) -> Column:
    """Any ending of one to five characters in the last path segment."""
    last = F.element_at(F.split(url, "/"), -1)
    found = F.lower(F.regexp_extract(last, r"\.([^.?]{1,5})(\?.*)?$", 1))
    return F.when(found != "", found)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def issuing_entity(url: Column, hosts: dict[str, str] | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for pair in (HOSTS if hosts is None else hosts).items() for x in pair))
    return F.element_at(table, host(url))


def without_page(url: Column) -> Column:
    return F.regexp_replace(url, r"\?page=\d+$", "")


def canonical(url: Column, front: str = "/index.php/") -> Column:
    """No front-controller segment, no query, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.replace(url, F.lit(front), F.lit("/")), r"[?#].*$", ""), "/+$", "")


@F.pandas_udf(T.StringType())
def absolute(base, href):
    """href against base."""
    import pandas as pd
    from urllib.parse import urljoin

    return pd.Series([urljoin(b or "", h) if h is not None else None for b, h in zip(base, href)])


def filename(url: Column) -> Column:
    """The name parameter where it looks like a file, else the last path segment."""
    name = F.try_parse_url(url, F.lit("QUERY"), F.lit("name"))
    last = F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1)
    return F.try_url_decode(F.when(name.rlike(DOCUMENT), name).when(last != "", last).otherwise(F.lit("document.pdf")))


def page_url(base: str, slug: Column, page: Column) -> Column:
    """Listing page whose real address travels as base64 in a url parameter."""
    target = F.concat(F.lit(f"{base}/"), slug, F.lit("/cpppdata?page="), page.cast("string"))
    return F.concat(F.lit(f"{base}/"), slug, F.lit("/cpppdata?url="), F.rtrim(F.base64(target.cast("binary")), F.lit("=")))


def page_of(url: Column) -> Column:
    """Page number inside such an address."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit("url"))
    padded = F.rpad(raw, ((F.length(raw) + 3) / 4).cast("int") * 4, "=")
    return F.regexp_extract(F.unbase64(padded).cast("string"), r"page=(\d+)", 1).try_cast("int")


def status_tone(name: Column) -> Column:
    return F.when(name.startswith("In Force") | name.startswith("Open"), "positive").when(name.startswith("Draft"), "draft").otherwise("neutral")


def first_link(file: Column, flipbook: Column, external: Column) -> Column:
    """Struct of url and kind: the file's link before the flipbook's before an external one."""
    blank = lambda c: F.when(c != "", c)
    f, b, e = map(blank, (file, flipbook, external))
    return F.struct(F.coalesce(f, b, e).alias("url"), F.when(f.isNotNull(), "file").when(b.isNotNull(), "flipbook").when(e.isNotNull(), "external").otherwise("none").alias("kind"))
