"""Declared schemas and enum checks; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """Schema of 'name kind, ...' text; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.strip().split(" ") for f in text.split(","))])


#: The record that every source is normalised to. published_date stays text until ingestion, so that what does not parse can be flagged.
NORMALIZED = _struct(
    "regulator_code string, source_id string, title string, source_url string, published_date string, file_url string, "
    "file_extension_hint string, category_hint string, status_hint string, raw_text string, raw_text_source string, "
    "needs_download boolean, scraped_at string, extraction_failed boolean"
)
DOMAIN = _struct("domain_id int, name string, description string")
REGULATOR = _struct("regulator_id int, code string, name string, domain_id int, website_url string")
TAG = _struct("tag_id string, regulator_id int, facet string, name string, short_code string, definition string, parent_id string, status string, version_added string, applies_to array<string>, concept_id string")
CONCEPT = _struct("concept_id string, facet string, name string, definition string, notes string")
DOCUMENT = _struct("document_id string, regulator_id int, source_id string, title string, source_url string, file_url string, published_date date, discovered_at timestamp, first_ingested_at timestamp, is_digest boolean")
ENTRY = _struct(
    "entry_id string, document_code string, document_id string, subject_id string, instrument_id string, status_id string, "
    "subject_confidence double, instrument_confidence double, status_confidence double, needs_review boolean, needs_split boolean, review_reasons array<string>"
)
RELATIONSHIP = _struct("from_id string, to_id string, type string, target_hint string, resolved boolean")
ENTRY_TAG = _struct("entry_id string, tag_id string")
REGISTRATION = _struct("code string, adapter string, markers array<string>, has_detection boolean, timeout_ms long, skip_scheduled string")
RUN = _struct("run_id string, started_at timestamp, finished_at timestamp, trigger string")
RUN_REGULATOR = _struct("run_id string, regulator_id int, status string, found long, known long, ingested long, flagged long, failed long, detail string, duration_ms long")
STORE = _struct("id string, title string, url string, source_feed string, date string, subject string, instrument_type string, status string, confidence double, method string, needs_review boolean, review_reasons string, kept boolean, etag string, last_modified string")
CHANGE = _struct("document_id string, field_changed string, old_value string, new_value string, changed_at timestamp")

ENUMS = {
    "facet": ["SUBJECT", "INSTRUMENT_TYPE", "STATUS", "APPLICABILITY", "LICENSE_AUTHORISATION_TYPE"],
    "tag_status": ["ACTIVE", "DEPRECATED", "PROPOSED"],
    "relationship": ["AMENDS", "SUPERSEDES", "EXTENDS_TIMELINE"],
    "sync_status": ["SUCCESS", "PARTIAL", "BLOCKED", "ERROR", "SKIPPED"],
    "raw_text_source": ["html_page", "pdf_full", "pdf_excerpt"],
}


def enum_violations(df: DataFrame, column: str, enum: str) -> DataFrame:
    """Rows whose value is not one of the enum's; nulls pass."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(ENUMS[enum]))
