"""Counts by regulator, domain and tag.

Facts are counted by key before dimensions join, so joins carry one row a key. Tags join entries on one key after an
unpivot, never on an OR or CASE of two keys, which Spark could only run as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries_by_regulator(entry: DataFrame, document: DataFrame) -> DataFrame:
    """regulator_id, total, published, flagged over entries."""
    per_document = entry.groupBy("document_id").agg(F.count("*").alias("total"), F.count(F.when(~F.col("needs_review"), 1)).alias("published"))
    rows = per_document.join(document.select("document_id", "regulator_id"), "document_id")
    out = rows.groupBy("regulator_id").agg(F.sum("total").alias("total"), F.sum("published").alias("published"))
    return out.withColumn("flagged", F.col("total") - F.col("published"))


def counts_by_regulator(entry: DataFrame, document: DataFrame, regulator: DataFrame, flagged: bool) -> DataFrame:
    """code, n of flagged or published entries; regulators without any are left out."""
    n = F.col("flagged" if flagged else "published")
    return entries_by_regulator(entry, document).filter(n > 0).join(regulator, "regulator_id").select("code", n.alias("n")).orderBy("code")


def domain_overview(domain: DataFrame, regulator: DataFrame, document: DataFrame, entry: DataFrame) -> DataFrame:
    """Every regulator of every domain with its published count, zeros included."""
    counts = entries_by_regulator(entry, document).select("regulator_id", "published", "total")
    rows = domain.join(regulator, "domain_id").join(counts, "regulator_id", "left")
    return rows.select("domain_id", "domain_name", "code", F.coalesce("published", F.lit(0).cast("long")).alias("published"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def nested_by(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of each key as a sorted list of structs; for dimensions and counts, whose groups are small."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def tag_usage(entry: DataFrame) -> DataFrame:
    """facet, tag_id, total, published, confidence sum: entries unpivoted to their tags."""
    both = F.array(F.struct(F.lit("SUBJECT").alias("facet"), F.col("subject_id").alias("tag_id")), F.struct(F.lit("INSTRUMENT_TYPE").alias("facet"), F.col("instrument_id").alias("tag_id")))
    rows = entry.select(F.explode(both).alias("t"), "needs_review", "confidence").select("t.*", "needs_review", "confidence").filter("tag_id IS NOT NULL")
    return rows.groupBy("facet", "tag_id").agg(F.count("*").alias("total"), F.count(F.when(~F.col("needs_review"), 1)).alias("published"), F.sum("confidence").alias("confidence"))


def _with_usage(tag: DataFrame, entry: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return tag.join(tag_usage(entry), ["facet", "tag_id"], "left").withColumns({"total": F.coalesce("total", zero), "published": F.coalesce("published", zero)})


def regulator_tags(tag: DataFrame, entry: DataFrame, regulator_id: int) -> DataFrame:
    """Tags of one regulator with published counts, ordered by all entries, then name."""
    rows = _with_usage(tag.filter(F.col("regulator_id") == regulator_id), entry)
    return rows.select("facet", "tag_id", "name", "published", "total").orderBy(F.desc("total"), "name", "tag_id")


def tags_by_facet(tag: DataFrame, entry: DataFrame, regulator: DataFrame, facet: str) -> DataFrame:
    rows = _with_usage(tag.filter(F.col("facet") == facet), entry.withColumn("subject_id" if facet != "SUBJECT" else "instrument_id", F.lit(None).cast("string")))
    return rows.join(regulator.select("regulator_id", "code"), "regulator_id").select("code", "tag_id", "name", "published", "total").orderBy("code", F.desc("total"), "name", "tag_id")


def published_and_flagged(entry: DataFrame, document: DataFrame, regulator_id: int) -> DataFrame:
    """One row with both counts, zeros when there is nothing."""
    rows = entry.join(document.filter(F.col("regulator_id") == regulator_id).select("document_id"), "document_id", "left_semi")
    return rows.agg(F.count(F.when(~F.col("needs_review"), 1)).alias("published"), F.count(F.when(F.col("needs_review"), 1)).alias("flagged"))


def siblings(regulator: DataFrame, document: DataFrame, entry: DataFrame) -> DataFrame:
    """Pairs of regulators of one domain, without self, with the sibling's published count."""
    counts = entries_by_regulator(entry, document)
    a = regulator.select(F.col("code"), "domain_id", F.col("regulator_id").alias("own"))
    b = regulator.join(counts, "regulator_id", "left").select(F.col("code").alias("sibling"), "domain_id", "regulator_id", F.coalesce("published", F.lit(0).cast("long")).alias("published"))
    return a.join(b, "domain_id").filter("own <> regulator_id").select("code", "sibling", "published")


def totals(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of counts that are already grouped."""
    return counted.groupBy(*keys).agg(F.sum(value).alias(value)) if keys else counted.agg(F.sum(value).alias(value))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage in doubles, 0 where there is nothing."""
    return F.when(whole > 0, F.round(part.cast("double") * 100.0 / whole.cast("double"), digits)).otherwise(F.lit(0.0))
