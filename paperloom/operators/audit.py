"""Checks and distributions after a load, taxonomy findings, store statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overview import share, tag_usage


def zero():
    return F.lit(0).cast("long")


def totals(entry: DataFrame) -> DataFrame:
    """Distinct documents, entries and flagged entries in one pass."""
    return entry.agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("entries"), F.count(F.when(F.col("needs_review"), 1)).alias("flagged"))


def table_sizes(**tables: DataFrame) -> DataFrame:
    """One row a table with its count: scalar subqueries without a join."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def shared_across(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys in more than one group, with the sorted distinct groups as text."""
    pairs = rows.select(key, group).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(group)), ",").alias("groups")).filter("n > 1")


def reason_counts(entry: DataFrame) -> DataFrame:
    return entry.filter("needs_review OR size(review_reasons) > 0").select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, column: str, missing: str = "(untagged)") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("label")).agg(F.count("*").alias("n"))


def tag_distribution(entry: DataFrame, tag: DataFrame) -> DataFrame:
    """Entries by subject name, untagged included; ids are counted before names join."""
    counts = entry.groupBy("subject_id").agg(F.count("*").alias("n"))
    rows = counts.join(tag.filter("facet = 'SUBJECT'").select(F.col("tag_id").alias("subject_id"), "name"), "subject_id", "left")
    return rows.groupBy(F.coalesce("name", F.lit("(untagged)")).alias("label")).agg(F.sum("n").alias("n"))


def latest(entry: DataFrame, document: DataFrame, n: int) -> DataFrame:
    return entry.join(document, "document_id").orderBy(F.desc_nulls_last("published_date"), F.asc("entry_id")).limit(n).select("entry_id", "published_date", "status")


def lowest_confidence(entry: DataFrame, n: int) -> DataFrame:
    """Entries of least confidence, null as 1."""
    c = F.coalesce("confidence", F.lit(1.0))
    return entry.orderBy(c, "entry_id").limit(n).select("entry_id", c.alias("confidence"))


def usage_per_tag(tag: DataFrame, entry: DataFrame) -> DataFrame:
    """Every tag with its uses over both key columns, zeros included."""
    return tag.join(tag_usage(entry), ["facet", "tag_id"], "left").select("facet", "tag_id", F.coalesce("total", zero()).alias("n"))


def coverage(tag: DataFrame, entry: DataFrame) -> DataFrame:
    """Per facet: tags, fired, never fired, percent fired, mean confidence of the uses."""
    rows = tag.join(tag_usage(entry), ["facet", "tag_id"], "left")
    out = rows.groupBy("facet").agg(F.count("*").alias("tags"), F.count("total").alias("fired"), F.sum("confidence").alias("c"), F.sum("total").alias("t"))
    return out.select("facet", "tags", "fired", (F.col("tags") - F.col("fired")).alias("never"), share(F.col("fired"), F.col("tags")).alias("fired_pct"), F.round(F.col("c") / F.col("t"), 4).alias("mean_confidence"))


def crosstab(rows: DataFrame, hint: str, assigned: str) -> DataFrame:
    """Long cross-tab with each hint's total."""
    out = rows.groupBy(F.col(hint).alias("hint"), F.coalesce(assigned, F.lit("(none)")).alias("assigned")).agg(F.count("*").alias("n"))
    return out.withColumn("hint_total", F.sum("n").over(Window.partitionBy("hint")))


def shared_names(tag: DataFrame, regulator: DataFrame) -> DataFrame:
    """Tag names that two or more regulators use, with the regulators."""
    rows = tag.join(regulator.select("regulator_id", "code"), "regulator_id").select("facet", "name", "code").distinct()
    return rows.groupBy("facet", "name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("code")), ",").alias("codes")).filter("n >= 2")


def mixed_concepts(tag: DataFrame) -> DataFrame:
    """Concepts whose members have more than one name."""
    return tag.filter("concept IS NOT NULL").groupBy("concept").agg(F.countDistinct("name").alias("names"), F.count("*").alias("members")).filter("names > 1")


def drift(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of one mapping that the other lacks, both ways."""
    cols = declared.columns
    return declared.exceptAll(stored.select(*cols)).withColumn("side", F.lit("declared")).union(stored.select(*cols).exceptAll(declared).withColumn("side", F.lit("stored")))


def versions(rows: DataFrame, version: str = "version_added") -> DataFrame:
    return rows.groupBy("regulator_id", F.coalesce(version, F.lit("(unversioned)")).alias("version")).agg(F.count("*").alias("n"))


def concept_share(tag: DataFrame) -> DataFrame:
    """Per facet: tags, mapped to a concept, percent."""
    out = tag.groupBy("facet").agg(F.count("*").alias("tags"), F.count("concept").alias("mapped"))
    return out.withColumn("mapped_pct", share(F.col("mapped"), F.col("tags")))


def new_since(document: DataFrame, regulator: DataFrame, since: Column) -> DataFrame:
    """Documents first ingested at a time or later, per regulator."""
    rows = document.filter(F.col("first_ingested") >= since)
    return rows.groupBy("regulator_id").agg(F.count("*").alias("n")).join(regulator, "regulator_id").select("code", "n")


def run_summary(rows: DataFrame, group: str, needs_download: Column, has_file: Column) -> DataFrame:
    """Rows of each group, and how many need a download or have no file."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(needs_download).alias("needs_download"), F.count_if(~F.coalesce(has_file, F.lit(False))).alias("no_file"))


def dominant(rows: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """Groups of ``least`` rows or more in which one value holds over half."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    out = counts.groupBy(group).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return out.filter((F.col("total") >= least) & (F.col("most") * 2 > F.col("total")))


def store_stats(store: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, label, n of kept rows for each column, and kept, dropped, flagged and both flag percentages; one scan.

    flag_pct_of_kept divides all flagged rows by kept rows; flag_pct_of_all by all rows.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("label")) for c in columns), F.struct(F.lit("*").alias("dimension"), F.lit("*").alias("label"))))
    rows = store.select("kept", "needs_review", pairs.alias("p")).select("p.*", "kept", "needs_review")
    out = rows.groupBy("dimension", "label").agg(F.count(F.when(F.col("kept"), 1)).alias("n"), F.count(F.when(~F.col("kept"), 1)).alias("dropped"), F.count(F.when(F.col("needs_review"), 1)).alias("flagged"))
    return out.select("dimension", "label", "n", "dropped", "flagged", share(F.col("flagged"), F.col("n")).alias("flag_pct_of_kept"), share(F.col("flagged"), F.col("n") + F.col("dropped")).alias("flag_pct_of_all"))


def facet_pivot(tag: DataFrame, regulator: DataFrame, facets: list[str]) -> DataFrame:
    """Active tags by regulator, one column a facet; the facets are given, so no extra pass looks for them."""
    rows = tag.filter("status = 'ACTIVE'").groupBy("regulator_id").pivot("facet", facets).count().na.fill(0)
    return rows.join(regulator.select("regulator_id", "code"), "regulator_id").select("code", *[F.col(f).alias(f.lower()) for f in facets])


def tone_cycle(rows: DataFrame, name: str, position: str, tones: int = 12) -> DataFrame:
    """Names with a colour number by order of first appearance; names are a dimension."""
    first = rows.groupBy(name).agg(F.min(position).alias("first"))
    return first.select(name, ((F.dense_rank().over(Window.orderBy("first", name)) - 1) % tones).alias("tone"))


def roles(entry: DataFrame, tag: DataFrame) -> DataFrame:
    """Entries with the names of their subject and instrument: one dimension in two roles."""
    names = tag.select("tag_id", "name")
    s = names.select(F.col("tag_id").alias("subject_id"), F.col("name").alias("subject"))
    i = names.select(F.col("tag_id").alias("instrument_id"), F.col("name").alias("instrument"))
    return entry.join(s, "subject_id", "left").join(i, "instrument_id", "left")


def kept_or_dropped(rows: DataFrame, keep, method: str = "dropped_by_prefilter") -> DataFrame:
    """Rows with ``kept`` and the method that dropped them; none is removed."""
    return rows.withColumn("kept", keep).withColumn("method", F.when(~keep, method))
