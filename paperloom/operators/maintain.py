"""Maintenance passes: each takes a snapshot and returns the next one, or a report; running one twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one's values first where they are given; keys are unique on each side."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest]), new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest])


def orphans(child: DataFrame, parent_name: str, name: str) -> DataFrame:
    """Children whose parent is not among the names; a hierarchy with any is refused."""
    return child.filter(F.col(parent_name).isNotNull()).join(child.select(F.col(name).alias(parent_name)).distinct(), parent_name, "left_anti")


def remap(scraped: DataFrame, stored: DataFrame, normal: Column) -> DataFrame:
    """source_id, outcome, stored_id of scraped rows that are not stored: new, ambiguous or remap (one title on each side)."""
    s = stored.withColumn("_t", normal).groupBy("_t").agg(F.count("*").alias("_ns"), F.min("source_id").alias("stored_id"))
    n = scraped.withColumn("_t", normal).groupBy("_t").agg(F.count("*").alias("_nn"))
    rows = scraped.join(stored.select("source_id"), "source_id", "left_anti").withColumn("_t", normal).join(n, "_t").join(s, "_t", "left")
    outcome = F.when(F.col("_ns").isNull(), "new").when((F.col("_ns") > 1) | (F.col("_nn") > 1), "ambiguous").otherwise("remap")
    return rows.select("source_id", outcome.alias("outcome"), F.when(outcome == "remap", F.col("stored_id")).alias("stored_id"))


def backfill(rows: DataFrame, mapping: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A column's nulls filled from a mapping of the keys."""
    return rows.join(mapping.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


# The forms of an authorisation's number and of an amendment's name.
AUTHORISATION = r"(?i)PMA/IN-SPAC\w*/AUTH/(\d{4})/(\d+)([A-Z])?"
AMENDMENT = r"(?i)amendment\s*no\.?\s*\d+"


def amendment_targets(rows: DataFrame, pattern: str = AUTHORISATION, phrase: str = AMENDMENT, position: str = "position") -> DataFrame:
    """base number, base row and outcome for every amendment: updated, already, skipped or not_found.

    rows: entry_id, title, status, position. A base has no letter after its number; the last one of a number counts.
    """
    g = lambda i: F.regexp_extract("title", pattern, i)
    numbered = rows.withColumn("_y", g(1)).withColumn("_n", g(2)).withColumn("_l", g(3)).filter("_y <> ''").withColumn("number", F.concat_ws("/", "_y", "_n"))
    last = F.max(F.struct(position, F.col("entry_id").alias("base_id"), F.col("status").alias("base_status")))
    bases = numbered.filter("_l = ''").groupBy("number").agg(last.alias("b")).select("number", "b.base_id", "b.base_status")
    found = numbered.filter(F.col("title").rlike(phrase)).select("entry_id", "number").join(bases, "number", "left")
    outcome = F.when(F.col("base_id").isNull(), "not_found").when(F.col("base_status") == "Amended", "already").when(F.coalesce("base_status", F.lit("In Force")) != "In Force", "skipped").otherwise("updated")
    return found.withColumn("outcome", outcome)


def amend(rows: DataFrame, **how) -> DataFrame:
    """Rows whose base status became Amended. Never downgrades a status beyond In Force."""
    ids = amendment_targets(rows, **how).filter("outcome = 'updated'").select(F.col("base_id").alias("entry_id")).distinct().withColumn("_a", F.lit(True))
    return rows.join(ids, "entry_id", "left").withColumn("status", F.when(F.col("_a"), "Amended").otherwise(F.col("status"))).drop("_a")


def status_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """entry_id, outcome of each rule (entry_id, title_contains, from_status, to_status): fixed, title_changed, already_changed, not_found."""
    found = rules.join(rows.select("entry_id", "title", "status"), "entry_id", "left")
    outcome = F.when(F.col("title").isNull(), "not_found").when(~F.contains(F.lower("title"), F.lower("title_contains")), "title_changed").when(~F.col("status").eqNullSafe(F.col("from_status")), "already_changed").otherwise("fixed")
    return found.select("entry_id", "to_status", outcome.alias("outcome"))


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    fixes = status_rules(rows, rules).filter("outcome = 'fixed'").select("entry_id", "to_status")
    return rows.join(fixes, "entry_id", "left").withColumn("status", F.coalesce("to_status", "status")).drop("to_status")


def rebuild_dates(rows: DataFrame, raw: DataFrame, key: str = "source_id", asof: Column | None = None) -> DataFrame:
    """Rows with date and basis from their raw text; rows without one say no_raw_row."""
    out = rows.join(raw.select(key, "raw_date"), key, "left").withColumn("_r", dates.rebuild(F.col("raw_date"), F.col("title"), asof))
    return out.withColumn("rebuilt", F.col("_r.date")).withColumn("basis", F.when(F.col("raw_date").isNull(), "no_raw_row").otherwise(F.col("_r.basis"))).drop("_r")


def unshift(ts: Column, reached: Column | None = None) -> Column:
    """Local midnights that were stored as 18:30 UTC of the day before, to the microsecond.

    A true 18:30 looks the same; ``reached`` says which rows the fault can have reached, where that is known.
    """
    shifted = (F.hour(ts) == 18) & (F.minute(ts) == 30) & (F.date_trunc("minute", ts) == ts)
    return F.when(shifted if reached is None else shifted & reached, ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE")).otherwise(ts)


def clear_dates(rows: DataFrame, events: DataFrame, key: str, column: str) -> DataFrame:
    """The column null on rows whose key is listed."""
    marked = rows.join(events.select(key).distinct().withColumn("_e", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("_e").isNull(), F.col(column))).drop("_e")


def review_decisions(decisions: DataFrame, entry: DataFrame, tag: DataFrame) -> DataFrame:
    """entry_id, outcome: accepted, entry_not_found, missing_tag, bad_subject or bad_instrument.

    decisions: entry_id, subject_id, instrument_id, and regulator_id where it is known already; else it is that of the
    entry. Both tags must be given and belong to the regulator and their facet.
    """
    if "regulator_id" not in decisions.columns:
        decisions = decisions.join(entry.select("entry_id", "regulator_id"), "entry_id", "left")
    s = tag.filter("facet = 'SUBJECT'").select(F.col("tag_id").alias("subject_id"), "regulator_id", F.lit(True).alias("_s"))
    i = tag.filter("facet = 'INSTRUMENT_TYPE'").select(F.col("tag_id").alias("instrument_id"), "regulator_id", F.lit(True).alias("_i"))
    rows = decisions.join(s, ["subject_id", "regulator_id"], "left").join(i, ["instrument_id", "regulator_id"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    outcome = F.when(F.col("regulator_id").isNull(), "entry_not_found").when(blank("subject_id") | blank("instrument_id"), "missing_tag").when(F.col("_s").isNull(), "bad_subject").when(F.col("_i").isNull(), "bad_instrument").otherwise("accepted")
    return rows.select("entry_id", "subject_id", "instrument_id", outcome.alias("outcome"))


def apply_decisions(entry: DataFrame, decisions: DataFrame, tag: DataFrame) -> DataFrame:
    """Entries with accepted tags, no flag and no reasons, attributed to the reviewer."""
    ok = review_decisions(decisions, entry, tag).filter("outcome = 'accepted'").select("entry_id", F.col("subject_id").alias("_s"), F.col("instrument_id").alias("_i"))
    rows = entry.join(ok, "entry_id", "left")
    done = F.col("_s").isNotNull()
    return rows.withColumn("subject_id", F.coalesce("_s", "subject_id")).withColumn("instrument_id", F.coalesce("_i", "instrument_id")).withColumn("needs_review", F.col("needs_review") & ~done).withColumn("review_reasons", F.when(done, F.array().cast("array<string>")).otherwise(F.col("review_reasons"))).withColumn("classified_by", F.when(done, "human_review").otherwise("model")).drop("_s", "_i")


def cascade_delete(document: DataFrame, entry: DataFrame, links: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, entries and relationships without the doomed documents; links go in both directions."""
    gone = entry.join(doomed.select("document_id"), "document_id", "left_semi").select("entry_id")
    kept = links.join(gone.withColumnRenamed("entry_id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("entry_id", "to_id"), "to_id", "left_anti")
    return document.join(doomed.select("document_id"), "document_id", "left_anti"), entry.join(gone, "entry_id", "left_anti"), kept


def mapping_violations(mapping: DataFrame, tag: DataFrame) -> DataFrame:
    """Why a concept mapping (concept, regulator_id, facet, name) cannot be loaded: unresolved, in two concepts, one regulator only."""
    keys = ["regulator_id", "facet", "name"]
    unresolved = mapping.join(tag.select(*keys).distinct(), keys, "left_anti").select("concept", F.concat_ws("/", *keys).alias("item"), F.lit("unresolved").alias("why"))
    twice = mapping.groupBy(*keys).agg(F.countDistinct("concept").alias("n"), F.min("concept").alias("concept")).filter("n > 1").select("concept", F.concat_ws("/", *keys).alias("item"), F.lit("two_concepts").alias("why"))
    alone = mapping.groupBy("concept").agg(F.countDistinct("regulator_id").alias("n")).filter("n < 2").select("concept", F.lit("").alias("item"), F.lit("one_regulator").alias("why"))
    return unresolved.union(twice).union(alone)


def relink(tag: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags with concepts cleared and set anew; callers overwrite as a whole."""
    keys = ["regulator_id", "facet", "name"]
    return tag.drop("concept").join(mapping.select(*keys, "concept").distinct(), keys, "left")


def relink_whole(tag: DataFrame, mapping: DataFrame) -> DataFrame:
    """``relink``, all or nothing: a mapping with a violation raises and names one."""
    bad = mapping_violations(mapping, tag).filter("why <> 'one_regulator'").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['why']}: {bad[0]['item']}")
    return relink(tag, mapping)


def resolve_edges(edges: DataFrame, document: DataFrame) -> DataFrame:
    """Relationship edges whose hint names a document's source id get their target."""
    names = document.select(F.col("source_id").alias("target_hint"), F.col("entry_id").alias("_to"))
    return edges.join(names, "target_hint", "left").withColumn("to_id", F.coalesce("to_id", "_to")).withColumn("resolved", F.col("to_id").isNotNull()).drop("_to")
