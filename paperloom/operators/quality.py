"""File and parser validation, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates


def file_validation(rows: DataFrame, required: list[str], asof: str, id_col: str = "source_id", date_col: str = "published_date") -> DataFrame:
    """metric, n of a normalised file: rows, missing fields, repeated ids, dates that are not ISO or in the future, empty titles."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    iso = dates.is_iso(F.col(date_col))
    metrics = {
        "rows": F.count("*"),
        **{f"missing_{c}": F.count(F.when(blank(c), 1)) for c in required},
        "repeated_ids": F.count(id_col) - F.countDistinct(id_col),
        "dated": F.count(F.when(~blank(date_col), 1)),
        "not_iso": F.count(F.when(~blank(date_col) & ~iso, 1)),
        "future": F.count(F.when(iso & (F.col(date_col) > asof), 1)),
    }
    one = rows.agg(*(v.alias(k) for k, v in metrics.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in metrics))).alias("x")).select("x.*")


def parser_check(rows: DataFrame, source: str, required: list[str], url: str, least: int = 1) -> DataFrame:
    """Per source: rows, rows with all fields, the largest share of one url, and ok."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    by_url = rows.groupBy(source, url).agg(F.count("*").alias("u"), F.count(F.when(whole, 1)).alias("w"))
    out = by_url.groupBy(source).agg(F.sum("u").alias("n"), F.sum("w").alias("whole"), F.max("u").alias("most"))
    ok = (F.col("n") >= least) & (F.col("whole") == F.col("n")) & ~((F.col("n") >= 3) & (F.col("most") * 2 > F.col("n")))
    return out.withColumn("ok", ok)


def link_sample(rows: DataFrame, id_col: str, url_col: str, n: int, seed: int, fetch=None) -> DataFrame:
    """n rows with a link, picked by a hash, and what ``fetch`` (a column function, none by default) says of each."""
    from .sample import uniform

    picked = uniform(rows.filter(F.col(url_col).isNotNull()), id_col, n, seed)
    return picked.withColumn("reachable", F.lit(None).cast("boolean") if fetch is None else fetch(F.col(url_col)))


def adapter_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if("needs_download").alias("needs_download"), F.count_if(F.col("file_url").isNull()).alias("no_file"), F.count_if(F.col("published_date").isNull()).alias("no_date"))


def run_status(found: Column, blocked: Column, failed: Column, error: Column) -> Column:
    """ERROR before anything; blocked with rows is partial, blocked without is BLOCKED, never zero new rows."""
    return F.when(error.isNotNull(), "ERROR").when((blocked > 0) & (found == 0), "BLOCKED").when((blocked > 0) | (failed > 0), "PARTIAL").otherwise("SUCCESS")


def skip_reason(guard: Column, trigger: Column, explicit: Column) -> Column:
    """Why a scheduled run skips a guarded regulator; a run that names it never does."""
    return F.when(guard.isNotNull() & ~explicit & (trigger == "schedule"), guard)


def job_failed(runs: DataFrame) -> DataFrame:
    """Whether every regulator of a run errored."""
    return runs.groupBy("run_id").agg(F.min(F.col("status") == "ERROR").alias("failed"))


def document_list_score(body: Column) -> Column:
    """How much a JSON body looks like a list of documents: high, medium or low."""
    lists = F.coalesce(F.when(F.try_variant_get(F.try_parse_json(body), "$[0]", "variant").isNotNull(), body), *(F.get_json_object(body, f"$.{k}") for k in LIST_KEYS))
    first, second = F.get_json_object(lists, "$[0]"), F.get_json_object(lists, "$[1]")
    keys = F.json_object_keys(first)
    title, date = F.exists(keys, lambda k: k.isin(TITLE_KEYS)), F.exists(keys, lambda k: F.contains(F.lower(k), F.lit("date")))
    good = second.isNotNull() & keys.isNotNull()
    return F.when(good & title & date, "high").when(good & (title | date), "medium").otherwise("low")


# Keys under which feeds put their lists and titles.
LIST_KEYS = ["data", "results", "items", "records", "rows", "documents"]
TITLE_KEYS = ["title", "name", "subject", "heading", "description"]
