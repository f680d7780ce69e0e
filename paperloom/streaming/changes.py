"""Incremental ingestion and change tracking, as batch transforms and as Structured Streaming jobs with equal results.

The order of a document's versions is (ts, event_id); there is no rule for late data beyond that.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE = "document_id long, event_id long, field_changed string, old_value string, new_value string"
TRACKED = ["status", "kept"]
#: Fields of a document store whose changes are logged, and those that an update leaves as they were first stored.
STORE_TRACKED = ["subject", "instrument_type", "status", "kept"]
STORE_FIRST = ["source_url", "source_feed", "regulator", "ingested_at"]


def as_text(c: Column, kind: str) -> Column:
    """Booleans compare and log as 1 and 0, everything as text."""
    return c.cast("int").cast("string") if kind == "boolean" else c.cast("string")


def change_log(versions: DataFrame, fields: list[str] = TRACKED) -> DataFrame:
    """One row for each tracked field that differs from the version before; the first version logs nothing."""
    kinds = dict(versions.dtypes)
    w = Window.partitionBy("document_id").orderBy("ts", "event_id")
    cells = F.array(*(F.struct(F.lit(f).alias("field_changed"), F.lag(as_text(F.col(f), kinds[f])).over(w).alias("old_value"), as_text(F.col(f), kinds[f]).alias("new_value")) for f in fields))
    rows = versions.withColumn("_first", F.row_number().over(w) == 1).withColumn("_c", cells).filter("NOT _first")
    return rows.select("document_id", "event_id", "ts", F.explode("_c").alias("c")).filter("NOT (c.old_value <=> c.new_value)").select("document_id", "event_id", "ts", "c.*")


def capture(store: DataFrame, batch: DataFrame, at: Column, key: str = "id", fields: list[str] = STORE_TRACKED, first: list[str] = STORE_FIRST) -> tuple[DataFrame, DataFrame]:
    """The store with a batch upserted, and the change log of the batch.

    A row of the batch replaces all of a stored row but ``first``, nulls included, and sets last_checked; a new row logs
    nothing. The batch holds a key once. Columns that the batch lacks keep their values.
    """
    kinds = dict(store.dtypes)
    names = [c for c in store.columns if c not in (key, "last_checked")]
    new = batch.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in names if c in batch.columns), F.lit(True).alias("_new"))
    old = store.select(F.col(key), *(F.col(c).alias(f"_o_{c}") for c in names), F.col("last_checked").alias("_checked") if "last_checked" in store.columns else F.lit(None).cast("timestamp").alias("_checked"), F.lit(True).alias("_old"))
    rows = old.join(new, key, "full_outer")

    def value(c: str) -> Column:
        if c not in batch.columns:
            return F.col(f"_o_{c}")
        if c in first:
            return F.coalesce(f"_o_{c}", f"_n_{c}")
        return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))

    after = rows.select(key, *(value(c).alias(c) for c in names), F.when(F.col("_new"), at).otherwise(F.col("_checked")).alias("last_checked"))
    tracked = [f for f in fields if f in batch.columns]
    cells = F.array(*(F.struct(F.lit(f).alias("field_changed"), as_text(F.col(f"_o_{f}"), kinds[f]).alias("old_value"), as_text(F.col(f"_n_{f}"), kinds[f]).alias("new_value")) for f in tracked))
    log = rows.filter("_old AND _new").select(F.col(key).alias("document_id"), F.explode(cells).alias("c")).filter("NOT (c.old_value <=> c.new_value)")
    return after, log.select("document_id", "c.*", at.alias("changed_at"))


def touch_checked(store: DataFrame, items: DataFrame, decisions: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """The store with the fingerprints of items that were found unchanged, or had none, and the time of the check.

    Nothing else of a row changes, so no check can overwrite a classification. decisions: key, decision (``fingerprints``).
    """
    seen = items.select(key, F.col("etag").alias("_e"), F.col("last_modified").alias("_m")).join(decisions.filter("decision = 'unchanged'").select(key), key, "left_semi")
    rows = store.join(seen.withColumn("_hit", F.lit(True)), key, "left")
    pick = lambda c, new: F.when(F.col("_hit"), F.coalesce(new, c)).otherwise(F.col(c)).alias(c)
    changed = {"etag": pick("etag", "_e"), "last_modified": pick("last_modified", "_m"), "last_checked": F.when(F.col("_hit"), at).otherwise(F.col("last_checked")).alias("last_checked")}
    return rows.select(*(changed.get(c, F.col(c)) for c in store.columns))


def status_changes_since(log: DataFrame, store: DataFrame, since: str) -> DataFrame:
    """Documents whose status changed since a time, with their state now, the newest change first."""
    hit = log.filter((F.col("field_changed") == "status") & (F.col("ts") >= F.lit(since).cast("timestamp"))).groupBy("document_id").agg(F.max("ts").alias("changed_at"))
    return store.select("document_id", "status").join(hit, "document_id").orderBy(F.col("changed_at").desc(), "document_id")


def first_inserts(versions: DataFrame, condition: Column) -> DataFrame:
    """Documents whose first version meets the condition; later versions never alert."""
    w = Window.partitionBy("document_id").orderBy("ts", "event_id")
    return versions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").filter(condition).drop("_r")


def fingerprints(items: DataFrame, store: DataFrame, key: str = "document_id") -> DataFrame:
    """key, decision: new, not_pdf, failed, unchanged or changed. Only unchanged is skipped; without evidence a row is processed.

    items: key, url, head_ok, etag, last_modified. store: key, etag, last_modified.
    """
    s = store.select(key, F.col("etag").alias("_e"), F.col("last_modified").alias("_m"), F.lit(True).alias("_known"))
    rows = items.join(s, key, "left")
    same = (F.col("_e").isNotNull() & F.col("_e").eqNullSafe(F.col("etag"))) | (F.col("_m").isNotNull() & F.col("_m").eqNullSafe(F.col("last_modified")))
    decision = F.when(F.col("_known").isNull(), "new").when(~F.coalesce(F.lower("url").endswith(".pdf"), F.lit(False)), "not_pdf").when(~F.col("head_ok"), "failed").when(same, "unchanged").otherwise("changed")
    return rows.select(key, decision.alias("decision"))


def early_stop(rows: DataFrame, known: DataFrame, key: str, topic: str, position: str) -> DataFrame:
    """Newest-first rows of each topic before the first that is known."""
    first = rows.join(known.select(key), key, "left_semi").groupBy(topic).agg(F.min(position).alias("_stop"))
    return rows.join(first, topic, "left").filter(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")


def stream_change_log(stream: DataFrame, fields: list[str] = TRACKED) -> DataFrame:
    """The change log of a stream of versions; state per document is its last tracked values.

    A document's rows reach the function in several chunks, so they are ordered over all of a batch.
    """
    import pandas as pd

    state = "ts double, event_id long, " + ", ".join(f"{f} string" for f in fields)
    kinds = dict(stream.dtypes)
    slim = stream.select("document_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("ts"), *(as_text(F.col(f), kinds[f]).alias(f) for f in fields))

    def update(key, chunks: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values(["ts", "event_id"])
        last = tuple(held.get) if held.exists else None
        out = []
        for r in rows.itertuples(index=False):
            values = [None if v is None or v != v else v for v in (getattr(r, f) for f in fields)]
            if last is not None:
                out += [(key[0], r.event_id, f, old, new) for f, old, new in zip(fields, last[2:], values) if old != new]
            last = (float(r.ts), int(r.event_id), *values)
        held.update(last)
        yield pd.DataFrame(out, columns=["document_id", "event_id", "field_changed", "old_value", "new_value"])

    return slim.groupBy("document_id").applyInPandasWithState(update, CHANGE, state, "append", "NoTimeout")


def replay(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Runs a stream over what is there now and appends its rows to a Parquet target, exactly once."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends rows with unseen keys to a Parquet target, batch by batch; a batch that is run again adds nothing."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        others = [c for c in rows.columns if c not in keys]
        new = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*")
        if exists(spark, target):  # it appears with the first batch
            known = spark.read.parquet(target).filter(F.col("_batch") != batch_id)
            new = new.join(known.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/_batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def poll(tick: Callable[[], None], interval: float, ticks: int | None = None, sleep: Callable[[float], None] = time.sleep, failed: Callable[[Exception], None] | None = None) -> int:
    """Runs ``tick`` now and after every interval; one that fails is reported and tried again at the next. Returns failures.

    For sources that only a driver can watch; a stream over files has ``trigger(processingTime=...)`` for this.
    """
    errors, n = 0, 0
    while ticks is None or n < ticks:
        if n:
            sleep(interval)
        n += 1
        try:
            tick()
        except Exception as e:
            errors += 1
            if failed is not None:
                failed(e)
    return errors


def run_log(runs: DataFrame) -> DataFrame:
    """Runs with duration in seconds."""
    return runs.withColumn("seconds", F.col("finished_at").cast("double") - F.col("started_at").cast("double"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Appends finished runs to the log; a run that the log already holds is not added again."""
    spark = runs.sparkSession
    new = run_log(runs)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("run_id"), "run_id", "left_anti")
    new.write.mode("append").parquet(path)


def run_history(log: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with its sources' outcomes: run_id, started_at, seconds, sources, ingested, errors, failed (all errored)."""
    sums = results.groupBy("run_id").agg(F.count("*").alias("sources"), F.sum("ingested").alias("ingested"), F.count_if(F.col("status") == "ERROR").alias("errors"))
    out = log.join(sums, "run_id", "left").select("run_id", "started_at", "seconds", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("ingested", F.lit(0)).alias("ingested"), F.coalesce("errors", F.lit(0)).alias("errors"))
    return out.withColumn("failed", (F.col("sources") > 0) & (F.col("sources") == F.col("errors")))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension, beyond the inventory: counts of events by window with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
