"""JSON, CSV and store sources and sinks, feeds with nested or packed fields, paged sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import NORMALIZED


def json_array(spark: SparkSession, path: str, schema: T.StructType = NORMALIZED) -> DataFrame:
    """A file holding one JSON array, or many such files."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header; rows of another width than the header are dropped, line breaks in quotes kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, mode="DROPMALFORMED")


def write_csv(df: DataFrame, path: str, columns: list[str], append: bool = False) -> None:
    """Listed columns only, arrays as comma text; others are ignored, missing ones empty."""
    kinds = dict(df.dtypes)
    cells = [(F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*cells).write.mode("append" if append else "overwrite").csv(path, header=True, quote='"', escape='"')


def envelope(rows: DataFrame, generated_at: Column, limit: int = 1000) -> DataFrame:
    """One JSON document of new items: {generated_at, count, items}. Refuses more than ``limit`` items: it is one row."""
    packed = rows.limit(limit + 1).agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("items")).withColumn("count", F.size("items"))
    checked = packed.withColumn("items", F.when(F.col("count") > limit, F.raise_error(F.lit("too many new items for one envelope")).cast(packed.schema["items"].dataType)).otherwise(F.col("items")))
    return checked.select(F.to_json(F.struct(generated_at.alias("generated_at"), "count", "items")).alias("value"))


def unseen(rows: DataFrame, known: DataFrame, key: str, position: list[str]) -> DataFrame:
    """First row of each key that is not known, within the run as well."""
    from ..operators.dedup import one_per_key

    return one_per_key(rows.join(known.select(key), key, "left_anti"), [key], position)


def store(spark: SparkSession, table: str = "documents", url: str | None = None, path: str | None = None, **options) -> DataFrame:
    """Kept rows of a document store, through JDBC or from a Parquet copy."""
    rows = spark.read.parquet(path) if path else spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.filter(F.col("kept").cast("boolean"))


def feed_items(bodies: DataFrame, body: str, list_path: str, fields: dict[str, list[str]]) -> DataFrame:
    """Items of a JSON feed, one row each; a field is the first of its candidate keys that is there."""
    items = F.explode(F.variant_get(F.parse_json(body), list_path, "array<variant>")).alias("item")
    rows = bodies.select(*[c for c in bodies.columns if c != body], items)
    cells = [F.coalesce(*(F.try_variant_get("item", f"$.{k}", "string") for k in keys)).alias(name) for name, keys in fields.items()]
    return rows.select(*[c for c in rows.columns if c != "item"], *cells)


def packed_cell(cell: Column, sep: str, names: list[str]) -> Column:
    """A delimiter-packed cell as a struct; missing parts are null."""
    parts = F.split(cell, f"\\Q{sep}\\E", -1)
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


@F.pandas_udf(T.StringType())
def deep_list(bodies, keys):
    """JSON of the first list, breadth first, whose first item has the marker key; null when there is none."""
    import json
    from collections import deque

    def find(body, key):
        queue = deque([json.loads(body)] if body else [])
        while queue:
            x = queue.popleft()
            if isinstance(x, list):
                if x and isinstance(x[0], dict) and key in x[0]:
                    return json.dumps(x)
                queue.extend(x)
            elif isinstance(x, dict):
                queue.extend(x.values())
        return None

    return bodies.combine(keys, find)


def script_records(text: Column, patterns: dict[str, str]) -> Column:
    """Records in script text: one pattern a field, the n-th matches form the n-th record."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias(name) for name, p in patterns.items()))


def nested_items(rows: DataFrame, outer: str, inner: str, lists: list[str]) -> DataFrame:
    """One row an inner item of a two-level array; list fields as '; ' text without blanks."""
    out = rows.select(*[c for c in rows.columns if c != outer], F.explode(outer).alias("_o")).select("*", F.explode(f"_o.{inner}").alias("_i"))
    plain = [f.name for f in out.schema["_i"].dataType.fields if f.name not in lists]
    group = [f.name for f in out.schema["_o"].dataType.fields if f.name != inner]
    return out.select(*[c for c in out.columns if c not in ("_o", "_i")], *[F.col(f"_o.{g}").alias(g) for g in group], *[F.col(f"_i.{p}").alias(p) for p in plain], *[F.array_join(F.filter(f"_i.{x}", lambda v: v != ""), "; ").alias(x) for x in lists])


def without_repeats(pages: DataFrame, site: str, page: str, signature: Column) -> DataFrame:
    """Pages until the first whose content repeats an earlier page's: portals serve a known page past the end."""
    rows = pages.withColumn("_s", signature)
    first = rows.groupBy(site, "_s").agg(F.min(page).alias("_f"))
    end = rows.join(first, [site, "_s"]).filter(F.col(page) > F.col("_f")).groupBy(site).agg(F.min(page).alias("_end"))
    return rows.join(end, site, "left").filter(F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_s", "_end")


def until_short(pages: DataFrame, site: str, page: str, size: Column, full: int) -> DataFrame:
    """Pages up to the first that is not full."""
    w = Window.partitionBy(site).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("_ended", F.max((size < full).cast("int")).over(w)).filter(F.coalesce("_ended", F.lit(0)) == 0).drop("_ended")


def with_meta(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Rows with their sidecar values; a row without any raises. Sidecars hold one row a feed."""
    out = rows.join(meta.withColumn("_there", F.lit(True)), key, "left")
    return out.filter(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no sidecar for "), F.col(key))).isNull()).otherwise(True)).drop("_there")
