"""Queries over every row: their registered SQL without the row filters that it still holds."""

import pytest
from pyspark.sql import functions as F
from test_oracle import duck, rows  # noqa: F401

from paperloom import queries
from paperloom.operators import maintain


def whole(spark, small, duck, name, *filters):  # noqa: F811
    text = queries.ORACLE_SQL[name]
    for f in filters:
        text = text.replace(*f) if isinstance(f, tuple) else text.replace(f, "")
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.execute(text).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
    return got


@pytest.mark.parametrize("name", ["amendment_chain", "amendment_applied", "status_rule_fix"])
def test_amendments_and_rules_read_all_orders(spark, small, duck, name):  # noqa: F811
    got = whole(spark, small, duck, name, " WHERE o_orderkey % 3 <> 1", " WHERE o_orderkey % 10 = 0")
    n = spark.read.parquet(f"{small}/orders.parquet").count()
    assert len(got) == (n if name != "amendment_chain" else len(range(0, n, 13)))


def test_role_names_count_all_entries(spark, small, duck):  # noqa: F811
    got = whole(spark, small, duck, "role_names", " WHERE confidence > 0.95")
    assert got["n"].sum() == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_date_readers_read_every_dated_row(spark, small, duck):  # noqa: F811
    got = whole(spark, small, duck, "date_readers", " AND day(published_date) > 12")
    assert len(got) == sum(k % 97 != 0 for k in range(spark.read.parquet(f"{small}/orders.parquet").count()))


def test_date_readers_keep_old_dates(spark, small, tmp_path):
    days = ["1969-07-20", "1970-11-10", "1973-03-02", "1973-03-04", "1999-02-01"]
    spark.createDataFrame([(i + 1, 1, d, "1-URGENT", "F") for i, d in enumerate(days)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(tuple(r[c] for c in ("a", "b", "c", "d", "e")) for r in queries.QUERIES["date_readers"](spark, str(tmp_path)).collect())
    assert got == [(d, d if d > "1973-03-03" else None, d, d[:8] + "01", d) for d in days]


def test_remap_reads_all_parts(spark, small, duck):  # noqa: F811
    got = whole(spark, small, duck, "remap_one_to_one", " WHERE p_partkey % 7 <> 0", " WHERE p_size > 48")
    assert len(got) == sum(r.p_partkey % 2 == 0 for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey").collect())


def test_remap_outcomes_over_all_parts(spark, tmp_path):
    parts = [(2, "Blue"), (4, "red"), (5, "Red"), (7, "grey"), (14, "green")]
    spark.createDataFrame([(*p, 1) for p in parts], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["remap_one_to_one"](spark, str(tmp_path)).select("source_id", "outcome", "stored_id").collect())
    assert got == [(1000002, "remap", 2), (1000004, "ambiguous", None), (1000014, "remap", 14)]


def test_feeds_united_hold_all_documents(spark, small, duck):  # noqa: F811
    whole(spark, small, duck, "feeds_united", (" WHERE document_id % 2 = 0 UNION ALL", " UNION ALL"))


def test_midnight_shift_leaves_true_times(spark, tmp_path):
    days = ["2024-01-16 18:30:00", "2024-01-16 18:30:00.721587", "2024-01-16 18:29:59.999999", "2024-01-16 09:00:00", None]
    want = ["2024-01-16 18:30:00", "2024-01-16 18:30:00.721587", "2024-01-16 18:29:59.999999", "2024-01-17 00:00:00", None]
    rows = [(i + 1, d, 1, "a", 1.0, '{"k": 1}') for i, d in enumerate(days)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["midnight_shift"](spark, str(tmp_path)).select("event_id", F.col("ts").cast("string")).orderBy("event_id").collect()
    assert [r.ts for r in got] == want


def test_unshift_moves_exact_half_hours_only(spark):
    df = spark.createDataFrame([("2024-01-16 18:30:00",), ("2024-01-16 18:30:00.5",)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    got = [r.x for r in df.select(maintain.unshift(F.col("ts")).cast("string").alias("x")).collect()]
    assert got == ["2024-01-17 00:00:00", "2024-01-16 18:30:00.5"]


def test_upserted_parts_beyond_a_million(spark, tmp_path):
    parts = [(10, "ten", "B1", 1), (11, "eleven", "B2", 2), (1000010, "far", "B3", 3), (1000011, "odd", "B4", 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in queries.QUERIES["upserted_parts"](spark, str(tmp_path)).select("p_partkey", "name", "p_size").collect()]
    want = [(10, "B1", 1), (11, "eleven", 2), (1000010, "B1", None), (1000010, "B3", 3), (1000011, "odd", 4), (2000010, "B3", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
