"""The engine's tables as views over the test fixture; the only module that knows fixture column names.

A table with a fixture row's every column is never kept: each view projects what the model names, and Catalyst prunes
the rest. SQL holds the same definitions as common table expressions for the DuckDB side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASOF = "1998-01-01"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(raw: DataFrame) -> DataFrame:
    """Versions of documents from event rows, batch or stream."""
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), (F.col("value") > 20).alias("kept"), F.col("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))


class Tables:
    """Views of the model over a fixture folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name)

    def domain(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("domain_id"), F.col("r_name").alias("domain_name"))

    def regulator(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("regulator_id"), F.col("n_name").alias("code"), F.col("n_regionkey").alias("domain_id"))

    def document(self) -> DataFrame:
        k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        url = F.when(k % 4 == 0, F.concat(F.lit("https://www.isro.gov.in/files/"), k, F.lit(".pdf?v=1"))).when(k % 4 == 1, F.concat(F.lit("https://dos.gov.in/flipbook/"), k)).when(k % 4 == 2, F.concat(F.lit("https://example.org/page/"), k))
        orders = self.raw("orders").select(
            k.alias("document_id"), F.col("o_custkey"), F.when(k % 97 != 0, day).alias("published_date"), url.alias("file_url"),
            F.date_add(day, 1).alias("first_ingested"), F.col("o_orderpriority").alias("category_hint"), F.col("o_orderstatus").alias("status_hint"),
        )
        return orders.join(self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("regulator_id")), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")

    def entry(self) -> DataFrame:
        """One row a line. The title comes from the part through a join that only queries on titles pay for."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        entry_id = F.sha1(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, F.col("l_shipdate").cast("date")).cast("binary"))
        confidence = F.round(1 - F.col("l_discount") * 4, 2)
        reasons = F.array_compact(F.array(F.when(confidence < 0.75, "low_confidence"), F.when(F.col("l_tax") > 0.06, "invalid_subject"), F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.02), "scope_mismatch")))
        return self.raw("lineitem").select(
            entry_id.alias("entry_id"), F.col("l_orderkey").alias("document_id"),
            F.when(F.col("l_linenumber") != 7, F.concat(F.lit("S-"), F.col("l_partkey"))).alias("subject_id"),
            F.concat(F.lit("I-"), F.col("l_suppkey")).alias("instrument_id"),
            F.when(F.col("l_linestatus") == "F", "In Force").when(F.col("l_tax") < 0.03, "Amended").alias("status"),
            confidence.alias("confidence"), (F.col("l_returnflag") == "R").alias("needs_review"), reasons.alias("review_reasons"),
            F.col("l_shipdate").cast("date").alias("created"), F.col("l_partkey").alias("part_key"),
        )

    def title(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("title"))

    def tag(self) -> DataFrame:
        subject = self.raw("part").select(F.concat(F.lit("S-"), F.col("p_partkey")).alias("tag_id"), F.lit("SUBJECT").alias("facet"), F.col("p_name").alias("name"), (F.col("p_partkey") % 25).cast("int").alias("regulator_id"), F.when(F.col("p_size") > 10, "ACTIVE").otherwise("DEPRECATED").alias("status"), F.col("p_brand").alias("concept"))
        instrument = self.raw("supplier").select(F.concat(F.lit("I-"), F.col("s_suppkey")).alias("tag_id"), F.lit("INSTRUMENT_TYPE").alias("facet"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("regulator_id"), F.when(F.col("s_acctbal") > 0, "ACTIVE").otherwise("DEPRECATED").alias("status"), F.lit(None).cast("string").alias("concept"))
        return subject.union(instrument)

    def store(self) -> DataFrame:
        """Last state of each event user, as the package's document store."""
        from ..operators.dedup import one_per_key

        e = self.events()
        return one_per_key(e, ["document_id"], ["ts", "event_id"], last=True)

    def events(self) -> DataFrame:
        return as_events(self.raw("events"))

    def normalized(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", F.col("source").alias("feed"), F.substring("text", 1, 60).alias("title"), "lang", "n_chars")
        return d


_CTES = {
    "domain": "SELECT r_regionkey AS domain_id, r_name AS domain_name FROM region",
    "regulator": "SELECT n_nationkey AS regulator_id, n_name AS code, n_regionkey AS domain_id FROM nation",
    "document": """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS published_date,
        CASE o_orderkey % 4 WHEN 0 THEN 'https://www.isro.gov.in/files/' || o_orderkey || '.pdf?v=1' WHEN 1 THEN 'https://dos.gov.in/flipbook/' || o_orderkey WHEN 2 THEN 'https://example.org/page/' || o_orderkey END AS file_url,
        CAST(o_orderdate AS DATE) + 1 AS first_ingested, o_orderpriority AS category_hint, o_orderstatus AS status_hint, c_nationkey AS regulator_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "entry": """SELECT sha1(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE))) AS entry_id,
        l_orderkey AS document_id, CASE WHEN l_linenumber <> 7 THEN 'S-' || l_partkey END AS subject_id, 'I-' || l_suppkey AS instrument_id,
        CASE WHEN l_linestatus = 'F' THEN 'In Force' WHEN l_tax < 0.03 THEN 'Amended' END AS status, round(1 - l_discount * 4, 2) AS confidence, l_returnflag = 'R' AS needs_review,
        list_filter([CASE WHEN round(1 - l_discount * 4, 2) < 0.75 THEN 'low_confidence' END, CASE WHEN l_tax > 0.06 THEN 'invalid_subject' END, CASE WHEN l_linestatus = 'O' AND l_tax < 0.02 THEN 'scope_mismatch' END], lambda x: x IS NOT NULL) AS review_reasons,
        CAST(l_shipdate AS DATE) AS created, l_partkey AS part_key FROM lineitem""",
    "title": "SELECT p_partkey AS part_key, p_name AS title FROM part",
    "tag": """SELECT 'S-' || p_partkey AS tag_id, 'SUBJECT' AS facet, p_name AS name, CAST(p_partkey % 25 AS INTEGER) AS regulator_id, CASE WHEN p_size > 10 THEN 'ACTIVE' ELSE 'DEPRECATED' END AS status, p_brand AS concept FROM part
        UNION ALL SELECT 'I-' || s_suppkey, 'INSTRUMENT_TYPE', s_name, s_nationkey, CASE WHEN s_acctbal > 0 THEN 'ACTIVE' ELSE 'DEPRECATED' END, NULL FROM supplier""",
    "event": "SELECT event_id, ts, user_id AS document_id, event_type AS status, value > 20 AS kept, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "store": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS rn FROM event) WHERE rn = 1",
    "normalized": "SELECT doc_id, source AS feed, substr(text, 1, 60) AS title, lang, n_chars FROM documents",
}


def sql(text: str) -> str:
    """The query with the views that it uses in front."""
    import re

    used, queue = [], [text]
    while queue:
        found = [n for n in _CTES if re.search(rf"\b{n}_v\b", queue[0])]
        for n in found:
            if n not in used:
                used.append(n)
                queue.append(_view(n))
        queue.pop(0)
    order = [n for n in _CTES if n in used]
    ctes = ",\n".join(f"{n}_v AS ({_view(n)})" for n in order)
    body = text.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _view(name: str) -> str:
    import re

    return re.sub(r"\bFROM event\b", "FROM event_v", _CTES[name])
