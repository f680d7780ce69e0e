"""Legacy archives to WARC: parse ARC records by version and declared length, synthesise WARC records, write, read back.

An ARC file starts with a version block whose last line names the fields of the header lines: five in version 1, ten
in version 2. Each record is a header line, then as many bytes as its last field declares, then a newline. ``read_arc``
reads ``.arc`` and ``.arc.gz`` files, of one gzip member or of one a record, from any store that Spark reads: a task
holds one file as it is stored (archives of this kind are some 100 MB) and one record of it unpacked.

Conversion gives each record a WARC identifier, an ISO timestamp from the 14 digits, a SHA-256 payload digest and a type:
among records of equal payloads of at least ``min_revisit`` bytes the smallest id is the response and the others revisit
it; smaller payloads are always responses. The identifier names the record's id and a part of its digest, so that any
reader finds both from WARC-Record-ID and WARC-Refers-To; a revisit's length is that of the response it refers to.
Records of foreign archives, which carry no id, get one from their file and offset.

``through_warc`` takes a table that way: rows become ARC files (both versions) in the shared folder, which are then read,
converted, written as WARC and read again. In the ARC the row's id is the fragment of the URL. Rows that repeat the
smallest id with the same payload are responses too. Null payloads are empty; a null id never beats another id and,
alone, is a response. An empty table gives no rows.

Archives are written by Spark's text writer, so that every executor writes straight to the shared folder; each file is one
gzip member and starts with a warcinfo record. ``members`` gives records as gzip members of their own, for sinks that take
bytes. Reading a WARC streams the pieces between record starts and joins them until the declared length is there, so a
payload may hold any text, a record start included.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_batches, steps, texts_of, tidied, written

# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Repeated payloads whose digests are broadcast (some 100 bytes each); beyond it the records are shuffled by digest.
BROADCAST_DIGESTS = 500_000
START = "WARC/1.1\r\n"
END = "\r\n\r\n"


def version_block(version: int, date: str, name: str) -> bytes:
    body = f"{version} 0 converter\n{' '.join(ARC_FIELDS[version])}\n".encode()
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str | None, payload: bytes, version: int, date: str, name: str, at: int) -> bytes:
    n = len(HTTP) + len(payload)
    url = "".join("%20" if c.isspace() else c for c in url or "") or "unknown:"
    more = "" if version == 1 else f"200 - - {at} {name} "
    return f"{url} 0.0.0.0 {date} text/html {more}{n}\n".encode() + HTTP + payload + b"\n"


def arc_file(rows: list[tuple[str, bytes]], version: int, date: str = "20240101000000", name: str = "pages.arc") -> bytes:
    """An ARC file of (url, payload) rows."""
    out = [version_block(version, date, name)]
    at = len(out[0])
    for url, payload in rows:
        out.append(arc_record(url, payload, version, date, name, at))
        at += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the version block, from bytes or a stream of them."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data

    def block(size: str) -> bytes:
        out = stream.read(int(size))
        if len(out) < int(size):
            raise ValueError("ARC record shorter than it declares")
        return out

    head = stream.readline()
    if not head:
        return
    lines = block(head.rsplit(b" ", 1)[1]).decode().split("\n")
    fields = lines[1].split(" ")
    if fields != ARC_FIELDS.get(int(lines[0].split(" ")[0])):
        raise ValueError(f"unknown ARC version block: {lines[:2]}")
    while head := stream.readline():
        if head == b"\n":
            continue
        values = head.decode("utf-8", "replace").rstrip("\n").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"ARC header line with {len(values)} fields, not {len(fields)}")
        header = dict(zip(fields, values))
        yield header, block(header["Archive-length"])


def write_arc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20240101000000") -> None:
    """The rows as gzipped ARC files, of versions 1 and 2 in turn; the id is the fragment of the URL."""

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        version, name = 1 + task % 2, f"pages-{task}.arc"
        for part in steps(batches, 2):
            rows = []
            for row_id, url, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2))):
                if not at:
                    rows.append(version_block(version, date, name))
                    at = len(rows[0])
                url = (url or "unknown:") + "#" + ("" if row_id is None else "=" + quote(str(row_id), safe=""))
                rows.append(arc_record(url, payload, version, date, name, at))
                at += len(rows[-1])
            # the writer ends each row with a newline
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in rows], pa.binary()).cast(pa.string())], names=["value"])

    small_batches(df.sparkSession)
    df.select(id_col, url_col, payload_col).mapInArrow(tidied(run), "value string").write.option("compression", "gzip").text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """url, ip, date (ISO), mime, payload (binary, HTTP headers cut), payload_bytes, digest, file, place of every record.

    place counts a file's records from 0. Files may be gzipped or not, whatever their names.
    """
    names = ["url", "ip", "date", "mime", "payload", "payload_bytes", "digest", "file", "place"]
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                rows, size = [], 0
                for place, (header, block) in enumerate(parse_arc(stream)):
                    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    payload, d = block[max(cut, 0) :] if cut != 3 else b"", header["Archive-date"]
                    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append((header["URL"], header["IP-address"], when, header["Content-type"], payload, len(payload), hashlib.sha256(payload).hexdigest(), file, place))
                    size += len(payload)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(tidied(run), "url string, ip string, date string, mime string, payload binary, payload_bytes long, digest string, file string, place long")


def with_ids(records: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """The records with ``id``: the row's, from the fragment of the URL, or else one from file and place (id_type None)."""
    if id_type is None:
        return records.withColumn("id", F.sha2(F.concat_ws("|", "file", "place"), 256))
    value = F.when(F.col("url").rlike("#=[^#]*$"), F.url_decode(F.regexp_extract("url", "#=([^#]*)$", 1)))
    return records.withColumn("id", value.cast(id_type)).withColumn("url", F.regexp_replace("url", "#=?[^#]*$", ""))


def typed(records: DataFrame, min_revisit: int = 100) -> DataFrame:
    """The records with record_type and refers_to. Payloads are shuffled only if very many of them repeat."""
    firsts = records.filter(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    firsts = written(firsts, "firsts", 8)
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("_first")), F.col("_first"))
    return records.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("_first").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _urn(row_id, digest):
    """A record's identifier: its id, escaped, and the start of its digest."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.url_encode(row_id.cast("string")), "\\+", "%20")), F.lit("")), F.lit(":"), F.substring(digest, 1, 16), F.lit(">"))


def id_of(urn: str) -> str | None:
    """The id in a record's identifier."""
    name = urn.removeprefix("<urn:page:").rsplit(":", 1)[0]
    return unquote(name[1:]) if name.startswith("=") else None


def warc_texts(records: DataFrame) -> DataFrame:
    """value: the WARC record of each typed record, without the record end."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(F.lit(HTTP.decode()), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    parts = [
        F.lit(START),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("id"), F.col("digest"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("digest"))))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    ]
    return records.select(F.concat(*parts).alias("value"))


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Gzipped WARC files of typed records, each with a warcinfo record first."""
    about = "software: ARC converter\r\nformat: WARC File Format 1.1\r\n"
    row = F.monotonically_increasing_id()
    info = F.concat(F.lit(f"{START}WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo:"), row.cast("string"), F.lit(f">\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}{END}"))
    first = row.bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task, and so of a file
    warc_texts(records).select(F.concat(F.when(first, info).otherwise(F.lit("")), "value").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def members(records: DataFrame) -> DataFrame:
    """member: each typed record as a gzip member of its own; any run of them is a .warc.gz file."""

    def run(batches):
        for part in steps(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x + END.encode(), mtime=0) for x in texts_of(part.column(0))], pa.binary())], names=["member"])

    return warc_texts(records).mapInArrow(tidied(run), "member binary")


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records in the pieces between record starts; the last piece keeps its record end."""
    held, need = b"", 0
    mark = (END + START).encode()
    for piece in pieces:
        held = held + mark + piece if held else piece.removeprefix(START.encode())
        if len(held) < need:
            continue
        head, _, block = held.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
        size = int(fields["Content-Length"])
        if len(block) < size:
            need = len(head) + 4 + size
            continue
        yield fields, block[:size]
        held, need = b"", 0
    if held:
        raise ValueError("WARC record shorter than it declares")


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of every record; a response's digest must match its payload.

    Ids are those in WARC-Record-ID and WARC-Refers-To. A revisit's length is that of the response with its digest.
    """

    def run(batches):
        def pieces():
            for batch in batches:
                yield from texts_of(batch.column(0))

        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for fields, block in records_of(pieces()):
            if fields["WARC-Type"] == "warcinfo":
                continue
            n, digest, refers = None, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get("WARC-Refers-To")
            if fields["WARC-Type"] == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                n = len(payload)
                if digest != hashlib.sha256(payload).hexdigest():
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
            rows.append((id_of(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], id_of(refers) if refers else None))
            if len(rows) == 4096:
                yield out()
                rows.clear()
        if rows:
            yield out()

    raw = spark.read.option("lineSep", END + START).text(path)
    back = raw.mapInArrow(tidied(run), "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    back = written(back.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type)), "records")
    again = back.filter("record_type = 'revisit'").drop("payload_bytes")
    sizes = back.filter("record_type = 'response'").select("payload_digest", F.col("id").alias("refers_to"), "payload_bytes").distinct()
    again = again.join(sizes, ["payload_digest", "refers_to"])
    return back.filter("record_type = 'response'").unionByName(again)


def through_warc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, path: str | None = None) -> DataFrame:
    """Rows to ARC files, their records to WARC files, and back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    path = path or scratch(spark, "archives")
    kind = df.schema[id_col].dataType
    write_arc(df, f"{path}/arc", id_col, url_col, payload_col)
    write_warc(typed(with_ids(read_arc(spark, f"{path}/arc"), kind), min_revisit), f"{path}/warc")
    return read_warc(spark, f"{path}/warc", kind.simpleString()).withColumnRenamed("id", id_col).select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to")
