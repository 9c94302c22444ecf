"""Operator 8, WARC: revisit resolution.

Headers (id, digest, size) are shuffled by payload digest. Of records whose payloads are
equal and at least ``MIN_PAYLOAD`` bytes, that with the smallest page_id is the response and
the others become revisits; smaller payloads are always responses. Records are written with
fresh headers by Spark's own text writer (the record separator is its line separator), so
any file system that Spark can write to will do, and read back by content length. The mean
size of the payloads sets how many records a file gets, for ``FILE_BYTES`` a file; a payload
of at least ``OWN_FILE`` has a file of its own, so no reader holds more than a few such sizes.
Files are one gzip member each; ``compression="none"`` writes archives in which a reader can
seek to a record.

A frequent digest does not gather in one task: its minimum comes from partial aggregates, the
payload rows are joined to it by an outer join whose large partitions Spark splits, and only
rows that can have a twin take part.

Defined results: null html is the empty payload. A null url is written as about:blank; line
breaks in a url are percent-encoded. Rows that repeat the smallest page_id are all responses.
A null page_id is a revisit if a row with an id has its payload, else a response; its revisits
refer to the smallest id. Extra columns are passed over. An empty table gives no archive rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm.common import store, table_path

MIN_PAYLOAD = 100
#: Payload bytes of an archive file, and the size from which a payload has one to itself.
FILE_BYTES = 64 << 20
OWN_FILE = 8 << 20
HEADER_BYTES = 600
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _urn(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def resolve(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, size, digest, first: the response's page_id for revisits, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload"), 256))
    large = F.col("size") >= min_payload
    headers = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null").select("digest", "least")
    joined = rows.where(large).join(headers, "digest", "left").select(*rows.columns, "least")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    first = F.when(revisit, F.col("least"))
    return joined.select(*rows.columns, first.alias("first")).unionByName(rows.where(~large).withColumn("first", F.lit(None).cast("long")))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One string column: each record without the closing separator."""
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(key),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("first").cast("string")))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nPage-ID: "), key)).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, compression: str = "gzip") -> None:
    size = F.octet_length(F.coalesce("html", F.lit("")))
    small = size < OWN_FILE
    told = pages.agg(F.avg(F.when(small, size + HEADER_BYTES)).alias("mean"), F.count_if(~small).alias("large")).first()

    def write(rows: DataFrame, per_file: int) -> None:
        records(resolve(rows, min_payload)).write.mode("append").option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)

    # equal payloads have one size, so each part resolves its own revisits
    write(pages.where(small), max(1, int(FILE_BYTES / (told["mean"] or FILE_BYTES))))
    if told["large"]:
        write(pages.where(~small), 1)


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, one at a time."""
    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if head.strip():
                    raise ValueError("a record ends within its header")
                return
            head += line
        if not head.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        fields = _fields(head[:-4])
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, digest, size, refers_to (record id), payload (null for revisits); responses are held to their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for f, block in parse(_opened(content.as_py())):
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(_fields(http)["content-length"])
                    revisit = f["warc-type"] == "revisit"
                    if not revisit and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    rows.append({"record_id": f["warc-record-id"], "record_type": f["warc-type"], "page_id": int(f["page-id"]) if "page-id" in f else None, "url": f["warc-target-uri"], "digest": digest, "size": size, "refers_to": f.get("warc-refers-to"), "payload": None if revisit else body})
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, page_id long, url string, digest string, size long, refers_to string, payload binary")


def report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back and resolve revisits: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or table_path(spark, "warc")
    write_archives(pages, path)
    heads = store(read_archives(spark, path).drop("payload"), "warc-heads")
    cols = ["page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type"]
    responses = heads.where("record_type = 'response'").select(*cols, F.lit(None).cast("long").alias("refers_to"))
    target = heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.min("page_id").alias("original"))
    revisits = heads.where("record_type = 'revisit'").join(target, F.col("refers_to") == F.col("target")).select(*cols, F.col("original").alias("refers_to"))
    return responses.unionByName(revisits)
