"""WARC archives: write captures, read archives back, and assemble transactions.

A capture is three records: a request, a response (or a revisit where the same payload is kept elsewhere) and a
metadata record. Request and metadata name the response in WARC-Concurrent-To; assembly groups records by that
identifier and emits one nested row per capture. Archives are gzip files with a member per record, written by tasks
into the shared folder (whole or not at all, under names that a repeated task reuses), and rolled at ROLL_BYTES so
that a reader's task holds one archive of bounded size (a single larger record makes a larger archive).

Cases: a null html is an empty payload; payloads of fewer than ``min_bytes`` bytes are never revisits; each row is a
capture, and those of one id and payload are numbered by url, the number ending the record's id from the second on; a
null url gives an empty target; further columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches, put_file, work_path, written

ROLL_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"  # the tables hold no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORDS = (
    "capture string, record_id string, record_type string, concurrent_to string, target_uri string, page_id long, "
    "payload_digest string, payload_bytes long, refers_to long, fields string, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, from built-in functions: each 40 bits are 8 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """For each page id and digest: the id of the page whose response holds the payload, null where it is its own."""
    own = written(pages.select("page_id", F.octet_length("html").cast("long").alias("n"), base32_sha1(F.col("html").cast("binary")).alias("digest")), "payloads")
    heads = own.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n_pages")).filter("n_pages > 1")
    heads = written(heads, "heads")  # so that the join below is one that Spark splits where a payload is hot
    pairs = own.select("page_id", "digest").distinct()
    return pairs.join(heads.select("digest", "head").hint("merge"), "digest", "left").select("page_id", "digest", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"))


def record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def capture(page_id: int, url: str, html: bytes, digest: str, refers_to: int | None, number: int = 1) -> bytes:
    rid, uri = f"urn:page:{page_id}:{digest}" + (f":{number}" if number > 1 else ""), [("WARC-Target-URI", "".join(url.split()))]
    payload, near = ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Concurrent-To", f"<{rid}>")
    head = HTTP_HEAD.format(len(html)).encode()
    if refers_to is None:
        main = record("response", rid, [*uri, payload, ("Content-Type", "application/http; msgtype=response")], head + html)
    else:
        main = record("revisit", rid, [*uri, payload, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("Content-Type", "application/http; msgtype=response")], head)
    ask = record("request", f"{rid}:request", [*uri, near, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    meta = record("metadata", f"{rid}:metadata", [*uri, near, ("Content-Type", "application/warc-fields")], f"page-id: {page_id}\r\npayload-bytes: {len(html)}\r\n".encode())
    return ask + main + meta


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the captures of (page_id, url, html) below ``path``; returns a manifest (archive, captures)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    decided = revisits(pages, min_bytes)
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("None")), "digest")
    full = pages.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("key", key)
    # a merge join brings rows of one id and payload together; the window keeps them in one task and numbers them
    both = full.join(decided.select(key.alias("key"), "refers_to").hint("merge"), "key")
    dealt = both.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("url"))).select("page_id", "url", "html", "digest", "refers_to", "number")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts, n, size, held = TaskContext.get().partitionId(), 0, 0, 0, []

        def done() -> pa.RecordBatch:
            put_file(f"{path}/part-{part:06d}-{parts:05d}.warc.gz", b"".join(held))
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{parts:05d}.warc.gz"], "captures": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, html, digest, refers_to, number in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "number")), strict=True):
                held.append(capture(page_id, url, html.encode(), digest, refers_to, number))
                n, size = n + 1, size + len(held[-1])
                if size >= ROLL_BYTES:
                    yield done()
                    parts, n, size, held = parts + 1, 0, 0, []
        if held:
            yield done()

    return written(dealt.mapInArrow(write, "archive string, captures long"), "warc_manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The records of an archive: gzip members, one after the other."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out, step = zlib.decompressobj(31), [], 1 << 16
        while not z.eof:
            chunk = view[at : at + step]
            if not chunk:
                raise ValueError("archive ends inside a record")
            out.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        yield b"".join(out)


def parsed(raw: bytes, payloads: bool) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    block = rest[: int(h["content-length"])]
    if not version.startswith("WARC/") or h.get("warc-block-digest", "").removeprefix("sha1:") != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {h.get('warc-record-id')}")
    rid, near, kind = h["warc-record-id"].strip("<>"), h.get("warc-concurrent-to", "").strip("<>") or None, h["warc-type"]
    page, back = rid.split(":")[2], h.get("warc-refers-to", "").strip("<>")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    fields = block.decode() if kind == "metadata" else None
    sizes = dict(x.split(": ", 1) for x in fields.split("\r\n") if ": " in x) if fields else {}
    return {
        "capture": near or rid, "record_id": rid, "record_type": kind, "concurrent_to": near, "target_uri": h.get("warc-target-uri"),
        "page_id": None if page == "None" else int(page),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": len(payload) if payload is not None else int(sizes["payload-bytes"]) if "payload-bytes" in sizes else None,
        "refers_to": int(back.split(":")[2]) if back else None, "fields": fields, "payload": payload if payloads else None,
    }


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives below ``path``; block digests are checked. Payloads only where asked for."""
    from planlark.llm.common import arrow_schema, batches_of

    probe = spark.createDataFrame([], RECORDS)
    schema = arrow_schema(probe.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for raw in members(data.as_py()):
                    rows.append(parsed(raw, payloads))
                    size += len(raw) if payloads else 300
                    if size > 4 << 20:
                        yield batches_of({k: [r[k] for r in rows] for k in schema.names}, schema)
                        rows, size = [], 0
                if rows:
                    yield batches_of({k: [r[k] for r in rows] for k in schema.names}, schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(read, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the requests, the responses (or revisits) and the metadata of one concurrent-to
    identifier, each an array by record id; none is left out."""
    whole = F.struct("record_id", *[c for c in records.columns if c not in ("capture", "record_id")])
    of = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("record_type").isin(*kinds), whole)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    others = F.when(~F.col("record_type").isin("request", "response", "revisit", "metadata"), whole)
    return records.groupBy("capture").agg(of("request").alias("requests"), of("response", "revisit").alias("responses"), of("metadata").alias("metadata"), F.collect_list(others).alias("others"))


def op10_warc(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    bounded_batches(spark)
    path = work_path(spark, "warc")
    manifest = write_archives(pages, path, min_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = captures(read_records(spark, path)).select(F.explode("responses").alias("response"), F.try_element_at("metadata", F.lit(1)).alias("metadata"))
    return rows.select(
        F.col("response.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )
