"""WARC archives: writing pages as records, and reading archives back with segment reassembly.

Writing: a payload that another record has too is written once (as a response) and referred to by revisits. A
response is an HTTP message with chunked transfer framing; one longer than a segment is cut into a first record and
continuations. The records of all pages are dealt over the files, so the segments of one may lie in different files.

Reading: files are parsed record by record by their Content-Length; continuations are grouped with their first
segment by the origin's identifier, ordered by segment number, checked against the total length and joined; whole records
need no grouping. Then the HTTP head of responses and requests is cut off and the chunked framing decoded; other records are payload as
they are. Revisits take what they refer to. Files are unpacked as they are read, so a worker holds a file as it is packed and 16 MB of its records.

Defined results: a null payload is empty; every row is a record with an id of its own, also rows that repeat a page id or have none; of
equal payloads those of the largest page id are responses and those of other page ids revisits, which refer to that page id and the payload's digest
(and to the record, if it is the only one of both); payloads shorter than ``least`` bytes are never referred to; a record whose segments are missing
or don't add up to the total length raises an error; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, tidy

LEAST = 1000
CHUNK = 1 << 14
#: Bytes of a segment, and records of a file at most: together they bound a file.
SEGMENT, PER_FILE = 1 << 18, 1000
#: Bytes of blocks that a batch of read records has before it is handed on.
BATCH = 1 << 24
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, ('page', *of))))}>"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end between UTF-8 characters."""
    out, at = [], 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def _record(kind: str, own: str, block: bytes, **more) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": len(block), **more}
    return "WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items()) + "\r\n" + block.decode("utf-8")


def _records(chunk: int, segment: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page", "url", "payload", "refers_to", "single"))
            out: list[str] = []
            for page, url, payload, refers_to, single in zip(*columns, strict=True):
                payload = payload.encode("utf-8")
                digest = hashlib.sha1(payload).hexdigest()
                # a record that others refer to is named by what they know of it, any other by its place in the archive
                own = record_id(page, digest) if single and refers_to is None else record_id(page, digest, task, rows)
                rows += 1
                of_page = {} if page is None else {"X_Page": page}
                more = of_page | {"WARC_Target_URI": "".join((url or "urn:none").split()), "WARC_Payload_Digest": f"sha1:{digest}"}
                if refers_to is not None:
                    target = {"WARC_Refers_To": record_id(refers_to, digest)} if single else {}
                    out.append(_record("revisit", own, b"HTTP/1.1 200 OK\r\n\r\n", **more, **target, X_Refers_To_Page=refers_to))
                    continue
                block = _HTTP + b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in _cuts(payload, chunk)) + b"0\r\n\r\n"
                parts = _cuts(block, segment)
                if len(parts) == 1:
                    out.append(_record("response", own, block, **more))
                    continue
                out.append(_record("response", own, parts[0], **more, WARC_Segment_Number=1))
                for k, part in enumerate(parts[1:], 2):
                    total = {"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {}
                    out.append(_record("continuation", record_id(own, k), part, **of_page, WARC_Segment_Origin_ID=own, WARC_Segment_Number=k, **total))
                if sum(map(len, out[-len(parts):])) + len(out) > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    return tidy(run)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """Write gzip-compressed WARC files of the pages under ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload)
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    first = rows.where("digest is not null and page is not null").groupBy("digest", "page").agg(F.count("*").alias("n"))
    first = first.groupBy("digest").agg(F.max("page").alias("first"), (F.max_by("n", "page") == 1).alias("single"), F.sum("n").alias("n")).where("n > 1").drop("n")
    # the payload goes through one exchange, by digest where there is one and else by the row
    rows = rows.withColumn("key", F.coalesce("digest", F.xxhash64("page", "url", "payload").cast("string")))
    rows = rows.join(first.withColumn("key", F.concat("digest", F.lit(""))).drop("digest"), "key", "left")
    rows = rows.select("page", "url", "payload", F.when(F.col("first") != F.col("page"), F.col("first")).alias("refers_to"), (F.col("single") & F.col("page").isNotNull()).alias("single"))
    records = rows.mapInArrow(_records(chunk, segment), "value string")
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def _stream(content: bytes):
    """An archive's bytes, unpacked as they are read (of one gzip member, or of one for each record)."""
    return io.BufferedReader(gzip.open(io.BytesIO(content)), 1 << 18) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _parse(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.schema([("page", pa.int64()), ("type", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column("content").to_pylist():
            file, rows, size = _stream(content), [], 0
            while line := file.readline():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
                head = {}
                while line := file.readline().rstrip(b"\r\n").decode("utf-8"):
                    name, _, value = line.partition(":")
                    head[name.strip().lower()] = value.strip()
                long = {k: int(head[k]) if k in head else None for k in ("content-length", "warc-segment-number", "warc-segment-total-length", "x-page", "x-refers-to-page")}
                block = file.read(long["content-length"])
                if len(block) < long["content-length"] or file.read(4) != b"\r\n\r\n":
                    raise ValueError("a WARC record doesn't end where its length says")
                rows.append({
                    "page": long["x-page"], "type": head["warc-type"], "origin": head.get("warc-segment-origin-id", head["warc-record-id"]), "number": long["warc-segment-number"],
                    "total": long["warc-segment-total-length"], "refers_to": long["x-refers-to-page"], "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": block,
                })
                size += len(block)
                if len(rows) == 256 or size > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, kind)


def dechunk(body: bytes) -> bytes:
    """The content of chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size: end + 4 + size] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[end + 2: end + 2 + size])
        at = end + 4 + size


def _payloads(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out = []
        for kind, blocks in zip(batch.column("type").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            block = b"".join(blocks)
            if kind not in ("response", "request"):
                out.append(None if kind == "revisit" else block)  # no HTTP message
                continue
            head, _, body = block.partition(b"\r\n\r\n")
            out.append(dechunk(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body)
        keep = [batch.column(c) for c in ("page", "type", "refers_to", "digest")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], names=["page", "type", "refers_to", "digest", "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page, type, refers_to, digest, payload: bytes, null for revisits): the records of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(tidy(_parse), "page long, type string, origin string, number int, total long, refers_to long, digest string, block binary")
    whole = records.where("number is null").select("page", "type", "refers_to", "digest", F.array("block").alias("blocks"))
    cut = records.where("number is not null").groupBy("origin").agg(
        F.max("page").alias("page"), F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.max("refers_to").alias("refers_to"),
        F.max("digest").alias("digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("x"))  # a record's segments
    size = F.aggregate("x.block", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    complete = (size == F.col("total")) & (F.size("x") == F.array_max("x.number"))
    checked = F.when(complete, F.col("x.block")).otherwise(F.raise_error(F.concat(F.lit("segments missing: "), "origin")))
    return whole.union(cut.select("page", "type", "refers_to", "digest", checked.alias("blocks"))).mapInArrow(tidy(_payloads), "page long, type string, refers_to long, digest string, payload binary")


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import join_keys, stored, table

    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    back = read(spark, path)
    back = stored(back.select("page", "type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.coalesce(F.sha1("payload"), "digest").alias("digest")))
    full = back.where("type = 'response' and page is not null").groupBy(F.col("page").alias("refers_to"), "digest").agg(F.max("n").alias("n2"))
    out = join_keys(back, full, ["refers_to", "digest"], "left")
    return out.select(
        F.col("page").alias("page_id"), F.coalesce("n", "n2").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
