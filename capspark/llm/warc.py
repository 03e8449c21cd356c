"""WARC archives as a chunked record table.

Writing: every record becomes rows of (record id, chunk number, bytes); an oversized payload is a
`response` record and `continuation` records (WARC/1.1 segmentation) of at most CHUNK bytes each,
made by Spark's text writer into .gz archives. Reading: each archive is streamed line by line, and
rows of (record id, chunk number, chunk, digest so far) come out; no record is ever whole in
memory. Digests are carried from chunk to chunk, so the last chunk has the payload's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches, new_path, written

CHUNK = 1 << 16
LEAST_REVISIT = 100
_END = "\r\n"


def revisits(payloads: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """payloads: id, bytes, digest. Returns (id, digest, refers_to) of the records that repeat a payload of
    at least `least` bytes that a record of a smaller id has. Rows of the smallest id are never
    revisits, also when that id comes twice."""
    firsts = payloads.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    repeats = payloads.filter(F.col("bytes") >= least).join(firsts.select("digest", "refers_to"), "digest")
    return repeats.filter(F.col("id") > F.col("refers_to")).select("id", "digest", "refers_to").distinct()


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records: id, url, payload (binary), refers_to. Returns the lines of the archive: record id,
    chunk number, and the segment with its header as raw bytes in a string."""
    whole = F.octet_length("payload")
    parts = F.greatest(F.lit(1), F.ceil(whole / F.lit(chunk))).cast("int")
    rows = records.withColumn("record", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.monotonically_increasing_id(), F.lit(">")))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", whole)
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    rows = rows.withColumn("parts", F.when(F.col("refers_to").isNull(), parts).otherwise(1)).withColumn("stored", stored)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk_no"))
    piece = F.substring(F.col("stored"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    first, cut = F.col("chunk_no") == 0, F.col("parts") > 1
    segment = (F.col("chunk_no") + 1).cast("string")

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_END))

    record_id = F.when(first, F.col("record")).otherwise(F.concat(F.substring_index("record", ">", 1), F.lit("#"), segment, F.lit(">")))
    kind = F.when(~first, F.lit("continuation")).when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", "")
    header = F.concat(
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id),
        F.when(first & F.col("id").isNotNull(), line("WARC-Page-ID", F.col("id").cast("string"))).otherwise(""),
        F.when(first, line("WARC-Target-URI", url)).otherwise(""),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(""),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(""),
        F.when(cut, line("WARC-Segment-Number", segment)).otherwise(""),
        F.when(cut & ~first, line("WARC-Segment-Origin-ID", F.col("record"))).otherwise(""),
        F.when(cut & (F.col("chunk_no") == F.col("parts") - 1), line("WARC-Segment-Total-Length", F.col("length").cast("string"))).otherwise(""),
        line("Content-Length", F.octet_length(piece).cast("string")),
        F.lit(_END),
    )
    return rows.select("record", "chunk_no", F.concat(header.cast("binary"), piece).alias("segment"))


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """One .gz archive for each partition of records, without a shuffle. Spark's writer ends every
    segment with the two line ends that WARC asks for, and commits only the files of whole tasks."""
    lines = chunk_rows(records, chunk).select(F.col("segment").cast("string").alias("value"))
    lines.write.option("lineSep", _END * 2).option("compression", "gzip").text(path)


_CHUNKS = "record string, page_id long, record_type string, refers_to long, chunk_no int, chunk binary, total long, digest string, last boolean"


class _Parser:
    """Turns lines (bytes without their \\n) of one archive into chunk rows, which it adds to `rows`."""

    def __init__(self, with_bytes: bool, chunk: int, rows: list[tuple]):
        self.with_bytes, self.chunk, self.rows = with_bytes, chunk, rows
        self.need = 0  # bytes of the open segment still to come
        self.headers: dict[str, str] | None = None  # of the header that is being read
        self.open: dict | None = None
        self.buffer = bytearray()

    def _emit(self, last: bool) -> None:
        o, data = self.open, bytes(self.buffer)
        self.buffer.clear()
        o["sha"].update(data)
        o["total"] += len(data)
        h = o["headers"]
        page, refers = h.get("warc-page-id"), h.get("warc-refers-to-page-id")
        if h["warc-type"] == "revisit":
            digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
        else:
            digest = o["sha"].copy().hexdigest()
        if last or self.with_bytes:
            self.rows.append((h["warc-record-id"], int(page) if page else None, h["warc-type"], int(refers) if refers else None, o["no"], data if self.with_bytes else None, o["total"], digest, last))
        o["no"] += 1

    def close(self) -> None:
        if self.open is not None:
            self._emit(True)
            self.open = None

    def _payload(self, data: bytes) -> None:
        self.buffer += data
        self.need -= len(data)
        while len(self.buffer) > self.chunk:
            rest = self.buffer[self.chunk :]
            del self.buffer[self.chunk :]
            self._emit(False)
            self.buffer = bytearray(rest)

    def line(self, data: bytes) -> None:
        if self.need > 0:
            self._payload((data + b"\n")[: self.need])
            return
        if self.headers is None:
            if data.startswith(b"WARC/"):
                self.headers = {}
            return
        text = data.decode("utf-8", "replace").rstrip("\r")
        if text:
            name, _, value = text.partition(":")
            self.headers[name.strip().lower()] = value.strip()
            return
        h, self.headers = self.headers, None
        self.need = int(h.get("content-length", 0))
        if h.get("warc-type") != "continuation" or self.open is None:
            self.close()
            self.open = {"headers": h, "sha": hashlib.sha256(), "total": 0, "no": 0}
        elif self.buffer:
            self._emit(False)


def _parse(batches: Iterator[pa.RecordBatch], with_bytes: bool, chunk: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task reads several small archives one after the other, also within a batch: each has a
    parser of its own, and all share the rows that are still to go out."""
    rows: list[tuple] = []
    parser, at = _Parser(with_bytes, chunk, rows), None

    def out() -> pa.RecordBatch:
        ready = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        rows.clear()
        return ready

    for batch in batches:
        for data, archive in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if archive != at:
                parser.close()
                parser, at = _Parser(with_bytes, chunk, rows), archive
            parser.line(data.as_py())
            if len(rows) >= 64 and with_bytes or len(rows) >= 4096:
                yield out()
        if rows:
            yield out()
    parser.close()
    if rows:
        yield out()


def read_chunks(spark: SparkSession, path: str, with_bytes: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives at path: record, page_id, record_type, refers_to,
    chunk_no, chunk, total (payload bytes so far), digest (SHA-256 of them, of a revisit the one it
    states), last. Without with_bytes only each record's last row comes, and no bytes. A .gz file is
    one task's stream; memory is bounded by a chunk and by the longest line of the archive."""
    bound_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"), F.xxhash64("_metadata.file_path").alias("archive"))
    schema = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("total", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])
    return lines.mapInArrow(lambda it: _parse(it, with_bytes, chunk, schema), _CHUNKS)


def archive_pages(pages: DataFrame, path: str | None = None, chunk: int = CHUNK) -> str:
    """Write a record for every row of pages (page_id, url, html) and return the archives' path.

    A null html is an empty payload, a null url an empty target; a null page_id is written without
    a page id and never referred to. Repeated rows are records of their own. Other columns are left
    out. An empty table gives no records.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    base = pages.select(F.col("page_id").alias("id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    again = written(revisits(base.select("id", F.octet_length("payload").alias("bytes"), "digest")), "revisits")
    write_archives(base.join(again, ["id", "digest"], "left"), path, chunk)
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, read from the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A revisit stores no payload: its length is that of the record it
    refers to, whose digest must be the one it states."""
    last = written(read_chunks(spark, path, with_bytes=False), "records").filter("last")
    whole = last.filter("record_type = 'response'").select("page_id", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    again = last.filter("record_type = 'revisit'").select("page_id", "digest", "record_type", "refers_to")
    firsts = whole.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").join(again.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi").distinct()
    return whole.unionByName(again.join(firsts, ["refers_to", "digest"]).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
