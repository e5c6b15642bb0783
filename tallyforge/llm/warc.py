"""WARC archives with segmented records: written from pages and read back whole.

Writing. Each page is a record of WARC 1.1. A response's block is an HTTP header and the payload in chunked transfer
framing. A block of more than ``segment`` bytes is cut: the first part is the response record (WARC-Segment-Number 1),
the others are continuation records that name its WARC-Record-ID in WARC-Segment-Origin-ID, and the last one has
WARC-Segment-Total-Length. A page whose payload another page's response holds is a revisit record (identical payload
digest) without a payload.

Reading. Archives are read record by record. Responses that are whole are decoded at once; parts of segmented ones are
grouped by origin, ordered by segment number, checked to be all there and to have the stated total length, joined, and
then decoded. A missing, doubled or short part makes the record ``broken``, with a null payload.

Of equal payloads (empty ones too) of at least ``least`` bytes, the page with the largest page_id is the response and
the others refer to it; rows that share that page_id and payload are all responses. A null payload is empty; a null
page_id sorts below all others. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

CHUNK = 8192
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, kind string, page_id string, digest string, refers_to string, origin string, number int, total long, block binary"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes | None:
    """The content of chunked transfer framing; extensions and trailers are skipped. None if it is not complete."""
    out, at = [], 0
    while (line := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        end = line + 2 + size
        if data[end : end + 2] != b"\r\n":
            return None
        out.append(data[line + 2 : end])
        at = end + 2
    return None


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return dechunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


#: Pages have no time of their own; a fixed one makes archives the same in every run.
DATE = "2024-01-01T00:00:00Z"


def _header(kind: str, identity: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def records(page: dict, segment: int, place: tuple[int, int]) -> Iterator[bytes]:
    """The records of one page: {page_id, url, html, digest, refers_to, refers_url}; place: archive and number of the page in it."""
    payload = page["html"] or b""
    number = "" if page["page_id"] is None else page["page_id"]
    uri, of = ("".join((page[u] or "urn:page").split()) or "urn:page" for u in ("url", "refers_url"))
    about = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{page['digest']}", "X_Page_ID": number}
    if page["refers_to"] is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _header("revisit", record_id("revisit", number, *place), head, WARC_Profile=REVISIT, WARC_Refers_To_Target_URI=of, WARC_Refers_To_Date=DATE, X_Refers_To_Page_ID=page["refers_to"], **about)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = record_id("page", number, page["digest"], *place)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _header("response", first, block, Content_Type="application/http;msgtype=response", **about)
        return
    for k, part in enumerate(parts, 1):
        total = len(block) if k == len(parts) else None
        if k == 1:
            yield _header("response", first, part, Content_Type="application/http;msgtype=response", WARC_Segment_Number=k, **about)
        else:
            yield _header("continuation", record_id(first, k), part, WARC_Segment_Origin_ID=first, WARC_Segment_Number=k, WARC_Segment_Total_Length=total, WARC_Target_URI=uri)


def digested(html: Column) -> Column:
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def write(pages: DataFrame, folder: str, least: int = 0, segment: int = 16384, level: int = 1) -> DataFrame:
    """Write archives of ``pages`` (each record a gzip member) into ``folder``; (archive, n_records) of each."""
    work.make_dir(folder)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digested(F.col("html")).alias("sha1"))
    large = F.coalesce(F.octet_length("html"), F.lit(0)) >= least
    last = read.where(large).groupBy("sha1").agg(F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    last = work.written(last, "payloads")
    joined = read.join(last, "sha1", "left")
    revisit = large & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    ready = joined.select("page_id", "url", F.when(~revisit, F.col("html").cast("binary")).alias("html"), "sha1", F.when(revisit, F.col("last")).alias("refers_to"), F.when(revisit, F.col("refers_url")).alias("refers_url"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        k, n, seen = context.partitionId(), 0, 0
        fs, base = work.filesystem(folder)
        temporary, final = f"{base}/pages-{k:06d}.{context.taskAttemptId()}.tmp", f"{base}/pages-{k:06d}.warc.gz"
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for begin in range(0, len(batch), 256):
                    for page in batch.slice(begin, 256).to_pylist():
                        page["digest"] = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
                        seen += 1
                        for record in records(page, segment, (k, seen)):
                            squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                            out.write(squeeze.compress(record) + squeeze.flush())
                            n += 1
        work.put_in_place(fs, temporary, final)
        yield pa.record_batch([pa.array([final.rsplit("/", 1)[1]]), pa.array([n], pa.int64())], ["archive", "n_records"])

    return work.written(ready.mapInArrow(archive, "archive string, n_records long"), "archives")


class _Members:
    """Bytes of a gzip file of many members, read in order."""

    def __init__(self, file: pa.NativeFile, step: int = 1 << 18):
        self.file, self.step, self.raw, self.text, self.inflate = file, step, b"", bytearray(), None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(self.step)
            if not self.raw:
                return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.text += self.inflate.decompress(self.raw)
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        else:
            self.raw = b""
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.text.find(mark)) < 0:
            if not self._more():
                return None
        out = bytes(self.text[:at])
        del self.text[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.text) < n and self._more():
            pass
        out = bytes(self.text[:n])
        del self.text[:n]
        return out


def parse(file: pa.NativeFile) -> Iterator[dict]:
    """The records of an archive: header fields by lower-case name, and the block."""
    source = _Members(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        block = source.exactly(int(fields.get("content-length", 0)))
        source.exactly(4)
        yield fields | {"block": block}


def read_records(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """One row per WARC record of the archives."""
    n = max(1, archives.count())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, base = work.filesystem(folder)
                source = pa.memory_map(f"{base}/{name}") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_stream(f"{base}/{name}", compression=None)
                out, size = [], 0
                with source:
                    for r in parse(source):
                        whole = r["warc-type"] == "revisit"
                        number, total = r.get("warc-segment-number"), r.get("warc-segment-total-length")
                        out.append({"record_id": r["warc-record-id"], "kind": r["warc-type"], "page_id": r.get("x-page-id"), "digest": (r.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "refers_to": r.get("x-refers-to-page-id"), "origin": r.get("warc-segment-origin-id"), "number": number and int(number), "total": total and int(total), "block": None if whole else r["block"]})
                        size += len(r["block"])
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return archives.select("archive").repartition(n, "archive").mapInArrow(rows, RECORD)


def read(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """One row per page: page_id, record_type, payload_digest, payload_bytes, refers_to, broken.

    Records are parsed once and written; blocks of unsegmented responses are decoded where they are read, and only the
    parts of segmented ones are moved, each to its origin's task.
    """
    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = (b"".join(x) if isinstance(x, list) else x for x in batch.column("block").to_pylist())
            blocks = [x and payload_of(x) for x in whole]
            found = {"payload_bytes": pa.array([None if x is None else len(x) for x in blocks], pa.int64()), "computed": pa.array([None if x is None else base32_sha1(x) for x in blocks], pa.string())}
            at = batch.schema.get_field_index("block")
            yield pa.record_batch([*(c for k, c in enumerate(batch.columns) if k != at), *found.values()], [*(x for k, x in enumerate(batch.schema.names) if k != at), *found])

    raw = read_records(spark, folder, archives)
    part = F.col("number").isNotNull()
    raw = work.written(raw.withColumn("part", part), "warc-records", compression="zstd")
    key = F.coalesce("origin", "record_id")
    held = raw.where("part").groupBy(key.alias("record_id")).agg(
        F.max(F.when(F.col("number") == 1, F.struct("page_id", "digest"))).alias("first"),
        F.max("total").alias("total"), F.max("number").alias("last"), F.count("*").alias("n"), F.count_distinct("number").alias("different"), F.sum(F.octet_length("block")).alias("size"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
    )
    complete = (F.col("n") == F.col("last")) & (F.col("different") == F.col("n")) & (F.col("size") == F.col("total"))
    held = held.select("first.page_id", "first.digest", F.when(complete, F.col("parts.block")).alias("block"))  # joined where it is decoded
    single = raw.where("not part and kind = 'response'").select("page_id", "digest", "block")
    schema = "page_id string, digest string, payload_bytes long, computed string"
    responses = single.mapInArrow(payloads, schema).unionByName(held.mapInArrow(payloads, schema))
    responses = responses.withColumn("broken", F.col("computed").isNull() | ~F.col("computed").eqNullSafe(F.col("digest")))
    responses = work.written(responses, "responses")
    revisits = raw.where("kind = 'revisit'").select("page_id", "digest", "refers_to")
    number = lambda c: F.expr(f"try_cast({c} as long)")
    sizes = responses.groupBy("page_id", "digest").agg(F.min("payload_bytes").alias("payload_bytes"), F.max("broken").alias("broken"))
    of = sizes.select(F.col("page_id").alias("refers_to"), "digest", "payload_bytes", "broken")
    again = revisits.join(of, ["refers_to", "digest"], "left").select(number("page_id").alias("page_id"), F.lit("revisit").alias("record_type"), F.col("digest").alias("payload_digest"), "payload_bytes", number("refers_to").alias("refers_to"), F.coalesce("broken", F.lit(True)).alias("broken"))
    whole = responses.select(number("page_id").alias("page_id"), F.lit("response").alias("record_type"), F.coalesce("computed", "digest").alias("payload_digest"), "payload_bytes", F.lit(None).cast("long").alias("refers_to"), "broken")
    return whole.unionByName(again)


def archived(pages: DataFrame, least: int = 0, segment: int = 16384) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every page back."""
    folder = work.shared_dir(pages.sparkSession, "warc")
    return read(pages.sparkSession, folder, write(pages, folder, least, segment))
