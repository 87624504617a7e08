"""WARC archives as a chunked record table.

Payloads travel as rows (record, chunk number, bytes): a task that writes or
reads an archive holds one chunk at a time and carries the record's SHA-1 from
chunk to chunk, so that no record is ever held whole on the Python side. Each
record is a gzip member of its own. Of records with equal payloads one is a
response, the others revisit it.

A task writes a file under a name of its own and reports it in its result row;
the table of those rows is the archive's manifest. Files of failed or repeated
attempts are in no manifest and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, quoted, shared_dir, utf8_bytes

#: Bytes of payload in one row.
CHUNK = 256 << 10
#: Bytes read at once from an archive.
READ = 1 << 20
RECORDS = "page_id {0}, url string, sha1 binary, size long, refers_to {0}, chunk int, data binary"
CHUNKS = "record_id string, page_id string, record_type string, refers_to string, payload_digest string, payload_size long, chunk int, n_bytes long, digest_so_far string, data binary"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Rows of RECORDS: one per chunk of a response, one without data per revisit.

    The response of a group of equal payloads is the row with the largest id
    (each such row, if ids repeat; a null id counts as the smallest). A null
    payload is an empty one; ids keep their type. What is a copy is decided on
    ids, digests and sizes alone, and the table of copied payloads is written
    out, so that Spark broadcasts it if it is small.
    """
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("url"), utf8_bytes(payload_col).alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    # a row per group of copies, and only those groups; a hot group is one row here
    first = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialize(first, "warc-copies")
    known = rows.join(first, ["sha1", "size"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    body = F.when(refers.isNull(), F.col("payload"))
    last = F.coalesce(F.floor((F.octet_length(body) - 1) / chunk), F.lit(0)).cast("int")
    return known.withColumn("refers_to", refers).select(
        "page_id", "url", "sha1", "size", "refers_to", body.alias("body"), F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("chunk")
    ).select("page_id", "url", "sha1", "size", "refers_to", "chunk", F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))


def header(fields: list[tuple[str, object]], content_length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {content_length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _one_line(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " ") or "urn:none"


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write chunk rows as .warc.gz files under ``path``; returns the manifest (file, n_records).

    A record's chunk rows stand one after the other in a partition, as
    :func:`chunk_rows` makes them.
    """

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs as pafs

        name, out, packer, n, left = f"{path}/{uuid.uuid4().hex}.warc.gz", None, None, 0, 0
        for batch in batches:
            for r in zip(*(c.to_pylist() if i < 6 else c for i, c in enumerate(batch.columns)), strict=True):
                page, url, sha1, size, refers, chunk, data = r
                if out is None:
                    fs, own = pafs.FileSystem.from_uri(name)
                    fs.create_dir(own.rpartition("/")[0])
                    out = fs.open_output_stream(own, compression=None)
                if chunk == 0:
                    fields = [
                        ("WARC-Type", "response" if refers is None else "revisit"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{n}')}>"),
                        ("WARC-Date", "2000-01-01T00:00:00Z"),
                        ("WARC-Target-URI", _one_line(url)),
                        ("WARC-Payload-Digest", f"sha1:{base32_sha1(sha1)}"),
                        ("WARC-Profile", None if refers is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("X-Page-Id", None if page is None else quote(str(page))),
                        ("X-Payload-Length", size),
                        ("X-Refers-To-Page-Id", None if refers is None else quote(str(refers))),
                    ]
                    packer, n, left, so_far = zlib.compressobj(1, wbits=31), n + 1, size if refers is None else 0, hashlib.sha1()
                    out.write(packer.compress(header(fields, left)))
                if left:
                    view = data.as_buffer()
                    out.write(packer.compress(view))
                    so_far.update(view)
                    left -= view.size
                    if not left and so_far.digest() != sha1:
                        raise ValueError(f"page {page}: the chunks do not have the payload's digest")
                if not left:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

    return materialize(records.mapInArrow(write, "file string, n_records long"), "manifest")


class _Inflated:
    """Reads the members of a gzip file one after the other, a bounded piece at a time."""

    def __init__(self, raw):
        self.raw, self.unpack, self.rest, self.ready = raw, zlib.decompressobj(wbits=31), b"", bytearray()

    def more(self) -> bool:
        if self.unpack.eof:
            self.rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(wbits=31)
        fed = self.rest or self.raw.read(READ)
        if not fed:
            return False
        self.ready += self.unpack.decompress(fed, READ)
        self.rest = b"" if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        out = bytes(self.ready[:n])
        if len(out) < n:
            raise ValueError("the archive ends inside a record")
        del self.ready[:n]
        return out


def records_of(raw, chunk: int = CHUNK) -> Iterator[tuple]:
    """Tuples of CHUNKS from one open archive file; digests are checked."""
    stream = _Inflated(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        field = dict(x.split(": ", 1) for x in lines[1:])
        left, i, sha1 = int(field["Content-Length"]), 0, hashlib.sha1()
        digest, size, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(field["X-Payload-Length"]), field["WARC-Type"]
        page, refers = (unquote(field[k]) if k in field else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
        same = (field["WARC-Record-ID"], page, kind, refers, digest, size)
        while True:
            data = stream.take(min(chunk, left))
            sha1.update(data)
            left -= len(data)
            if not left and kind == "response" and base32_sha1(sha1.digest()) != digest:
                raise ValueError(f"{same[0]}: the payload does not have its digest")
            yield (*same, i, len(data), base32_sha1(sha1.digest()), data)
            i += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"{same[0]}: no end of record")


def read_chunks(manifest: DataFrame, *, with_data: bool = True) -> DataFrame:
    """The chunk table (CHUNKS) of all archives that ``manifest`` names.

    ``digest_so_far`` is the base32 SHA-1 of the record's payload up to and
    with the chunk; ``data`` is left null where only digests are wanted. Ids are
    text, as in the archive.
    """

    def read(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs as pafs

        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_size", pa.int64()), ("chunk", pa.int32()), ("n_bytes", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])
        held: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for files in batches:
            for name in files.column(0).to_pylist():
                fs, own = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(own, compression=None) as raw:
                    size = 0
                    for row in records_of(raw):
                        held.append(row if with_data else (*row[:-1], None))
                        size += row[7] * with_data + 200
                        if size > 4 * READ:
                            yield batch()
                            held, size = [], 0
        if held:
            yield batch()

    files = manifest.select("file")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "file").mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its chunks: nothing but sizes and digests is gathered.

    payload_bytes and payload_digest come from the bytes read for responses and
    from the record's header for revisits.
    """
    return (
        chunks.groupBy("record_id")
        .agg(*(F.first(c).alias(c) for c in ("page_id", "record_type", "refers_to", "payload_digest", "payload_size")), F.sum("n_bytes").alias("read"), F.max_by("digest_so_far", "chunk").alias("whole"))
        .select(
            "page_id",
            F.when(F.col("record_type") == "response", F.col("read")).otherwise(F.col("payload_size")).alias("payload_bytes"),
            F.when(F.col("record_type") == "response", F.col("whole")).otherwise(F.col("payload_digest")).alias("payload_digest"),
            "record_type",
            "refers_to",
            "record_id",
        )
    )


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that Spark takes it to be on, in the form pyarrow knows."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()
    scheme, _, rest = full.partition(":")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return full.replace("s3a://", "s3://", 1) if scheme == "s3a" else full


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as WARC archives (into the shared folder by default); returns the manifest.

    A file system that pyarrow can't open is an error, never another place.
    """
    return write_archives(chunk_rows(pages, **columns), _uri(pages.sparkSession, path or shared_dir(pages.sparkSession, "warc")))
