"""Operator 10: WARC archives, and a normaliser of archives that are one gzip stream.

Pages are written as WARC records.  Of the records with equal payloads of at
least ``least_bytes`` bytes, the one with the smallest key is a response and the
others revisit it.  ``normalise`` takes an archive compressed as one gzip stream,
inflates it once from front to back, writes every record again as a gzip member
of its own and beside it an index of offsets, by which single records can be read.

Contract
--------
A null payload counts as empty, a null url as an empty one.  Records with the
same payload and the same smallest key are all responses (equal rows can't be told
apart).  A null key is larger than any other.  An empty table gives no archive and no
row.  Extra columns are left out.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, lean, new_folder, only, pages, publish, staged

_BLANK = re.compile(r"[\x00-\x20\x7f]+")


def with_revisits(df: DataFrame, id_column: str, url_column: str, payload_column: str, least_bytes: int = 100, broadcast_rows: int = 200_000) -> DataFrame:
    """``(key, url, payload, payload_bytes, digest, refers_to)``.

    Digests and keys alone are grouped first.  Payloads are dealt only by a digest
    that may repeat: while at most ``broadcast_rows`` do (100 bytes each), their table goes to every
    task and no payload moves.  Beyond that payloads of ``least_bytes`` or more are joined by
    digest; smaller ones, which never revisit, are dealt by a hash of their own.
    """
    rows = only(df, key=id_column, url=url_column, payload=payload_column).withColumn("payload", F.encode(F.coalesce("payload", F.lit("")), "UTF-8"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    repeated = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1")
    repeated = staged(repeated.select(F.col("digest").alias("sought"), "first"), "digests")
    if repeated.count() <= broadcast_rows:
        marked = rows.join(F.broadcast(repeated), rows["digest"] == repeated["sought"], "left")
    else:
        may = F.when(F.col("payload_bytes") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("small-"), F.xxhash64("key", "url").cast("string")))
        rows = rows.withColumn("may", may)
        marked = rows.join(repeated, rows["may"] == repeated["sought"], "left").drop("may")
    refers = F.when((F.col("payload_bytes") >= least_bytes) & (F.col("first") < F.coalesce("key", F.lit(2**63 - 1))), F.col("first"))
    return marked.withColumn("refers_to", refers).drop("first", "sought")


def record_bytes(key: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload."""
    name = lambda k: f"urn:freshet:page:{'null' if k is None else k}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name(key)}>",
        f"WARC-Target-URI: {_BLANK.sub('%20', url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    body = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


class Deflater:
    """Writes one gzip stream."""

    def __init__(self, out, level: int = 3):
        self.out, self.machine = out, zlib.compressobj(level, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        if squeezed := self.machine.compress(data):
            self.out.write(squeezed)

    def close(self) -> None:
        self.out.write(self.machine.flush())


def inflate(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Inflate a gzip stream, or several on end, reading and holding bounded chunks."""
    machine, started = zlib.decompressobj(31), False
    while data := source.read(chunk):
        while data:
            started = True
            if out := machine.decompress(data, 4 * chunk):
                yield out
            if machine.eof:
                data, machine, started = machine.unused_data, zlib.decompressobj(31), False
            else:
                data = machine.unconsumed_tail
    if started and not machine.eof:
        raise EOFError("the archive ends within its gzip stream")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, found by Content-Length; holds one record."""
    held = bytearray()
    need, head_end = 0, -1
    searched = 0
    for chunk in chunks:
        held += chunk
        while True:
            if head_end < 0:
                head_end = held.find(b"\r\n\r\n", max(0, searched - 3))
                searched = len(held)
                if head_end < 0:
                    break
                length = re.search(rb"(?im)^content-length:\s*(\d+)", held[:head_end])
                if not held.startswith(b"WARC/") or length is None:
                    raise ValueError("not a WARC record")
                need = head_end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            head_end, searched = -1, 0
    if held:
        raise EOFError("the archive ends within a record")


def normalise(source, out, level: int = 3) -> list[tuple[int, int, str]]:
    """Rewrite every record as a gzip member of its own; (offset, length, record id) of each."""
    index, place = [], 0
    for record in split_records(inflate(source)):
        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = machine.compress(record) + machine.flush()
        out.write(member)
        name = re.search(rb"(?im)^warc-record-id:\s*<([^>]*)>", record)
        index.append((place, len(member), name[1].decode() if name else ""))
        place += len(member)
    return index


def normalise_file(source: str, target: str, level: int = 3) -> int:
    """Normalise an archive; writes ``target`` and ``target.idx``; returns the number of records."""
    store, inner = filesystem(source)
    index: list[tuple[int, int, str]] = []

    def write(out):
        with store.open_input_stream(inner, compression=None) as stream:
            index.extend(normalise(stream, out, level))

    publish(target, write)
    publish(f"{target}.idx", lambda out: out.write("".join(json.dumps(x) + "\n" for x in index).encode()))
    return len(index)


def read_records(path: str, numbers: range | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a normalised archive by its index; any of them alone."""
    store, inner = filesystem(path)
    with store.open_input_stream(f"{inner}.idx", compression=None) as lines:
        index = [json.loads(x) for x in lines.read().decode().splitlines()]
    with store.open_input_file(inner) as file:
        for i in range(len(index)) if numbers is None else numbers:
            offset, length, _ = index[i]
            yield parse_record(zlib.decompress(file.read_at(length, offset), 31))


def write_archives(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 100, level: int = 3) -> DataFrame:
    """Write and normalise archives; ``(path, records)`` of each, one for each partition."""
    rows = with_revisits(df, id_column, url_column, payload_column, least_bytes).select("key", F.coalesce("url", F.lit("")).alias("url"), "payload", "payload_bytes", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        target = f"{folder}/part-{part:06d}.warc.gz"
        whole = f"{folder}/whole/part-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def write(out):
            stream = Deflater(out, level)
            batch = first
            while batch is not None:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    stream.write(record_bytes(*row))
                batch = next(batches, None)
            stream.close()

        publish(whole, write)
        n = normalise_file(whole, target, level)
        store, inner = filesystem(whole)
        store.delete_file(inner)
        yield pa.RecordBatch.from_pydict({"path": [target], "records": [n]})

    return rows.mapInArrow(lean(run), "path string, records long")


def read_archives(spark: SparkSession, paths: list[str], id_column: str = "page_id", rows_at_once: int = 256) -> DataFrame:
    """``(<id>, url, record_type, refers_to, payload_bytes, payload_digest, payload)``.

    The length and digest of a response are taken from the payload that was read,
    those of a revisit from its headers.
    """
    import hashlib

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def key_of(name: str | None) -> int | None:
        tail = (name or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def row(headers: dict[str, str], body: bytes) -> tuple:
        kind = headers["warc-type"]
        full = kind == "response"
        return (
            key_of(headers["warc-record-id"]),
            headers["warc-target-uri"],
            kind,
            key_of(headers.get("warc-refers-to")),
            len(body) if full else int(headers["x-payload-length"]),
            hashlib.sha256(body).hexdigest() if full else headers["warc-payload-digest"].partition(":")[2],
            body if full else None,
        )

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for record in read_records(path):
                    rows.append(row(*record))
                    if len(rows) == rows_at_once:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return listed.mapInArrow(lean(run), schema).withColumnRenamed("key", id_column)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(pages(spark, sf_dir), new_folder(spark, "warc"))
    paths = sorted(r.path for r in archives.select("path").collect())  # a row for each archive
    return read_archives(spark, paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM g
""",
}
