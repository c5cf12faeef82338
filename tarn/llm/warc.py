"""A deterministic, sharded WARC writer, and its reader.

Records are range-sorted by page; every range is written by one task into gzip files that are closed
once they reach a compressed size. Each record's headers and digests are generated anew from its
payload. A file is written under a temporary name and renamed when it is whole; the manifest, a table
that Spark commits after all files are there, names what counts. A lost task writes the same bytes
under the same names again, and moves them over what is there; what failed attempts left is deleted.

Of pages with equal payloads of at least ``least`` bytes, the smallest page is a response and the
others are revisit records without payload, which refer to it.

Defined results for odd input: a null html is an empty payload (a response, as it is below ``least``);
a null url is written as ``urn:page:<id>``; rows with a null page_id are responses and never referred
to; if the smallest page comes in several equal rows, one is the response and the rest refer to it;
an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, drop, scratch_path, shuffle_partitions, stage

LEAST_BYTES = 100
ROLL_BYTES = 32 << 20
#: Where files are until they are whole, and tasks at most that read an archive.
TEMPORARY, READERS = "_temporary", 1 << 16
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "file string, records long, bytes long, sha256 string"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open_fs(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC headers, HTTP headers and, for a response, the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.UUID(hashlib.sha256(f"{page_id} {digest}".encode()).hexdigest()[:32])
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:page:{page_id}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        other = uuid.UUID(hashlib.sha256(f"{refers_to} {digest}".encode()).hexdigest()[:32])
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{other}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Gzip members, one a record, in files that close at ``roll`` compressed bytes."""

    def __init__(self, root: str, roll: int) -> None:
        self.fs, self.base = _open_fs(root)
        self.roll, self.out, self.closed = roll, None, []

    def add(self, place: int, record: bytes) -> None:
        if self.out is None:
            # The range, and the first record's place in it.
            self.name = f"part-{place >> 33:06d}-{place & (1 << 33) - 1:010d}.warc.gz"
            self.temp = f"{self.base}/{TEMPORARY}/{self.name}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            target = f"{self.base}/{self.name}"
            try:
                self.fs.move(self.temp, target)
            except OSError:
                # Some stores don't move over a file. An earlier attempt's has the same bytes, and stays.
                if self.fs.get_file_info(target).size != self.bytes:
                    raise
                self.fs.delete_file(self.temp)
            self.closed.append((self.name, self.records, self.bytes, self.sha.hexdigest()))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        rows, self.closed = self.closed, []
        kinds = (("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, kinds, strict=True)], [k for k, _ in kinds])


def write(pages: DataFrame, root: str, least: int = LEAST_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as an archive under ``root``; returns its manifest."""
    spark = pages.sparkSession
    arrow_batches(spark, 500)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # Only ids and digests move here; equal payloads are first counted where they lie.
    same = (
        rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest", "page_id")
        .agg(F.count("*").alias("n"))
    )
    first = same.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    marks = same.join(first, "digest").select("page_id", "digest", "first")
    # A mark sorts right before its page, so that the texts move once only.
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first")).unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.col("first").cast("long").alias("first"))
    )
    placed = both.repartitionByRange(shuffle_partitions(spark), "page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")
    names = ["page_id", "url", "html", "first", "revisit"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks go, and their pages learn whether they are revisits, and of which page."""
        mark, seen = None, False
        for batch in batches:
            keep, to, revisit = [], [], []
            for i, (page, digest, kind, first) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True)):
                if kind == 0:
                    mark, seen = (page, digest, first), False
                    continue
                to.append(mark[2] if mark and mark[:2] == (page, digest) else None)
                revisit.append(to[-1] is not None and (page != to[-1] or seen))
                keep.append(i)
                seen = True
            rows = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(3), rows.column(4), pa.array(to, pa.int64()), pa.array(revisit, pa.bool_())], names)

    kind = rows.schema["page_id"].dataType.simpleString()
    placed = placed.mapInArrow(settle, f"page_id {kind}, url string, html string, first long, revisit boolean")
    # Rows get their places for good before files are named: a task that runs again finds the same rows.
    placed = stage(placed.withColumn("place", F.monotonically_increasing_id()), "warc_sorted")
    store, base = _open_fs(root)
    store.create_dir(f"{base}/{TEMPORARY}", recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = None, None
        for batch in batches:
            for place, page, url, text, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or place != last + 1:
                    if out is not None:
                        out.close()
                        yield out.manifest()
                    out = _Roller(root, roll)
                out.add(place, record_bytes(page, url, text.encode(), first, revisit))
                last = place
        if out is not None:
            out.close()
            yield out.manifest()

    sorted_rows = placed.select("place", *names)
    manifest = stage(sorted_rows.mapInArrow(put, MANIFEST), "warc_manifest")
    store.delete_dir(f"{base}/{TEMPORARY}")
    drop(placed)
    return manifest


def parse(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = data.read(int(head["content-length"]))
        if "sha256:" + hashlib.sha256(block).hexdigest() != head["warc-block-digest"]:
            raise ValueError("a block does not match its digest")
        yield head, block


def read(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The archive's records, from the files that the manifest names; digests are computed again."""
    # A number of its own keeps adaptive execution from reading all files in one task, small as their list is.
    files = manifest.repartition(min(max(manifest.count(), 1), READERS), "file")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

        store, base = _open_fs(root)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as data:
                    for head, block in parse(data):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = head["warc-type"] == "revisit"
                        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["Content-Length"])):
                            raise ValueError("a payload does not match its digest")
                        page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((page and int(page), int(fields["Content-Length"]), digest, head["warc-type"], to and int(to)))
                        if len(rows) == 5000:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    return files.select("file").mapInArrow(get, PAGES)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the pages as an archive in the shared folder and read it back: a row per page."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    return read(spark, root, write(pages, root, least, roll))
