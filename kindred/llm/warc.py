"""Operator 13, web pages as WARC records in seekable Zstandard bundles.

A page is a WARC/1.1 record: `response` with its HTTP head and its html in UTF-8, or `revisit` (identical payload) with the head
alone, the digest of the payload and the id of the record that has it. Of pages with equal payloads of `least` bytes or more, that of
the smallest page_id is the response. A bundle groups records into frames, each a Zstandard frame of its own with about FRAME bytes of
whole records, and ends with the seek table of the public seekable format: a skippable frame with each frame's two sizes and
checksum. The index maps record ids to bundle, frame, and offset and length in the frame, so that any record is read by decompressing one
frame. Bundles are binary values of a Parquet table in the shared folder, so a lost task's bundles appear once; export()
writes them as files, which common Zstandard and WARC tools read from front to back.

read() opens the stored bundles: what it returns of a response is computed from the bytes in the bundle, and a revisit takes
length and digest from the record that it names, which must agree with its own header.

Pages meet their first copy by an aggregate with map-side combine of (digest, least page); only digests that occur twice are joined
to the pages, as a table, so that Spark sends a small one to the pages and splits a group of very many copies in a large one.

Cases: null html is empty, null url is `urn:page:` and the id. Null page_ids come after all others: such a page revisits a page with an id, and pages
without one are responses among themselves. Repeated rows give repeated records of one id: where they are the first of their payload each is a
response. A very long page is a frame of its own. An empty table gives no bundle and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded, cut, drop_table, map_arrow

# Fixed values of the public formats.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME = 1 << 20
BUNDLE = 32 << 20  # compressed bytes
PLACE = "record_id string, page_id long, frame int, offset long, length long"
BUNDLES = f"part int, number int, n_records long, n_frames int, bundle binary, places array<struct<{PLACE.replace(' ', ':').replace(',:', ',')}>>"
RECORDS = "page_id long, record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to_id string"


@dataclass(frozen=True)
class WarcParams:
    least: int = 100  # bytes of a payload that can be revisited
    frame: int = FRAME
    bundle: int = BUNDLE
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"  # pages have none


class BundleWriter:
    """Independent frames of whole records, and the footer."""

    def __init__(self, params: WarcParams = WarcParams()):
        self.params, self.compressor = params, zstandard.ZstdCompressor(level=params.level, write_checksum=False)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.held, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame that the record is in, and its offset there."""
        if self.held and self.size + len(record) > self.params.frame:
            self._frame()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def _frame(self) -> None:
        data = b"".join(self.held)
        self.frames.append(self.compressor.compress(data))
        self.table.append((len(self.frames[-1]), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(self.frames[-1])
        self.held, self.size = [], 0

    def close(self) -> bytes:
        if self.held:
            self._frame()
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer])


class Bundle:
    """A bundle opened by its seek table."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        width = 12 if flags & CHECKSUMS else 8
        start = len(data) - 9 - count * width
        if magic != SEEKABLE or struct.unpack_from("<II", data, start - 8) != (SKIPPABLE, count * width + 9):
            raise ValueError("not a seekable bundle")
        table = np.frombuffer(data, "<u4", count * width // 4, start).reshape(count, width // 4)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes, self.checks = table[:, 1], table[:, 2] if width == 12 else None
        if self.starts[-1] != start - 8:
            raise ValueError("frames and seek table differ")
        self.count, self._open = count, zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        out = self._open.decompress(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.sizes[k]))
        if len(out) != self.sizes[k] or self.checks is not None and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return out


def _line(value: str) -> str:
    """A header's value is one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record_id(page: Column, digest: Column) -> Column:
    """A name-based id, the same for equal pages."""
    h = F.md5(F.concat(F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def build(page: int | None, name: str, url: str, html: bytes, digest: str, first: str | None, first_url: str | None, date: str) -> bytes:
    """One record; a revisit if `first` names the record that has its payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = head + (html if first is None else b"")
    lines = ["WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if first is not None:
        lines += [f"WARC-Refers-To: <{first}>", f"WARC-Refers-To-Target-URI: {_line(first_url)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-case name, payload, and end of the record at an offset."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("no record here")
    end = data.index(b"\r\n\r\n", at)
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in data[at + len(VERSION) : end].decode().split("\r\n"))}
    size = int(headers["content-length"])
    block, after = data[end + 4 : end + 4 + size], end + 4 + size
    if len(block) != size or data[after : after + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, block[block.index(b"\r\n\r\n") + 4 :], after + 4


def described(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, name, and first and first_url where the page is a revisit."""
    html = F.coalesce("html", F.lit(""))
    url = F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    copies = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min(order).alias("x"), F.count("*").alias("k")).where("k > 1")
    copies = cut(copies.select(F.col("digest").alias("d"), F.col("x.page_id").alias("first_page"), F.col("x.url").alias("first_url")), "copies")
    joined = rows.join(copies, F.col("digest") == F.col("d"), "left")
    own = F.col("d").isNull() | F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select(
        "page_id", "url", "html", "digest", record_id(F.col("page_id"), F.col("digest")).alias("name"),
        F.when(~own, record_id(F.col("first_page"), F.col("digest"))).alias("first"), F.when(~own, F.col("first_url")).alias("first_url"),
    )


def write(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """The table of bundles over all pages, each with the places of its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        bundle, places = BundleWriter(params), []
        kinds = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

        def done() -> pa.RecordBatch:
            data = bundle.close()
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(places)], pa.int64()), pa.array([len(bundle.frames)], pa.int32()), pa.array([data], pa.binary()), pa.array([places], pa.list_(kinds))]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "n_records", "n_frames", "bundle", "places"])

        for batch in batches:
            for page, url, html, digest, name, first, first_url in zip(*(c.to_pylist() if k != 2 else c.cast(pa.binary()) for k, c in enumerate(batch.columns))):
                record = build(page, name, url, html.as_py(), digest, first, first_url, params.date)
                frame, offset = bundle.add(record)
                places.append({"record_id": name, "page_id": page, "frame": frame, "offset": offset, "length": len(record)})
                if bundle.written >= params.bundle:
                    yield done()
                    number, bundle, places = number + 1, BundleWriter(params), []
        if places:
            yield done()

    bounded(pages.sparkSession)
    return cut(described(pages, params.least).mapInArrow(run, BUNDLES), "bundles")


def index(bundles: DataFrame) -> DataFrame:
    """record_id, page_id, part, number, frame, offset and length of every record; bundles aren't read for it."""
    return bundles.select("part", "number", F.explode("places").alias("x")).select("part", "number", "x.*")


def _row(headers: dict[str, str], payload: bytes) -> tuple:
    kind, strip = headers["warc-type"], lambda x: x[1:-1] if x else None
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"].split(":")[1]
    if digest != headers["warc-payload-digest"].split(":")[1]:
        raise ValueError("a payload isn't that of its digest")
    page = headers.get("x-page-id")
    return None if page is None else int(page), strip(headers["warc-record-id"]), kind, headers["warc-target-uri"], len(payload) if kind == "response" else None, digest, strip(headers.get("warc-refers-to"))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], [f.split(" ")[0] for f in RECORDS.split(", ")])


def records(bundles: DataFrame) -> DataFrame:
    """RECORDS of all bundles, frame by frame; a revisit has no length of its own."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data in batch.column(0):
            opened = Bundle(data.as_py())
            for k in range(opened.count):
                frame, at, found = opened.frame(k), 0, []
                while at < len(frame):
                    headers, payload, at = parse(frame, at)
                    found.append(_row(headers, payload))
                yield _rows(found)

    return map_arrow(bundles.select("bundle"), run, RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, record binary) of the record ids in `wanted`: of each bundle that has one, only their frames are decompressed."""
    ids = wanted.select("record_id").distinct()
    places = index(bundles).join(ids, "record_id", "left_semi").groupBy("part", "number").agg(F.collect_set(F.struct("frame", "offset", "length", "record_id")).alias("at"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data, at in zip(batch.column(0), batch.column(1).to_pylist()):
            opened, frames, out = Bundle(data.as_py()), {}, []
            for x in sorted(at, key=lambda x: (x["frame"], x["offset"])):
                if x["frame"] not in frames:
                    frames = {x["frame"]: opened.frame(x["frame"])}
                out.append(frames[x["frame"]][x["offset"] : x["offset"] + x["length"]])
            names = [x["record_id"] for x in sorted(at, key=lambda x: (x["frame"], x["offset"]))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], ["record_id", "record"])

    return map_arrow(bundles.join(places, ["part", "number"]).select("bundle", "at"), run, "record_id string, record binary")


def read(bundles: DataFrame) -> DataFrame:
    """Per page, from the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target."""
    rows = cut(records(bundles), "records")
    plain = rows.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    named = rows.where("refers_to_id IS NOT NULL").select("page_id", "record_id", "record_type", "target", F.col("payload_digest").alias("said"), "refers_to_id")
    # the responses that are revisited, once each, as a table, so that one with very many revisits can be split where it is joined
    first = rows.where("record_type = 'response'").join(named.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    first = first.groupBy("record_id").agg(F.any_value("page_id").alias("refers_to"), F.any_value("payload_bytes").alias("payload_bytes"), F.any_value("payload_digest").alias("payload_digest"))
    first = cut(first.withColumnRenamed("record_id", "r"), "revisited")
    joined = named.join(first, F.col("refers_to_id") == F.col("r"), "left")
    agreed = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit names a record that hasn't its payload")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target"]
    return plain.select(*columns).unionByName(joined.withColumn("payload_digest", agreed).select(*columns))


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file of the folder (a URI that Arrow opens) and give their names. A file is moved to its name once it
    is whole, so a task that runs again leaves one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        names = []
        for part, number, data in zip(*batch.columns):
            names.append(f"{root}/pages-{part.as_py():06d}-{number.as_py():04d}.warc.zst")
            half = f"{names[-1]}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(half) as f:
                f.write(data.as_buffer())
            system.move(half, names[-1])
        return pa.RecordBatch.from_arrays([pa.array(names)], ["file"])

    return map_arrow(bundles.select("part", "number", "bundle"), run, "file string")


def pages_as_records(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """read() of the bundles of all pages."""
    return read(write(pages, params))
