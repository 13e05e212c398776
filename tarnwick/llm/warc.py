"""Operator 4, WARC: seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of bounded size; a bundle ends with a seek table in a skippable
frame, and its index maps record ids to (frame, offset in the frame).  Bundles are rows of a table in the shared
folder, written by Spark's committer, so a lost executor leaves no half-written archive.  ``export`` puts them into
plain files where a folder is mounted.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Magic numbers and layout of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and of frames in a bundle, at which the next one begins.
FRAME, BUNDLE = 512 << 10, 8 << 20
#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
#: Duplicate digests up to which their table is broadcast (about 60 bytes each).
BROADCAST_DIGESTS = 200_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BUNDLES = "bundle_id string, archive binary, n_records long, index array<struct<record_id:long,frame:int,offset:long,length:long>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_urn(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response it repeats."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Page-Id: {page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(head["Content-Length"])
    block = data[body:end]
    return head, block[block.index(b"\r\n\r\n") + 4 :], end + 4


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed, and their size before) followed by the seek table."""
    table = b"".join(struct.pack("<II", len(c), n) for c, n in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(c for c, _ in frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", archive[-9 - 8 * count : -9]):
        out.append((at, packed, size))
        at += packed
    return out


def open_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=max(1, size))


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): which record each page becomes.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more the largest page_id is the response.  Null html is the empty
    payload; rows that repeat the response's page_id are responses too; null ids never refer.  An empty table gives an
    empty table.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= LEAST_REVISIT
    twice = materialize(rows.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper"), "repeated")
    side = F.broadcast(twice) if twice.count() <= BROADCAST_DIGESTS else twice
    joined = rows.join(side, "digest", "left")
    refers = F.when(large & F.col("page_id").isNotNull() & (F.col("keeper") != F.col("page_id")), F.col("keeper"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def bundles(planned: DataFrame, frame: int = FRAME, bundle: int = BUNDLE, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Bundles of the planned records, one row each."""
    bounded_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=level)
        part, serial = TaskContext.get().partitionId(), 0
        frames: list[tuple[bytes, int]] = []
        index: list[dict] = []
        open_: list[bytes] = []
        size = done = 0

        def close():
            nonlocal size, done
            if open_:
                frames.append((zip_.compress(b"".join(open_)), size))
                done += len(frames[-1][0])
                open_.clear()
                size = 0

        def emit():
            nonlocal serial, done
            kind = pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            out = pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{serial:06d}"]), pa.array([seal(frames)], pa.binary()), pa.array([len(index)], pa.int64()), pa.array([index], kind)], names=["bundle_id", "archive", "n_records", "index"])
            serial, done = serial + 1, 0
            frames.clear()
            index.clear()
            return out

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                page = page_id.as_py()
                raw = record(-1 if page is None else page, url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py(), date)
                index.append({"record_id": page, "frame": len(frames), "offset": size, "length": len(raw)})
                open_.append(raw)
                size += len(raw)
                if size >= frame:
                    close()
                    if done >= bundle:
                        yield emit()
        close()
        if frames:
            yield emit()

    return planned.mapInArrow(run, BUNDLES)


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, frame by frame; ``payload_digest`` is checked against the payload read.

    A revisit has no payload of its own, so its ``payload`` is null, its length what its header claims (see ``resolve``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive"), batch.column("index"), strict=True):
                data = archive.as_buffer().to_pybytes()
                entries = index.as_py()
                at = 0
                for number, frame in enumerate(seek_table(data)):
                    plain = open_frame(data, frame)
                    rows = []
                    while at < len(entries) and entries[at]["frame"] == number:
                        rows.append(_row(plain, entries[at], payloads))
                        at += 1
                    yield _records(rows)

    return bundles.select("archive", "index").mapInArrow(run, RECORDS)


def lookup(bundles: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some ids: only the frames that hold them are opened."""
    at = bundles.select("bundle_id", F.inline("index")).join(ids.select(F.col(id_col).alias("record_id")).distinct(), "record_id")
    wanted = at.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("index"))  # a bundle's own records: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive"), batch.column("index"), strict=True):
                data, opened = archive.as_buffer().to_pybytes(), {}
                table = seek_table(data)
                for e in sorted(index.as_py(), key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] not in opened:
                        opened = {e["frame"]: open_frame(data, table[e["frame"]])}
                    yield _records([_row(opened[e["frame"]], e, True)])

    return bundles.select("bundle_id", "archive").join(wanted, "bundle_id").select("archive", "index").mapInArrow(run, RECORDS)


def _row(plain: bytes, entry: dict, payloads: bool) -> tuple:
    head, payload, end = parse(plain, entry["offset"])
    if end != entry["offset"] + entry["length"]:
        raise ValueError("a record ends elsewhere than its index says")
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    first = head["WARC-Type"] == "response"
    refers = head.get("X-Refers-To-Page")
    if first and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of record {entry['record_id']} is not that of its digest")
    length = len(payload) if first else int(head["X-Payload-Length"])
    return entry["record_id"], length, digest, head["WARC-Type"], int(refers) if refers else None, head.get("WARC-Target-URI"), payload if first and payloads else None


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def export(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as ``<bundle_id>.warc.zst`` into a mounted folder, under its final name only when complete."""

    def put(rows):
        for r in rows:
            path = os.path.join(folder, r["bundle_id"] + ".warc.zst")
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r["archive"])
            os.replace(part, path)

    bundles.select("bundle_id", "archive").foreachPartition(put)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` (page_id, payload_bytes, payload_digest, record_type, refers_to), each revisit held against the
    response it refers to: one that has no response of its digest and length is an error.

    ``records`` is read twice, so it should be a stored table.  An empty table gives an empty table.
    """
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    few = asked.count()
    side = F.broadcast if few <= BROADCAST_DIGESTS else (lambda x: x)
    found = records.where("record_type = 'response'").join(side(asked), ["page_id", "payload_digest"], "left_semi")
    found = found.groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("held")).select(F.col("page_id").alias("refers_to"), "payload_digest", "held")
    joined = records.join(side(found), ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string"))).cast("long")
    right = (F.col("record_type") == "response") | (F.col("held") == F.col("payload_bytes"))
    size = F.when(right, F.col("payload_bytes")).otherwise(lost)
    return joined.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write every page to bundles in the shared folder and report what the archives hold: digests and lengths are those
    of the payloads read back, a revisit's those of its response.

    Null html is the empty payload.  Repeated rows and rows of a null id each give a record; payloads of any size are
    one record.  Other columns are ignored; an empty table gives an empty table.
    """
    stored = materialize(bundles(plan(pages)), "warc")
    listed = read(stored, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return resolve(materialize(listed, "warc-records"))
