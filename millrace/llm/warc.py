"""WARC archives: writing, and a salvage reader that survives damage.

Writing: each task writes its records to archives of its own in the shared folder, a new one after ``roll`` bytes. A
file gets its name in the table of archives only when its task has ended well, so what a lost task left behind is never
read. Records are gzip members of their own, or plain.

Reading: the salvage reader walks an archive with a bounded window. Each record must pass its checks: a version line,
headers that parse, a Content-Length within the archive, the record's closing blank lines, the member's CRC, and the
block or payload digest if the record states one. After a failed check it searches for the next gzip member or version
line behind the bad one, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path, ship, table

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
CHUNK = 1 << 20


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    """Bytes from start to end that gave no record, and the check that failed."""

    start: int
    end: int
    reason: str


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes, zipped: bool = True) -> bytes:
    """One record: version line, headers (Content-Length is added), block, two line ends."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    data = head.encode() + block + b"\r\n\r\n"
    if not zipped:
        return data
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Window:
    """A file's bytes by absolute position; keeps what lies behind ``low`` only."""

    def __init__(self, read):
        self.read, self.data, self.low, self.over = read, bytearray(), 0, False

    def reach(self, end: int) -> bool:
        """Have the bytes before ``end``; False if the file ends earlier."""
        while not self.over and self.low + len(self.data) < end:
            more = self.read(max(CHUNK, end - self.low - len(self.data)))
            self.over = not more
            self.data += more
        return self.low + len(self.data) >= end

    def get(self, start: int, end: int) -> bytes:
        self.reach(end)
        return bytes(self.data[start - self.low : end - self.low])

    def find(self, what: re.Pattern, start: int, most: int | None = None) -> int | None:
        """Where ``what`` (at most 8 bytes) next begins, or None."""
        while True:
            if m := what.search(self.data, start - self.low):
                return self.low + m.start()
            start = max(start, self.low + len(self.data) - 8)
            if (most is not None and start > most) or not self.reach(self.low + len(self.data) + 1):
                return None

    def drop(self, before: int) -> None:
        if before - self.low > CHUNK:
            del self.data[: before - self.low]
            self.low = before


class Broken(Exception):
    pass


NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def _member(window: Window, at: int, most: int) -> tuple[bytes, int]:
    """The text of the gzip member at ``at`` and where it ends; its CRC and length are checked."""
    z, out, here = zlib.decompressobj(31), bytearray(), at
    while not z.eof:
        data = window.get(here, here + CHUNK)
        if not data:
            raise Broken("member is cut off")
        try:
            out += z.decompress(data, most - len(out) + 1)
            while z.unconsumed_tail and not z.eof:
                if len(out) > most:
                    raise Broken("record is larger than allowed")
                out += z.decompress(z.unconsumed_tail, most - len(out) + 1)
        except zlib.error as e:
            raise Broken(f"member: {e}"[:60]) from None
        if len(out) > most:
            raise Broken("record is larger than allowed")
        here += len(data)
    return bytes(out), here - len(z.unused_data)


def _parse(data: bytes, start: int, end: int | None) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the beginning of ``data``."""
    head = data.find(b"\r\n\r\n")
    if head < 0:
        raise Broken("headers don't end")
    lines = data[:head].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d+", lines[0]):
        raise Broken("version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Broken("content length")
    return headers, data, head + 4


def _checked(headers: dict[str, str], block: bytes, tail: bytes) -> None:
    if tail != b"\r\n\r\n":
        raise Broken("record's end")
    for name in ("warc-block-digest", "warc-payload-digest"):
        said = headers.get(name, "")
        # of a revisit the payload is elsewhere
        if said.startswith("sha1:") and headers.get("warc-type") != "revisit" and said != sha1_label(block):
            raise Broken(name)


def salvage(read, most: int = 1 << 30) -> Iterator[Record | Gap]:
    """Records and gaps of an archive; ``read(n)`` gives its next bytes. Every byte is in one of them."""
    window, at, bad, why = Window(read), 0, None, ""
    while window.reach(at + 1):
        try:
            if window.get(at, at + 3) == GZIP:
                data, end = _member(window, at, most)
                headers, _, body = _parse(data, at, end)
                size = int(headers["content-length"])
                if len(data) != body + size + 4:
                    raise Broken("content length")
                block, tail = data[body : body + size], data[body + size :]
            elif window.get(at, at + 7) == VERSION:
                head = window.find(re.compile(rb"\r\n\r\n"), at, at + CHUNK)
                if head is None:
                    raise Broken("headers don't end")
                headers, _, body = _parse(window.get(at, head + 4), at, None)
                size, end = int(headers["content-length"]), at + body + int(headers["content-length"]) + 4
                if size > most or not window.reach(end):
                    raise Broken("content length")
                block, tail = window.get(at + body, end - 4), window.get(end - 4, end)
            else:
                raise Broken("no member or version line")
            _checked(headers, block, tail)
        except Broken as e:
            if bad is None:
                bad, why = at, str(e)
            found = window.find(NEXT, at + 1)
            at = window.low + len(window.data) if found is None else found
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield Record(at, end, headers, block)
        at = end
        window.drop(at)
    if bad is not None:
        yield Gap(bad, window.low + len(window.data), why)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


WRITTEN = "path string, records long, bytes long"


def write_rows(batches: Iterator[pa.RecordBatch], folder: str, zipped: bool, roll: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, uri, kind, refers_to, payload, sha1) to archives; one row for each finished archive."""
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    out, done = None, []

    def close():
        out[0].close()
        done.append(out[1:])

    for batch in batches:
        for page, uri, kind, refers, payload, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{page}')}>", "WARC-Date": "2024-01-01T00:00:00Z", "X-Page-ID": "" if page is None else str(page)}
            if uri:
                headers["WARC-Target-URI"] = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", uri)
            headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
            headers["X-Payload-Length"] = str(len(payload))
            if kind == "revisit":
                headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                headers["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{refers}')}>"
                headers["X-Refers-To-Page-ID"] = str(refers)
            data = record_bytes(headers, b"" if kind == "revisit" else payload, zipped)
            if out is None:
                name = f"{root}/{uuid.uuid4().hex}.warc" + ".gz" * zipped
                out = [fs.open_output_stream(name, compression=None), name, 0, 0]
            out[0].write(data)
            out[2] += 1
            out[3] += len(data)
            if out[3] >= roll:
                close()
                out = None
    if out is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])


def write_warc(pages: DataFrame, folder: str, zipped: bool = True, roll: int = 64 << 20) -> DataFrame:
    """Write rows (page_id, url, kind, refers_to, payload, sha1) as records; the table of archives, already complete."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", "kind", "refers_to", "payload", "sha1")
    return cut(rows.mapInArrow(lambda b: write_rows(b, folder, zipped, roll), WRITTEN), "warc-archives")


READ = "path string, start long, stop long, kind string, page_id long, refers_to long, uri string, payload binary, payload_length long, payload_sha1 string, gap string"


def read_rows(batches: Iterator[pa.RecordBatch], base: str, most: int) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(base)
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("payload_sha1", pa.string()), ("gap", pa.string())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, held = [], 0
            with fs.open_input_stream(path, compression=None) as f:
                for x in salvage(f.read, most):
                    if isinstance(x, Gap):
                        rows.append({"path": path, "start": x.start, "stop": x.end, "gap": x.reason})
                        continue
                    h = x.headers
                    said = h.get("warc-payload-digest", "")
                    own = said if h.get("warc-type") == "revisit" and said else sha1_label(x.block)
                    rows.append({"path": path, "start": x.start, "stop": x.end, "kind": h.get("warc-type"), "page_id": number(h.get("x-page-id")), "refers_to": number(h.get("x-refers-to-page-id")), "uri": h.get("warc-target-uri"), "payload": x.block, "payload_length": number(h.get("x-payload-length")) if h.get("warc-type") == "revisit" else len(x.block), "payload_sha1": base64.b32decode(own[5:]).hex()})
                    held += len(x.block)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(archives: DataFrame, base: str, most: int = 1 << 30) -> DataFrame:
    """All records and gaps of the archives at ``path``; a gap has its reason in ``gap`` and no page_id.

    Nothing is dropped silently: every byte of an archive belongs to a record or a logged gap. An empty archive gives no
    rows. ``base`` names the file system; records over ``most`` bytes count as damage.
    """
    spark = archives.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(lambda b: read_rows(b, base, most), READ)


def deduplicated(pages: DataFrame, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, kind, refers_to, payload, sha1: of equal payloads of ``least`` bytes or more the row with the
    largest page_id is the response and the others revisit it. A null payload counts as empty, a null id is never
    referred to while another exists; rows that repeat both id and payload are written each, all as responses."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("key"), F.length("payload").alias("size"))
    # identity is SHA-256 and length; a row per distinct payload that has copies
    groups = rows.filter(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "size", "first")
    joined = rows.join(groups, ["key", "size"], "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(later, "revisit").otherwise("response").alias("kind"), F.when(later, F.col("first")).alias("refers_to"), "payload", "sha1")


def warc_round_trip(pages: DataFrame, least: int = 1000, zipped: bool = True, roll: int = 64 << 20) -> DataFrame:
    """Write every page as a record, read the archives back: page_id, payload_bytes, payload_digest, record_type,
    refers_to of every record found. Fails if an archive has gaps; ``read_warc`` returns them as rows."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_warc(deduplicated(pages, least), folder, zipped, roll)
    found = read_warc(archives, folder)
    # nothing is missing from archives just written; a gap means damage, and then fewer rows must not pass for all
    whole = F.when(F.col("gap").isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("an archive just written is damaged")).cast("boolean"))
    return found.filter(whole).select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to WARC and back."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS size, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""
