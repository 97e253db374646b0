"""Legacy archives: write ARC, parse it by version, convert it to WARC, read WARC back.

An archive is a row (archive, content) of a table: bytes of bounded size, so that tasks read and write archives
through Spark's own storage; ``content`` is a complete gzipped file (WARC: a member per record) and can be saved as one.
"""

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

ARCHIVE_BYTES = 4 << 20
LEVEL = 4
CAPTURED = "20240101000000"
ADDRESS = "0.0.0.0"
# Field names of the two ARC versions, and the WARC profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: str, date: str, kind: str, length: int, offset: int, filename: str) -> bytes:
    if version == 1:
        return f"{url} {ADDRESS} {date} {kind} {length}\n".encode()
    return f"{url} {ADDRESS} {date} {kind} 200 - - {offset} {filename} {length}\n".encode()


def arc_start(version: int, name: str) -> bytes:
    body = f"{version} 0 trackweave\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", CAPTURED, "text/plain", len(body), 0, name) + body


def write_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as ARC archives of about ``archive_bytes``, versions 1 and 2 in turn.

    Each record holds an HTTP response whose body is the html in UTF-8; null html is empty, and a null url is about:blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}.arc.gz"]), pa.array([gzip.compress(b"".join(out), LEVEL)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for key, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                version, name = 1 + number % 2, f"{part:06d}-{number:06d}.arc.gz"
                if not out:
                    out, size = [arc_start(version, name)], 0
                body = html or b""
                page = "" if key is None else f"X-Page-Id: {key}\r\n"
                block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{page}Content-Length: {len(body)}\r\n\r\n".encode() + body
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
                header = arc_header(version, address, CAPTURED, "text/html", len(block), size, name)
                out += [header, block, b"\n"]
                size += len(header) + len(block) + 1
                if size >= archive_bytes:
                    yield closed()
                    number, out = number + 1, []
        if out:
            yield closed()

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "archive string, content binary")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(fields, offset, block) of each record of an ARC file, gzipped or plain; the first is its description.

    The description's second line names the fields, which depend on the version; the last field of a header line
    is the length of the block. A URL with spaces keeps them. Lines that are no header are passed over, and
    a block that ends before its declared length is given with the field ``truncated``.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    names, at = ARC_FIELDS[1].split(), 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        described = line.startswith("filedesc://")
        # the description's own header may have the fields of either version
        parts = line.split(" ") if described else line.rsplit(" ", len(names) - 1)
        if len(parts) < 5 or not parts[-1].isdigit() or not described and len(parts) != len(names):
            at = end + 1
            continue
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if described:
            lines = block.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and lines[1].endswith("Archive-length"):
                names = lines[1].split(" ")
            fields = {"URL": parts[0], "IP-address": parts[1], "Archive-date": parts[2], "Content-type": parts[3], "Version": lines[0].split(" ")[0]}
        else:
            fields = dict(zip(names, parts, strict=True))
        if len(block) < length:
            fields["truncated"] = "length"
        yield fields, at, block
        at = end + 1 + length


def http_head(block: bytes) -> tuple[dict[str, str], int]:
    """Lower-case header fields of an HTTP response and where its body begins (0, if it is none)."""
    if not block.startswith(b"HTTP/"):
        return {}, 0
    found = re.search(rb"\r?\n\r?\n", block)
    end = found.end() if found else len(block)
    lines = block[:end].decode("latin-1").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}, end


def warc_date(date: str) -> str:
    """ISO form of an ARC date of 8 to 14 digits; missing digits count as the start of the day."""
    d = re.sub(r"\D", "", date)[:14].ljust(8, "0").ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL)


def convert_arc(archive: str, data: bytes, earlier: dict[int, dict[str, str]]) -> bytes:
    """The gzipped WARC file equivalent to an ARC file; records at the offsets in ``earlier`` become revisits with those fields."""
    out = []
    for fields, offset, block in parse_arc(data):
        base = {"WARC-Record-ID": record_id(archive, offset), "WARC-Date": warc_date(fields["Archive-date"])}
        if fields["URL"].startswith("filedesc://"):
            info = f"software: trackweave\r\nformat: WARC File Format 1.1\r\nisPartOf: {archive}\r\narc-version: {fields['Version']}\r\n"
            out.append(warc_record("warcinfo", base | {"WARC-Filename": archive, "Content-Type": "application/warc-fields"}, info.encode()))
            continue
        head, body = http_head(block)
        base |= {"WARC-IP-Address": fields["IP-address"], "WARC-Target-URI": fields["URL"], "WARC-Payload-Digest": f"sha1:{base32_sha1(block[body:])}"}
        if "truncated" in fields:
            base["WARC-Truncated"] = fields["truncated"]
        if not body:
            out.append(warc_record("resource", base | {"Content-Type": fields["Content-type"]}, block))
        elif offset in earlier:
            out.append(warc_record("revisit", base | {"WARC-Profile": REVISIT_PROFILE, **earlier[offset], "Content-Type": "application/http; msgtype=response"}, block[:body]))
        else:
            out.append(warc_record("response", base | {"Content-Type": "application/http; msgtype=response"}, block))
    return b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a WARC file, gzipped or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        yield fields, block
        at = end + 8 + len(block)


def index_arc(arcs: DataFrame) -> DataFrame:
    """One row per captured record: archive, offset, record_id, page_id, url, date, payload_bytes, payload_digest."""
    kind = "archive string, offset long, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for fields, offset, block in parse_arc(data):
                    if fields["URL"].startswith("filedesc://"):
                        continue
                    head, body = http_head(block)
                    page = head.get("x-page-id")
                    rows.append((archive, offset, record_id(archive, offset), int(page) if page else None, fields["URL"], warc_date(fields["Archive-date"]), len(block) - body, base32_sha1(block[body:])))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in kind.split(", ")])

    return arcs.select("archive", "content").mapInArrow(run, kind)


def arc_to_warc(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC archives (archive, content) equivalent to ARC archives.

    Of records with equal payloads (length and SHA-1) of at least ``least_bytes`` the one with the smallest page id is the response
    (ties: smallest record id; null ids last), the others revisit it. Payloads are not shuffled to find them: only
    index rows are, and copies collapse before they meet.
    """
    index = materialise(index_arc(arcs), "arc-index")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    firsts = index.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    earlier = (
        index.join(firsts, ["payload_digest", "payload_bytes"])
        .filter("record_id <> first.record_id")
        .groupBy("archive")
        .agg(F.collect_list(F.struct("offset", "first.record_id", "first.page_id", "first.url", "first.date")).alias("earlier"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                known = {}
                for r in rows or []:
                    known[r["offset"]] = {"WARC-Refers-To": r["record_id"], "WARC-Refers-To-Target-URI": r["url"], "WARC-Refers-To-Date": r["date"]}
                    if r["page_id"] is not None:
                        known[r["offset"]]["X-Refers-To-Page-Id"] = str(r["page_id"])
                name = archive.removesuffix(".arc.gz") + ".warc.gz"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([convert_arc(archive, data, known)], pa.binary())], names=["archive", "content"])

    return arcs.join(earlier, "archive", "left").select("archive", "content", "earlier").mapInArrow(run, "archive string, content binary")


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row per captured record of WARC archives; a block or payload that does not have its digest is an error."""
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string, archive string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for fields, block in parse_warc(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, body = http_head(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or not revisit and base32_sha1(block[body:]) != digest:
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {archive}")
                    page, first = head.get("x-page-id"), fields.get("X-Refers-To-Page-Id")
                    size = int(head["content-length"]) if revisit else len(block) - body
                    rows.append((int(page) if page else None, size, digest, fields["WARC-Type"], int(first) if first else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], archive))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in kind.split(", ")])

    return warcs.select("archive", "content").mapInArrow(run, kind)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as legacy archives, converted to WARC and read back: one row per row of ``pages``.

    Null html is an empty payload, rows that repeat a page id are records of their own (one of them is the response).
    """
    arcs = materialise(write_arc(pages), "arc")
    return read_warc(materialise(arc_to_warc(arcs, least_bytes), "warc"))
