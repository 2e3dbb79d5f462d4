"""Legacy archive converter: ARC to WARC, and a reader of both.

An ARC file begins with a version block (``filedesc://``) that names the fields of every record's
header line: five in version 1, ten in version 2. A header line ends in the declared length of the
bytes that follow. The converter parses records by these lengths and synthesises what WARC asks
for and ARC lacks: a record identifier (a version-5 UUID of the archive's path below the root, place and header
line, so repeated records have identifiers of their own, whichever files hold them), an ISO timestamp, a record type and block and payload
digests. Of records with equal payloads one is a response and the others become revisits that refer to it.

On Spark. Archives are written by the text sink: a row is one record's bytes, and the line
separator is what the format puts after a record. A task begins a new file before ``file_bytes`` or
``file_records`` are exceeded, so a file is no larger unless one record alone is, which then has a
file to itself; every file begins with its version block or warcinfo record. Archives are read as
``binaryFile`` rows, each of one such file, so any file system that Spark reads will do, and are
decompressed as a stream. The decision which record stays a response is a join of digests; payloads
are not shuffled, only each archive's compressed bytes once. Two records with one identifier would get each
other's revisits, so a conversion that meets two archives of one name raises before it writes.

Cases. A null html is an empty payload; a null url is written as ``-``. Repeated rows are records of their
own with identifiers of their own; of those with the largest page_id the one with the largest
identifier is the response. A null page_id sorts first. A very long page is one record of up to
the 2 GiB that a Spark row can hold. White space in a url is percent-encoded, as the header line needs. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_IDS = uuid.UUID("6f9f4a52-63c0-5d0e-9a55-2f0c8f1b7f11")
_NUMBER = b"X-Page-Number: "


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ARC


def arc_version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 bidloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = "" if version == "1" else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(body)}\n".encode() + body


def arc_record(version: str, url: str, ip: str, date: str, mime: str, block: bytes, code: str = "200", name: str = "-") -> bytes:
    fields = [url, ip, date, mime]
    if version == "2":
        fields += [code, hashlib.md5(block).hexdigest(), "-", "0", name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block


def parse_arc(data: bytes | _Plain) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """(header fields, block, header line) of each record after the version block.

    The block of a record is exactly as long as its header declares, whatever it holds. A file
    whose version block is missing or of an unknown version, and a truncated record, raise.
    """
    source, fields = data if isinstance(data, _Plain) else _Plain(data), None
    while source.skip(b"\r\n"):  # between records
        line = source.until(b"\n")
        if line is None:
            raise ValueError("a header line has no end")
        line = line.rstrip(b"\r").decode("utf-8", "replace")
        parts = line.split(" ")
        try:
            size = int(parts[-1])
        except ValueError:
            raise ValueError(f"no declared length: {line[:200]}") from None
        block = source.take(size)
        if block is None:
            raise ValueError(f"truncated record: {line[:200]}")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = block.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = ARC_FIELDS[version]
            continue
        if len(parts) != len(fields):  # URLs of old crawls hold blanks: the last fields are fixed
            parts = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]
        yield dict(zip(fields, parts, strict=True)), block, line


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


# ---------------------------------------------------------------- WARC


def iso_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss``, shorter forms filled with the first instant, as an ISO timestamp."""
    digits = (arc_date if arc_date.isdigit() else "")[:14]
    full = digits + "19700101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(line: str, archive: str = "", place: int = 0) -> str:
    """The identifier of the record at ``place`` of an archive, which is named by its path below the root."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, chr(0).join((archive, str(place), line)))}>"


def below(root: str, path: str) -> str:
    """``path`` without the folder ``root``, whichever way the two write scheme and slashes; all of it where it lies elsewhere."""
    root, whole = (re.sub("/+", "/", urlsplit(x).path) for x in (root, path))
    return whole[len(root.rstrip("/")) + 1 :] if whole.startswith(root.rstrip("/") + "/") else whole


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def convert_record(fields: dict[str, str], block: bytes, identifier: str, refers_to: str | None) -> bytes:
    """One WARC record of an ARC record; a revisit keeps the HTTP head and leaves the payload out."""
    head, payload = split_http(block)
    kept = head if refers_to else block
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response" if head else "resource"),
        ("WARC-Record-ID", identifier),
        ("WARC-Target-URI", fields["URL"]),
        ("WARC-Date", iso_date(fields["Archive-date"])),
        ("WARC-IP-Address", fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(kept)}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to), ("WARC-Truncated", "length")]
    headers.append(("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"]))
    return warc_record(headers, kept)


def warcinfo(name: str) -> bytes:
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", iso_date("")), ("Content-Type", "application/warc-fields")], b"software: bidloom\r\nformat: WARC File Format 1.1\r\n")


def parse_warc(data: bytes | _Plain) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields with lower-case names, block) of each record, by declared lengths."""
    source = data if isinstance(data, _Plain) else _Plain(data)
    while source.skip(b"\r\n"):
        head = source.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("no WARC record header")
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        block = source.take(int(fields["content-length"]))
        if block is None:
            raise ValueError("truncated record")
        yield fields, block


# ---------------------------------------------------------------- Spark


FILE_BYTES = 32 << 20
FILE_RECORDS = 2000


class _Plain:
    """The bytes of an archive, decompressed as they are asked for."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        packed = content[:2] == b"\x1f\x8b"
        self.source = gzip.GzipFile(fileobj=io.BytesIO(content)) if packed else io.BytesIO(content)
        self.step, self.held, self.at, self.more = step, b"", 0, True

    def fill(self, size: int) -> bool:
        """Whether ``size`` bytes are at hand."""
        while len(self.held) - self.at < size and self.more:
            got = self.source.read(max(self.step, size - len(self.held) + self.at))
            self.more = bool(got)
            self.held, self.at = self.held[self.at :] + got, 0
        return len(self.held) - self.at >= size

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is taken away as well; null where it does not come."""
        looked = 0
        while (found := self.held.find(mark, self.at + looked)) < 0:
            looked = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.fill(len(self.held) - self.at + 1):
                return None
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def take(self, size: int) -> bytes | None:
        if not self.fill(size):
            return None
        self.at += size
        return self.held[self.at - size : self.at]

    def skip(self, of: bytes) -> bool:
        """Leave out bytes among ``of``; whether anything follows."""
        while self.fill(1):
            if self.held[self.at] not in of:
                return True
            self.at += 1
        return False


def _in_files(records: Iterator[bytes], opening, file_bytes: int, file_records: int) -> Iterator[tuple[int, int, bytes]]:
    """(file, place, bytes) of records, with an opening record before each file's first."""
    file, place, size = -1, 0, 0
    for r in records:
        if file < 0 or place > file_records or size + len(r) > file_bytes:
            file, place = file + 1, 0
            first = opening(file)
            size = len(first)
            yield file, place, first
            place += 1
        yield file, place, r
        place, size = place + 1, size + len(r)


_RECORD = pa.schema([("file", pa.int32()), ("place", pa.int32()), ("record", pa.binary())])


def _as_batches(records: Iterator[tuple[int, int, bytes]], most: int = 64, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[2])
        if len(held) == most or size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _RECORD.types, strict=True)], schema=_RECORD)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _RECORD.types, strict=True)], schema=_RECORD)


def _file_name(file: int, ending: str) -> str:
    """The name that a task's archive gives itself: no two tasks or files of a job have the same."""
    return f"part-{TaskContext.get().partitionId():05d}-{file:05d}.{ending}"


def _save(source: DataFrame, run, path: str, after: str) -> None:
    """Rows of ``run`` as archive files, one for each task and file number.

    The sort states the order that the rows are in already, which the sink asks for. The cast keeps
    the bytes as they are. Archives are packed at gzip's fast level: on raw pages a third of the
    time for an eighth more bytes.
    """
    records = source.mapInArrow(run, "file int, place int, record binary").sortWithinPartitions("file", "place")
    records.select(F.col("record").cast("string"), "file").write.partitionBy("file").option("lineSep", after).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, version: str = "1", date: str = "20200101000000", file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Archives of ``pages(page_id, url, html)``: each an HTTP response that carries the page_id."""

    def records(batches) -> Iterator[bytes]:
        for batch in batches:
            for number, url, html in zip(*batch.columns, strict=True):
                body = (html.as_py() or "").encode()
                number = "" if number.as_py() is None else str(number.as_py())
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _NUMBER + number.encode() + b"\r\n\r\n"
                target = quote(url.as_py() or "-", safe="%/:=&?~#+!$,;'@()*[]|^{}<>\\`\"")
                yield arc_record(version, target, "0.0.0.0", date, "text/html", head + body)

    def run(batches):
        yield from _as_batches(_in_files(records(batches), lambda n: arc_version_block(version, _file_name(n, "arc"), date), file_bytes, file_records))

    _save(pages.select("page_id", "url", "html"), run, path, "\n")


def archives(spark, path: str, pattern: str) -> DataFrame:
    """One row per archive file: ``(path, content)``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def arc_index(arcs: DataFrame, root: str) -> DataFrame:
    """``(path, place, id, number, digest, size)`` of every ARC record of archives under ``root``."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, name = [], below(root, path.as_py())
                for place, (_, block, line) in enumerate(parse_arc(_Plain(content.as_py()))):
                    head, payload = split_http(block)
                    rows.append({"path": path.as_py(), "place": place, "id": record_id(line, name, place), "number": _number(head), "digest": sha1_base32(payload), "size": len(payload)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("place", pa.int32()), ("id", pa.string()), ("number", pa.int64()), ("digest", pa.string()), ("size", pa.int64())]))

    return arcs.mapInArrow(run, "path string, place int, id string, number long, digest string, size long")


def _number(head: bytes) -> int | None:
    at = head.find(_NUMBER)
    value = head[at + len(_NUMBER) : head.find(b"\r", at)] if at >= 0 else b""
    return int(value) if value else None


def raise_on_shared_names(arcs: DataFrame, root: str) -> None:
    """Raise when two archives have one name below ``root``: records at equal places could get one identifier.

    A name and a place make an identifier, and an archive has a place once, so other records never share one.
    """

    def names(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([below(root, p.as_py()) for p in batch.column(0)], pa.string())], ["name"])

    twice = arcs.select("path").mapInArrow(names, "name string").groupBy("name").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"{twice[0]['count']} archives have the name {twice[0]['name']} below {root}")


def convert(arc_path: str, warc_path: str, scratch: Scratch, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Convert the ARC files under ``arc_path``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the
    largest page number (then identifier) is the response and the others revisit it.
    """
    spark = scratch.spark
    arcs = archives(spark, arc_path, "*.txt*")
    raise_on_shared_names(arcs, arc_path)
    index = scratch.table(arc_index(arcs, arc_path), "arc-index")
    shared = index.where(F.col("size") >= min_revisit_bytes)
    first = shared.groupBy("digest", "size").agg(F.max(F.struct("number", "id")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = scratch.table(first, "first")  # so that a digest with very many rows can be split in the join
    revisits = shared.join(first.select("digest", "size", F.col("first.id").alias("refers_to")), ["digest", "size"]).where("id <> refers_to")
    # At most as many as the archive has records (``file_records`` of those written here): a list beside its bytes.
    by_file = revisits.groupBy("path").agg(F.collect_list(F.struct("place", "refers_to")).alias("revisits"))

    def run(batches):
        def records():
            for batch in batches:
                for path, content, revisits in zip(*batch.columns, strict=True):
                    name, refers = below(arc_path, path.as_py()), {r["place"]: r["refers_to"] for r in revisits.as_py() or []}
                    for place, (fields, block, line) in enumerate(parse_arc(_Plain(content.as_py()))):
                        yield convert_record(fields, block, record_id(line, name, place), refers.get(place))

        yield from _as_batches(_in_files(records(), lambda n: warcinfo(f"{below('/', warc_path)}/{_file_name(n, 'warc')}"), file_bytes, file_records))

    _save(arcs.join(by_file, "path", "left").select("path", "content", "revisits"), run, warc_path, "\r\n\r\n")


def read_warc(spark, path: str) -> DataFrame:
    """``(id, type, number, size, digest, refers_to, block_ok)`` of every record but warcinfo."""

    def run(batches):
        schema = pa.schema([("id", pa.string()), ("type", pa.string()), ("number", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("block_ok", pa.bool_())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(_Plain(content.as_py())):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    revisit = fields["warc-type"] == "revisit"
                    rows.append(
                        {
                            "id": fields["warc-record-id"],
                            "type": fields["warc-type"],
                            "number": _number(head),
                            "size": int(fields["warc-payload-length"]) if revisit else len(payload),
                            "digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else sha1_base32(payload),
                            "refers_to": fields.get("warc-refers-to"),
                            "block_ok": fields["warc-block-digest"] == f"sha1:{sha1_base32(block)}",
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = archives(spark, path, "*.txt*").select("content")
    return found.mapInArrow(run, "id string, type string, number long, size long, digest string, refers_to string, block_ok boolean")


def pages_through_archives(pages: DataFrame, scratch: Scratch, version: str = "1", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, block_ok)`` as read back.

    ``pages`` go to ARC files, these through the converter to WARC files, and the rows come from
    reading the WARC files.
    """
    spark = scratch.spark
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc, version, file_bytes=file_bytes)
    convert(arc, warc, scratch, min_revisit_bytes, file_bytes)
    records = scratch.table(read_warc(spark, warc), "records")
    named = records.select(F.col("id").alias("refers_to"), F.col("number").alias("of")).join(
        records.where("refers_to IS NOT NULL").select("refers_to").distinct(), "refers_to"
    ).groupBy("refers_to").agg(F.max("of").alias("of"))
    named = scratch.table(named, "named")
    out = records.join(named, "refers_to", "left")
    return out.select(F.col("number").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of").alias("refers_to"), "block_ok")
