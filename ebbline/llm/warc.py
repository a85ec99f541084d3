"""Legacy ARC archives converted to WARC, written and read as files through Spark.

An ARC archive opens with a version block that names its version and the fields of its header lines;
each record declares its length there. The converter makes WARC records of them: identifiers from the
record's own data (so reruns agree), ISO timestamps, types, and SHA-1 digests. Of records with equal
payloads the one with the largest key is the response, the others revisit it.

WARC records end with two line ends, which is the line separator Spark's text writer is given: its
files are WARC files. They are read as binary files by declared lengths, so payloads may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.shared import new_path, stored, text_batches

#: Fields of a header line by ARC version.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes after which an archive is closed, and records of a WARC file.
ARCHIVE_BYTES, RECORDS_PER_FILE = 4 << 20, 4_000
#: HTTP field with the key of a record.
KEY = b"X-Record-Key"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class ArcRecord:
    """A record of an archive: header fields by name, content, and whether it is shorter than declared."""

    fields: dict[str, str]
    content: bytes
    truncated: bool = False
    http: bytes = field(init=False)
    payload: bytes = field(init=False)

    def __post_init__(self) -> None:
        head, found, rest = self.content.partition(b"\r\n\r\n")
        if self.content.startswith(b"HTTP/") and found:
            self.http, self.payload = head + found, rest
        else:
            self.http, self.payload = b"", self.content

    @property
    def url(self) -> str:
        return self.fields.get("URL", "-")

    @property
    def date(self) -> str:
        """ISO form of the 14 digits of an archive date; missing digits are the earliest."""
        digits = "".join(c for c in self.fields.get("Archive-date", "") if c.isdigit())[:14]
        digits += "19700101000000"[len(digits) :]
        return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"

    @property
    def key(self) -> int | None:
        value = http_field(self.http, KEY)
        return int(value) if value else None


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        own, _, value = line.partition(b":")
        if own.strip().lower() == name.lower():
            return value.strip()
    return None


def digest(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content, usedforsecurity=False).digest()).decode()


def record_id(url: str, date: str, key: int | None, payload_digest: str) -> str:
    content = f"{url}\n{date}\n{key}\n{payload_digest}".encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(content).digest()[:16], version=5)}>"


def arc_archive(name: str, version: str, date: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An archive of (url, content type, content) with the header lines of the version."""
    names = ARC_FIELDS[version].split()

    def line(url: str, kind: str, size: int, offset: int) -> bytes:
        values = {"URL": _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-", "IP-address": "0.0.0.0", "Archive-date": date}
        values |= {"Content-type": kind, "Result-code": "200", "Offset": str(offset), "Filename": name, "Archive-length": str(size)}
        return " ".join(values.get(n, "-") for n in names).encode() + b"\n"

    about = f"{version} 0 ebbline\n{ARC_FIELDS[version]}\n".encode()
    parts = [line(f"filedesc://{name}", "text/plain", len(about), 0), about]
    offset = len(parts[0]) + len(about)
    for url, kind, content in records:
        parts += [b"\n", line(url, kind, len(content), offset + 1), content]
        offset += sum(map(len, parts[-3:]))
    return b"".join([*parts, b"\n"])


def parse_arc(archive: bytes) -> Iterator[ArcRecord]:
    """The records of an archive after its version block, by the fields that block names."""
    if archive[:2] == b"\x1f\x8b":
        archive = gunzip(archive)
    at, names = 0, None
    while True:
        while at < len(archive) and archive[at] in b"\r\n":
            at += 1
        if at >= len(archive):
            return
        end = archive.find(b"\n", at)
        if end < 0:
            return  # the archive is cut off inside a header line
        values = archive[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {at}: {values}")
        content = archive[end + 1 : end + 1 + int(values[-1])]
        at = end + 1 + int(values[-1])
        if names is None:
            about = content.decode("utf-8", "replace").splitlines()
            version = about[0].split(" ")[0] if about else "1"
            names = about[1].split() if len(about) > 1 else ARC_FIELDS[version].split()
            if version not in ARC_FIELDS or not values[0].startswith("filedesc:"):
                raise ValueError(f"not an ARC version block: {values}")
            continue
        if len(values) != len(names):
            raise ValueError(f"{len(values)} values for the fields {names}")
        yield ArcRecord(dict(zip(names, values, strict=True)), content, at > len(archive))


def gunzip(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        if not member.eof:
            raise ValueError("the gzip file is cut off")
        content = member.unused_data
    return b"".join(out)


def warc_record(record: ArcRecord, payload_digest: str, refers_to: tuple[str, str, int | None] | None) -> str:
    """The WARC record without its two last line ends. refers_to: url, date and key of the response."""
    kind = "revisit" if refers_to else "response" if record.http else "resource"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(record.url, record.date, record.key, payload_digest)),
        ("WARC-Date", record.date),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.fields.get("IP-address", "0.0.0.0")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
    ]
    if refers_to:
        url, date, key = refers_to
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(url, date, key, payload_digest))]
        head += [("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
    if record.truncated:
        head.append(("WARC-Truncated", "length"))
    block = record.http if refers_to else record.content
    kind = "application/http; msgtype=response" if record.http else record.fields.get("Content-type", "application/octet-stream")
    head += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", kind), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, by declared lengths."""
    at = 0
    while at < len(content):
        if content[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(head["Content-Length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it declares")
        yield head, content[start:stop]
        at = stop + 4


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """`name`, `content`: archives of about ARCHIVE_BYTES, by turns of version 1 and 2.

    The payload is the html in UTF-8 (null: empty) after an HTTP head with the id as key; a null id has
    no key, a null URL is `-`.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"pages-{number}.arc"
            content = arc_archive(name, "12"[number % 2], date, held)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["name", "content"])

        for batch in batches:
            for key, url, html in zip(batch["id"], batch["url"], batch["html"], strict=True):
                payload = (html.as_py() or "").encode()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
                if key.is_valid:
                    head += b"%s: %d\r\n" % (KEY, key.as_py())
                held.append((url.as_py() or "-", "text/html", head + b"\r\n" + payload))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return text_batches(rows).mapInArrow(run, "name string, content binary")


def _payloads(archives: DataFrame) -> DataFrame:
    """`digest`, `key`, `url`, `date` of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "key", "url", "date"]
        for batch in batches:
            for content in batch["content"]:
                rows = [(digest(r.payload), r.key, r.url, r.date) for r in parse_arc(content.as_py())]
                columns = [pa.array([row[i] for row in rows], pa.int64() if i == 1 else pa.string()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return archives.select("content").mapInArrow(run, "digest string, key long, url string, date string")


def _contents(archives: DataFrame) -> DataFrame:
    """`digest`, `key`, and the parsed record: `names`, `values`, `truncated`, `content`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                records = list(parse_arc(content.as_py()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "digest": pa.array([digest(r.payload) for r in records], pa.string()),
                        "fields": pa.array([list(r.fields.items()) for r in records], pa.map_(pa.string(), pa.string())),
                        "truncated": pa.array([r.truncated for r in records], pa.bool_()),
                        "content": pa.array([r.content for r in records], pa.binary()),
                    }
                )

    return archives.select("content").mapInArrow(run, "digest string, fields map<string, string>, truncated boolean, content binary")


def convert(archives: DataFrame, path: str | None = None) -> str:
    """Write the records of ARC archives (`content`) as gzip WARC files; returns their folder.

    Records with equal payloads, also empty ones, are revisits of the one with the largest key (a
    missing key is the smallest; ties go by URL and date). Repeated records that tie in all of these
    are all responses. No archives give a folder without records.
    """
    spark = archives.sparkSession
    path = path or new_path(spark, "warc")
    original = F.max(F.struct("key", "url", "date")).alias("original")
    shared = _payloads(archives).groupBy("digest").agg(original, F.count("*").alias("n")).where("n > 1").drop("n")
    records = _contents(archives).join(stored(shared, "shared"), "digest", "left").select("*", "original.*").drop("original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                record = ArcRecord(dict(row["fields"]), row["content"], row["truncated"])
                first = row["url"] and (row["url"], row["date"], row["key"])
                same = first is None or first == (record.url, record.date, record.key)
                out.append(warc_record(record, row["digest"], None if same else first))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = text_batches(records).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files in a folder.

    `record_id`, `record_type`, `url`, `date`, `key`, `payload_bytes`, `payload_digest` (of the full
    payload: declared by revisits, counted and compared with the declared one for the others),
    `refers_to_id`.
    """
    names = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "date": pa.string(), "key": pa.int64()}
    names |= {"payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to_id": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for head, block in parse_warc(gunzip(content.as_py())):
                    http, found, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "revisit":
                        size = int(http_field(http, b"Content-Length") or 0)
                    else:
                        size = len(payload)
                        if digest(payload) != declared:
                            raise ValueError(f"digest of {head['WARC-Record-ID']} differs from its payload")
                    key = http_field(http, KEY)
                    rows.append((head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Date"], int(key) if key else None, size, declared, head.get("WARC-Refers-To")))
                columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(names.values())]
                yield pa.RecordBatch.from_arrays(columns, list(names))

    schema = "record_id string, record_type string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Adds `refers_to`, the key of the response a revisit names."""
    records = stored(records, "records")
    revisits = records.where("refers_to_id IS NOT NULL").select("refers_to_id").distinct()
    responses = records.select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    responses = responses.join(revisits, "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    return records.join(stored(responses, "responses"), "refers_to_id", "left")
