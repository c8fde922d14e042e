"""From legacy ARC archives to WARC archives, and back to rows.

An ARC file starts with a version block, whose second line names the fields of the
header line of every record; version 1 has five, version 2 ten. Neither has
identifiers, digests or record types. A record is found by its declared length
alone. The converter reads the header lines by the file's own version and
synthesises what a WARC record needs: an identifier from file, place, header line
and payload, the date in its other notation, the type from the content, SHA-1
digests of block and payload. Records of equal payloads become one response, and
revisits that refer to it.

Archives are written by Spark's own text writer: the line separator of a file is
what stands after each record (a line feed in ARC, two line breaks in WARC), so
files are committed with their task and lie wherever Spark can write. Each file is
one gzip stream. They are read as a stream of records; neither a task nor a
row holds more than one compressed file or one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tables import cut

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Page-Id"  # of the stored HTTP response: the key of the page
_ARC_END, _WARC_END = "\n", "\r\n\r\n"
_RUN_BYTES = 4 << 20  # of records that go to the JVM at once
_MISSING = "-"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _bounded(rows, schema: pa.Schema, weight):
    """Rows as batches of about _RUN_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 200
        if size >= _RUN_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _one_by_one(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_VALUE = pa.schema([("value", pa.binary())])


def _write(records: DataFrame, path: str, end: str) -> None:
    (records.select(F.col("value").cast("string")).write.option("lineSep", end)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", 0).text(path))  # what opens a file stands in it once


# --- ARC ---

def arc_opening(version: int, name: str, date: str) -> bytes:
    """The version block of a file, without the line feed after it."""
    body = f"{version} 0 vacancia\n{ARC_FIELDS[version]}\n"
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        line += f" 200 {_MISSING} {_MISSING} 0 {name}"
    return f"{line} {len(body)}\n{body}".encode()


def arc_record(version: int, name: str, url: str | None, date: str, block: bytes) -> bytes:
    """A record without the line feed after it; white space in the address is percent-encoded."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or _MISSING)
    line = f"{url} 0.0.0.0 {date} text/html"
    if version == 2:
        line += f" 200 {_MISSING} {_MISSING} 0 {name}"
    return f"{line} {len(block)}\n".encode() + block


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
              payload_col: str = "html", date: str = "20010203040506") -> None:
    """Pages as ARC files, one per task, of version 1 and 2 by turns; the page's key goes into its HTTP header."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"

        def rows():
            opened = False
            for r in _one_by_one(batches):
                if not opened:
                    yield {"value": arc_opening(version, name, date)}
                    opened = True
                payload = r["payload"] or b""
                key = "" if r["key"] is None else f"{KEY_HEADER}: {r['key']}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}\r\n"
                yield {"value": arc_record(version, name, r["url"], date, head.encode() + payload)}
        return _bounded(rows(), _VALUE, lambda r: len(r["value"]))
    chosen = pages.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{url_col}`").alias("url"),
                          F.col(f"`{payload_col}`").cast("binary").alias("payload"))
    _write(chosen.mapInArrow(run, "value binary"), path, _ARC_END)


def _stream(content: bytes):
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def parse_arc(content: bytes, name: str = ""):
    """Records of an ARC file as dicts: place, line, and the fields its version block names, and block.

    A header line that has not the declared fields, or a file that ends inside a record, is an error.
    """
    file, place, fields = _stream(content), 0, None
    while line := file.readline():
        start, place = place, place + len(line)
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        if not text:
            continue
        opening = text.startswith("filedesc://")
        if fields is None and not opening:
            raise ValueError(f"{name}: no version block")
        n = text.rpartition(" ")[2]
        if not n.isdigit():
            raise ValueError(f"{name}: no length in the header line at {start}")
        block = file.read(int(n))
        place += len(block)
        if len(block) < int(n):
            raise ValueError(f"{name}: the file ends inside the record at {start}")
        if opening:
            fields = block.decode().split("\n")[1].split(" ")
            if fields not in [f.split(" ") for f in ARC_FIELDS.values()]:
                raise ValueError(f"{name}: unknown version block {block[:80]!r}")
            continue
        values = text.rsplit(" ", len(fields) - 1)  # an address may hold spaces
        if len(values) < len(fields):
            raise ValueError(f"{name}: {len(values)} of {len(fields)} fields at {start}")
        yield dict(zip(fields, values)) | {"place": start, "line": line, "block": block}


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Head (with the empty line) and payload of an HTTP response; null for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", block)
    at = end.end() if end else len(block)
    return block[:at], block[at:]


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


_SEEN = pa.schema([("file", pa.string()), ("place", pa.int64()), ("id", pa.string()), ("type", pa.string()),
                   ("url", pa.string()), ("date", pa.string()), ("key", pa.string()), ("n", pa.int64()),
                   ("digest", pa.string()), ("same", pa.binary())])
_SEEN_DDL = ("file string, place long, id string, type string, url string, date string, key string, n long, "
             "digest string, same binary")


def warc_date(digits: str) -> str:
    """14 (or fewer) digits of an ARC date -> 2001-02-03T04:05:06Z; missing ones are the smallest possible."""
    digits = (digits + "00000101000000"[len(digits):])[:14]
    return re.sub(r"(....)(..)(..)(..)(..)(..)", r"\1-\2-\3T\4:\5:\6Z", digits)


def _survey(batches):
    """What every ARC record is, without its content."""
    def rows():
        for r in _one_by_one(batches):
            for record in parse_arc(r["content"], r["path"]):
                parts = split_http(record["block"])
                head, payload = parts or (b"", record["block"])
                digest = base32_sha1(payload)
                seed = hashlib.sha1(f"{r['path']} {record['place']} ".encode() + record["line"] + digest.encode())
                yield {"file": r["path"], "place": record["place"],
                       "id": f"<urn:uuid:{uuid.UUID(bytes=seed.digest()[:16], version=5)}>",
                       "type": "response" if parts else "resource", "url": record["URL"],
                       "date": warc_date(record["Archive-date"]), "key": header(head, KEY_HEADER),
                       "n": len(payload), "digest": digest, "same": hashlib.sha256(payload).digest()}
    return _bounded(rows(), _SEEN, lambda r: 300)


# --- WARC ---

def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line breaks after it; fields without value are left out."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None and v != _MISSING)
    return f"{WARC_VERSION}\r\n{lines}\r\n".encode("utf-8", "surrogateescape") + block


def _compose(batches):
    """ARC files with the links of their records -> WARC records, for each file a warcinfo first."""
    def rows():
        for r in _one_by_one(batches):
            links, opened = {x["place"]: x for x in r["links"]}, False
            for record in parse_arc(r["content"], r["path"]):
                link, block, date = links[record["place"]], record["block"], warc_date(record["Archive-date"])
                if not opened:
                    made = uuid.UUID(bytes=hashlib.sha1(f"warcinfo {link['id']}".encode()).digest()[:16], version=5)
                    yield {"value": warc_record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{made}>"),
                         ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                        b"software: vacancia\r\nformat: WARC File Format 1.1\r\n")}
                    opened = True
                target, kind, content_type = link["target"], link["type"], record["Content-type"]
                if kind == "response":
                    content_type = "application/http; msgtype=response"
                fields = [("WARC-Record-ID", link["id"]), ("WARC-Date", date), ("WARC-Target-URI", record["URL"]),
                          ("WARC-IP-Address", record["IP-address"]), ("Content-Type", content_type),
                          ("WARC-Payload-Digest", f"sha1:{link['digest']}")]
                if target:
                    kind, block = "revisit", split_http(block)[0]
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", target["id"]),
                               ("WARC-Refers-To-Target-URI", target["url"]),
                               ("WARC-Refers-To-Date", target["date"])]
                yield {"value": warc_record([("WARC-Type", kind), *fields], block)}
    return _bounded(rows(), _VALUE, lambda r: len(r["value"]))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """All ARC files of a folder as WARC files in another.

    Of the responses with equal payloads of at least `least` bytes, the one of the largest
    key (then the latest, then the last) stays a response, the others become
    revisits. Payloads are equal if their SHA-256 are. A group of any size meets in no
    task: each file sums up its own records first, and only these sums meet. A file is
    converted where its links are; its bytes travel as they are, compressed.
    """
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    seen = cut(files.mapInArrow(_survey, _SEEN_DDL)).withColumn("key", F.expr("try_cast(key as long)"))
    rank = F.struct("key", "date", "file", "place", "id", "url")
    sums = seen.where((F.col("type") == "response") & (F.col("n") >= least)).groupBy("file", "same").agg(
        F.max(rank).alias("last"))
    sums = sums.withColumn("last", F.max("last").over(Window.partitionBy("same")))
    revisit = (F.col("type") == "response") & (F.col("n") >= least) & (F.col("last.id") != F.col("id"))
    links = seen.join(sums, ["file", "same"], "left").groupBy(F.col("file").alias("path")).agg(
        F.collect_list(F.struct("place", "id", "type", "digest", F.when(
            revisit, F.struct("last.id", "last.url", "last.date")).alias("target"))).alias("links"))
    _write(files.join(links, "path").mapInArrow(_compose, "value binary"), warc_path, _WARC_END)


def parse_warc(content: bytes, name: str = ""):
    """(fields, block) of every record; fields by lower-case name. Broken records are errors."""
    file = _stream(content)
    while line := file.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := file.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[key.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = file.read(n)
        if len(block) < n:
            raise ValueError(f"{name}: the file ends inside a record")
        yield fields, block


_READ = pa.schema([("file", pa.string()), ("id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                   ("date", pa.string()), ("key", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_to_id", pa.string())])


def _read_records(batches):
    def rows():
        for r in _one_by_one(batches):
            for fields, block in parse_warc(r["content"], r["path"]):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block) or (b"", block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                whole = kind != "revisit"
                if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or (
                        whole and digest != base32_sha1(payload)):
                    raise ValueError(f"{r['path']}: {fields['warc-record-id']} is damaged")
                yield {"file": r["path"], "id": fields["warc-record-id"], "record_type": kind,
                       "url": fields.get("warc-target-uri"), "date": fields["warc-date"],
                       "key": header(head, KEY_HEADER), "payload_bytes": len(payload) if whole else None,
                       "payload_digest": digest, "refers_to_id": fields.get("warc-refers-to")}
    return _bounded(rows(), _READ, lambda r: 300)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all WARC files of a folder, without the payloads, warcinfo records left out.

    file, id, record_type, url, date, key (long), payload_bytes, payload_digest, refers_to_id and
    refers_to (the key of the record referred to). A revisit has its payload's size
    from that record. Digests are computed anew; a damaged record, or a revisit of a record
    that is not there or has another digest, is an error. The files are read when this is called.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = cut(files.mapInArrow(
        _read_records, "file string, id string, record_type string, url string, date string, key string, "
                       "payload_bytes long, payload_digest string, refers_to_id string")
        .withColumn("key", F.expr("try_cast(key as long)")))
    # Per file once, so that the revisits of one record are spread as the files are.
    wanted = rows.where(F.col("refers_to_id").isNotNull()).select("file", "refers_to_id").distinct()
    there = rows.where(F.col("payload_bytes").isNotNull()).select(
        F.col("id").alias("refers_to_id"), F.struct("key", "payload_bytes", "payload_digest").alias("target"))
    found = wanted.join(there, "refers_to_id")
    revisit = F.col("refers_to_id").isNotNull()
    broken = revisit & ~F.coalesce(F.col("target.payload_digest") == F.col("payload_digest"), F.lit(False))
    rows = rows.join(found, ["file", "refers_to_id"], "left")
    return rows.select(
        "file", "id", "record_type", "url", "date", "key",
        F.when(broken, F.raise_error(F.concat(F.lit("a revisit without its record: "), "id")).cast("long"))
        .when(revisit, F.col("target.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "refers_to_id", F.col("target.key").alias("refers_to"))
