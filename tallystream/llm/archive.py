"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block: a ``filedesc:`` header line, a line
with the version, and a line that names the header fields of its records.
Version 1 has five fields and version 2 ten; either ends with the declared
length of the body.  Archives may be packed, as a whole or in gzip members.  The
converter gives each record a WARC identifier,
timestamp, type and digests; records whose payload another one holds become
revisits.  Archives are rows of a table (``archive``, ``content``), of a few
megabytes each, so any store that Spark reads can hold them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm._arrow import arrow_map, pieces, utf8
from tallystream.llm._filter import by_weight, marked, within
from tallystream.llm._scratch import staged

#: Field names by version (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARCHIVE_SCHEMA = "archive string, content binary"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, item_key string, headers binary, payload binary, payload_bytes long, payload_digest string, error string"
#: Rows of repeated digests up to which they are broadcast; each has under 200 bytes.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class ArcRecord:
    """A record's header fields by name, its body, and its place in the file."""

    fields: dict[str, str]
    body: bytes
    offset: int
    version: int


@dataclass
class WarcRecord:
    """A WARC record; field names are as written."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(name: str, version: int, date: str) -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 tallystream\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(uri: str, date: str, mime: str, body: bytes, version: int, offset: int = 0, name: str = "-", ip: str = "0.0.0.0") -> bytes:
    """One ARC record; white space and controls in the address are escaped."""
    uri = re.sub(r"[\s\x00-\x1f]", lambda m: quote(m[0]), uri) or "-"
    extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{uri} {ip} {date} {mime}{extra} {len(body)}\n".encode() + body + b"\n"


def gzip_members(data: bytes) -> Iterator[bytes]:
    """The content of each member; malformed data raises ValueError where it begins."""
    while data:
        member = zlib.decompressobj(31)
        try:
            raw = member.decompress(data)
        except zlib.error as error:
            raise ValueError("bad gzip member") from error
        if not member.eof:
            raise ValueError("the archive ends early")
        data = member.unused_data
        yield raw


def plain_arc(data: bytes) -> tuple[bytes, ValueError | None]:
    """An ARC file without its packing, if it has one, and what is wrong with the part that can't be unpacked."""
    if not data.startswith(b"\x1f\x8b"):
        return data, None
    parts, members = [], gzip_members(data)
    try:
        parts.extend(members)
    except ValueError as error:
        return b"".join(parts), error
    return b"".join(parts), None


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block; malformed data raises ValueError where it begins."""
    data, broken = plain_arc(data)
    yield from _arc_records(data)
    if broken:
        raise broken


def _arc_records(data: bytes) -> Iterator[ArcRecord]:
    line, at = _line(data, 0)
    head = line.split(" ")
    if not line.startswith("filedesc:") or not head[-1].isdigit():
        raise ValueError("no version block")
    body = data[at : at + int(head[-1])]
    if len(body) < int(head[-1]):
        raise ValueError("the version block ends early")
    lines = body.decode("utf-8", "replace").split("\n")
    version = int(lines[0].split(" ")[0]) if lines[0].split(" ")[0].isdigit() else 0
    if version not in FIELDS:
        raise ValueError(f"unknown version {lines[0]!r}")
    names = (lines[1] if len(lines) > 1 and lines[1].strip() else FIELDS[version]).split(" ")
    at += len(body)
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        offset = at
        line, at = _line(data, at)
        values = line.split(" ")
        if len(values) > len(names):  # an address with spaces, as some writers left it
            values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"bad record header at {offset}")
        length = int(values[-1])
        if at + length > len(data):
            raise ValueError(f"the record at {offset} ends early")
        yield ArcRecord(dict(zip(names, values, strict=True)), data[at : at + length], offset, version)
        at += length


def _line(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\n", at)
    if end < 0:
        raise ValueError(f"no header line at {at}")
    return data[at:end].rstrip(b"\r").decode("utf-8", "replace"), end + 1


def warc_date(date: str) -> str:
    """An ARC date of 12 or 14 digits as WARC writes it; anything else raises ValueError."""
    if not re.fullmatch(r"\d{12}(\d\d)?", date):
        raise ValueError(f"bad date {date!r}")
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header part and payload of a body; the header part is empty if it isn't an HTTP response."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (body, b"")


def convert(record: ArcRecord, archive: str) -> WarcRecord:
    """The equivalent WARC record; its identifier follows from the archive's name and the place in it."""
    f = record.fields
    headers, payload = split_http(record.body)
    kind = "response" if headers else "resource"
    out = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}#{record.offset}')}>",
        "WARC-Date": warc_date(f["Archive-date"]),
        "WARC-Target-URI": f["URL"],
        "WARC-IP-Address": f["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(record.body)}",
        "Content-Type": "application/http; msgtype=response" if headers else f["Content-type"],
    }
    return WarcRecord(out, record.body)


def warc_bytes(record: WarcRecord) -> bytes:
    """The record as one gzip member, the length of its block computed."""
    lines = [f"{k}: {v}" for k, v in record.fields.items()] + [f"Content-Length: {len(record.block)}"]
    raw = b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + record.block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a sequence of gzip members; malformed data raises ValueError."""
    return map(warc_record, gzip_members(data))


def warc_record(raw: bytes) -> WarcRecord:
    """The record in a member's content; a malformed one raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    length = fields.get("Content-Length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or int(length) > len(rest):
        raise ValueError("bad Content-Length")
    return WarcRecord(fields, rest[: int(length)])


#: The date of records that describe the archive itself; it is fixed, so that equal input gives equal files.
MADE = "2000-01-01T00:00:00Z"


def warcinfo(archive: str, date: str = MADE) -> WarcRecord:
    """The record that an archive starts with; it describes the converter."""
    body = b"software: tallystream\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, archive)}>", "WARC-Date": date, "WARC-Filename": archive, "Content-Type": "application/warc-fields"}
    return WarcRecord(fields, body)


def http_field(headers: bytes, name: str) -> str | None:
    """The first value of an HTTP header field."""
    m = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb": ?([^\r\n]*)", headers)
    return m[1].decode("utf-8", "replace") if m else None


def write_arcs(pages: DataFrame, key: str, url: str, payload: str, date: str = "20000101000000", size: int = 1 << 20) -> DataFrame:
    """Rows as legacy archives of about ``size`` bytes, of versions 1 and 2 in turn.

    Every row becomes one record with an HTTP response as body; the key goes to
    the header ``X-Item-Key``.  A null payload is empty, a null address ``-``, a
    null key has no header.
    """
    chosen = pages.select(F.col(key).cast("string").alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).cast("string").alias("p"))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, 2, size):
                n += 1
                version, name = 1 + n % 2, f"part-{part:06d}-{n:06d}.arc"
                out = [arc_header(name, version, date)]
                at = len(out[0])
                offsets, raw = utf8(piece.column(2))
                whole = memoryview(raw)
                for i, (k, u) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                    content = bytes(whole[offsets[i] : offsets[i + 1]])
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                    head += f"X-Item-Key: {quote(k)}\r\n".encode() if k is not None else b""
                    body = head + b"Content-Length: %d\r\n\r\n" % len(content) + content
                    out.append(arc_record(u or "-", date, "text/html", body, version, at, name))
                    at += len(out[-1])
                yield pa.RecordBatch.from_pydict({"archive": [name], "content": pa.array([b"".join(out)], pa.binary())})

    return arrow_map(chosen, run, ARCHIVE_SCHEMA)


def _row(record: WarcRecord, payload: bytes, headers: bytes, with_payload: bool) -> tuple:
    key = http_field(headers, "X-Item-Key")
    revisit = record.fields.get("WARC-Type") == "revisit"
    declared = http_field(headers, "Content-Length") if revisit else None
    if declared is not None and not re.fullmatch("[0-9]{1,18}", declared):
        raise ValueError(f"bad Content-Length {declared!r} of a revisit")
    length = len(payload) if not revisit else None if declared is None else int(declared)
    return (
        record.fields["WARC-Record-ID"], record.fields["WARC-Type"], record.fields["WARC-Target-URI"], record.fields["WARC-Date"],
        None if key is None else unquote(key), headers, payload if with_payload else None, length,
        record.fields["WARC-Payload-Digest"].removeprefix("sha1:"), None,
    )


def _emit(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


_RECORD_TYPES = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.int64(), pa.string(), pa.string()]
_RECORD_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def converted(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The WARC equivalents of the records of ARC archives, one row each (``RECORD_SCHEMA``).

    A record with a bad field is one row with ``error``, and so is all that
    follows a place where the length of a record can't be told.
    """

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = read_arc(content or b"")
                while True:
                    try:
                        record = next(records)
                        made = convert(record, name or "")
                        headers, payload = split_http(record.body)
                        yield _row(made, payload, headers, with_payload)
                    except StopIteration:
                        break
                    except (ValueError, KeyError) as error:
                        yield (*[None] * 9, str(error))

    return arrow_map(archives.select("archive", "content"), lambda b: _emit(rows(b), _RECORD_NAMES, _RECORD_TYPES), RECORD_SCHEMA)


def repeated_payloads(records: DataFrame, key_type: str, min_bytes: int = 0) -> DataFrame:
    """Digests that several records share, how many do, the largest key and that record's identifier."""
    large = records.filter(F.col("error").isNull() & (F.col("payload_bytes") >= min_bytes))
    key = F.col("item_key").cast(key_type)
    # Keys are compared as their type; a record without a key is the smallest.
    top = F.max(F.struct(key.alias("key"), F.col("record_id").alias("id")))
    return large.groupBy("payload_digest").agg(F.count("*").alias("n"), top.alias("top")).filter("n > 1").select("payload_digest", "n", F.col("top.key").alias("refers_key"), F.col("top.id").alias("refers_id"))


def to_warc(archives: DataFrame, key_type: str = "string", min_bytes: int = 0, size: int = 1 << 20) -> DataFrame:
    """ARC archives as WARC archives, staged in the shared folder.

    Of records with equal payloads of at least ``min_bytes`` the one with the
    largest key stays a response and the others revisit it; records that share
    the largest key stay responses.  ``archives`` are read several times and must
    be the same each time.

    Only digests, and beyond ``BROADCAST_ROWS`` of them that repeat the heads of
    repeated records, are shuffled: then a record stays as it is if a bitmap says
    that it is no revisit, revisits are written from their heads, and the few
    records that the bitmap marks by chance are fetched by their identifiers.
    """
    key = F.col("item_key").cast(key_type)
    repeats = staged(repeated_payloads(converted(archives, with_payload=False), key_type, min_bytes), "repeats")
    revisits = F.col("refers_id").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~key.eqNullSafe(F.col("refers_key"))
    if repeats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        records = converted(archives).join(F.broadcast(repeats.drop("n")), "payload_digest", "left")
    else:
        heads = staged(converted(archives, with_payload=False), "heads")
        repeats = repeats.withColumnRenamed("payload_digest", "repeated")
        told = by_weight(heads, "payload_digest", repeats, "repeated", "n", heads.count()).drop("repeated").filter(revisits)
        told = staged(told, "revisits")
        ids = told.select(F.col("record_id").alias("known"))
        chance = marked(heads.filter("error IS NULL"), F.col("record_id"), ids).filter("maybe").select("record_id")
        chance = staged(chance.join(ids.hint("merge"), F.col("record_id") == F.col("known"), "left_anti").select(F.col("record_id").alias("known")), "by-chance")
        whole = converted(archives)
        stays = marked(whole, F.col("record_id"), ids).filter("NOT maybe").drop("maybe")
        stays = stays.unionByName(within(whole, "record_id", chance, "known", 0).drop("known"))
        records = stays.unionByName(told, allowMissingColumns=True)
    chosen = records.select(
        "record_id", "target_uri", "warc_date", "headers", "payload", "payload_digest", "error",
        F.when(revisits, F.col("refers_id")).alias("refers_id"), F.when(revisits, F.col("refers_key").cast("string")).alias("refers_key"), revisits.alias("revisit"), "record_type",
    )

    def run(batches):
        part, n, held, total = TaskContext.get().partitionId(), 1, [], 0
        name = lambda: f"part-{part:06d}-{n:06d}.warc.gz"

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name()], "content": pa.array([b"".join([warc_bytes(warcinfo(name())), *held])], pa.binary())})

        for batch in batches:
            for r in batch.to_pylist():
                held.append(warc_bytes(_written(r, f"{name()}#{len(held)}")))
                total += len(held[-1])
                if total > size:
                    yield archive()
                    n, held, total = n + 1, [], 0
        if held:
            yield archive()

    return staged(arrow_map(chosen, run, ARCHIVE_SCHEMA), "warc")


def _written(r: dict, place: str) -> WarcRecord:
    """The WARC record of a converted row; an error becomes a metadata record."""
    if r["error"] is not None:
        fields = {"WARC-Type": "metadata", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, place)}>", "WARC-Date": MADE, "Content-Type": "text/plain"}
        return WarcRecord(fields, r["error"].encode())
    block = r["headers"] if r["revisit"] else r["headers"] + r["payload"]
    fields = {
        "WARC-Type": "revisit" if r["revisit"] else r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["warc_date"],
        "WARC-Target-URI": r["target_uri"], "WARC-Payload-Digest": f"sha1:{r['payload_digest']}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response" if r["headers"] else "application/octet-stream",
    }
    if r["revisit"]:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": r["refers_id"]} | ({"X-Refers-To-Key": quote(r["refers_key"])} if r["refers_key"] is not None else {})
    return WarcRecord(fields, block)


def _read_row(record: WarcRecord, with_payload: bool) -> tuple | None:
    """The row of a WARC record; None for one that describes the archive."""
    kind = record.fields.get("WARC-Type")
    if kind == "warcinfo":
        return None
    if kind == "metadata":
        return (*[None] * 9, record.block.decode("utf-8", "replace"), None)
    headers, payload = split_http(record.block)
    row = _row(record, payload, headers, with_payload)
    if kind != "revisit" and digest(payload) != row[8]:
        row = (*row[:9], "digest mismatch")
    refers = record.fields.get("X-Refers-To-Key")
    return (*row, None if refers is None else unquote(refers))


def warc_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of WARC archives (``RECORD_SCHEMA`` and ``refers_to``, the key that a revisit refers to).

    A payload whose digest isn't the declared one, a malformed record, and what
    follows a broken member give a row with ``error``.  A revisit has the payload
    length of its HTTP header, null if that tells none.
    """
    names, types = [*_RECORD_NAMES, "refers_to"], [*_RECORD_TYPES, pa.string()]

    def rows(batches):
        for batch in batches:
            for content in batch.column(1).to_pylist():
                members = gzip_members(content or b"")
                while True:
                    try:
                        row = _read_row(warc_record(next(members)), with_payload)
                    except StopIteration:
                        break
                    except (ValueError, KeyError) as error:
                        row = (*[None] * 9, str(error), None)
                    if row is not None:
                        yield row

    return arrow_map(archives.select("archive", "content"), lambda b: _emit(rows(b), names, types), RECORD_SCHEMA + ", refers_to string")


def archived_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages through legacy archives to WARC archives and back; one row a page.

    Columns ``key``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, ``target_uri`` and ``warc_date``.  A null payload is empty,
    and empty payloads are equal.  A row without a key is the smallest of its
    payload; equal keys are all responses if they are the largest.
    """
    kind = pages.schema[key].dataType.simpleString()
    arcs = staged(write_arcs(pages, key, url, payload), "arc")  # read several times, by names and places that must stay
    out = warc_records(to_warc(arcs, kind), with_payload=False)
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("unreadable record: "), F.col("error"))).cast("string"))
    return out.select(
        F.coalesce(failed, F.col("item_key")).cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "target_uri", "warc_date",
    )


def archive_schema() -> T.StructType:
    """Schema of a table of archives."""
    return T._parse_datatype_string(ARCHIVE_SCHEMA)
