"""WARC archives: a writer, and a reader that salvages what it can from damaged files.

The reader takes a record for good only if its header parses, its block has the stated length, the record's end
follows, and its digests fit. After a failed check it searches for the next valid gzip member or version line, goes on
there, and logs the bytes in between as a quarantined gap. Text inside a valid record is never taken for a record.
A gzip member that breaks off, or holds bad records among good ones, gives its good ones; a lone record whose member's checksum
fails isn't taken, since its header may be what is damaged.

Archives are written as files of ``records_per_file`` records, each record a gzip member of its own, so that damage costs
the records it touches. The reader holds one archive at a time in a task.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import lookup, slices, tidy

#: Payloads from this many bytes on are written once and revisited.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 500
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Packed bytes that are unpacked at once; a piece that turns out to be damaged is unpacked again byte by byte.
_PIECE = 1 << 16
#: Unpacked bytes of a member whose records are larger than this end in an empty member (see ``write``).
_SMALL = 1 << 24
_EMPTY = gzip.compress(b"", mtime=0)
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_URN = "urn:page:"
_SCHEMA = "path string, offset long, inner long, length long, kind string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


@dataclass
class Record:
    """A valid record: where it was (``inner``: in the unpacked member), its fields (names in lower case) and its block."""

    offset: int
    length: int
    fields: dict[str, str]
    block: bytes
    inner: int = 0

    @property
    def payload(self) -> bytes:
        if self.fields.get("content-type", "").startswith("application/http"):
            head, found, body = self.block.partition(_END)
            return body if found else self.block
        return self.block


@dataclass
class Gap:
    """Bytes that hold no valid record, and the first check that failed there."""

    offset: int
    length: int
    reason: str
    inner: int = 0


@dataclass
class _Bad(Exception):
    reason: str = field(default="")


def _digest_fits(stated: str, data: bytes) -> bool:
    name, _, value = stated.partition(":")
    if name.lower() != "sha1":
        return True  # an algorithm that isn't checked
    own = hashlib.sha1(data)
    if len(value) == 40:
        return value.lower() == own.hexdigest()
    import base64

    return value.upper() == base64.b32encode(own.digest()).decode()


def _plain(data: bytes, at: int) -> Record:
    """The record whose version line is at ``at``."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise _Bad("no version line")
    line = data.index(b"\r\n", at) + 2
    end = data.find(_END, line - 2)
    if end < 0:
        raise _Bad("header has no end")
    fields: dict[str, str] = {}
    try:
        lines = data[line:end].decode("utf-8").split("\r\n") if end > line else []
    except UnicodeDecodeError:
        raise _Bad("header isn't UTF-8") from None
    last = ""
    for x in lines:
        if x[:1] in " \t" and last:
            fields[last] += " " + x.strip()
            continue
        name, colon, value = x.partition(":")
        if not colon or not name or re.search(r"[\s\x00-\x1f]", name) or re.search(r"[\x00-\x08\x0a-\x1f\x7f]", value):
            raise _Bad("header line isn't a field")
        last = name.lower()
        fields[last] = value.strip()
    for needed in ("warc-type", "warc-record-id", "content-length"):
        if needed not in fields:
            raise _Bad(f"no {needed}")
    if not re.fullmatch(r"\d{1,18}", fields["content-length"]):
        raise _Bad("length isn't a number")
    begin, n = end + 4, int(fields["content-length"])
    if data[begin + n : begin + n + 4] != _END:
        raise _Bad("block doesn't end where its length says")
    record = Record(at, begin + n + 4 - at, fields, data[begin : begin + n])
    if not _digest_fits(fields.get("warc-block-digest", ""), record.block):
        raise _Bad("block digest differs")
    if fields["warc-type"] != "revisit" and not _digest_fits(fields.get("warc-payload-digest", ""), record.payload):
        raise _Bad("payload digest differs")
    return record


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` unpacks to, where it ends (or fails), and what is wrong with it ('' if nothing)."""
    unpack, pieces, pos = zlib.decompressobj(31), [], at
    while not unpack.eof and pos < len(data):
        before, piece = unpack.copy(), data[pos : pos + _PIECE]
        try:
            pieces.append(unpack.decompress(piece))
        except zlib.error:
            for k in range(len(piece)):
                try:
                    pieces.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    return b"".join(pieces), pos + k, "gzip member is damaged"
            raise
        pos += len(piece)
    if not unpack.eof:
        return b"".join(pieces), len(data), "gzip member has no end"
    return b"".join(pieces), pos - len(unpack.unused_data), ""


def _salvage_plain(data: bytes) -> Iterator[Record | Gap]:
    at, size = 0, len(data)
    while at < size:
        begin, reason, record = at, "", None
        while at < size:
            try:
                record = _plain(data, at)
                break
            except _Bad as bad:
                reason = reason or bad.reason
                at = data.find(b"WARC/1.", at + 1)
                if at < 0:
                    at = size
        if at > begin:
            yield Gap(begin, at - begin, reason)
        if record is not None:
            yield record
            at = record.offset + record.length


def _at(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """What begins at ``at``: a record, or records and gaps of a gzip member; where that ends; and what cut it short ('' if nothing).

    Raises _Bad if there is nothing good. A member's records all have its place and length, and ``inner`` says where they were in it.
    """
    if not data.startswith(_MAGIC, at):
        record = _plain(data, at)
        return [record], at + record.length, ""
    plain, end, wrong = _unpack(data, at)
    if not plain and not wrong:
        return [], end, ""  # an empty member
    found = list(_salvage_plain(plain))
    if wrong and found and isinstance(found[-1], Gap):
        found.pop()  # cut off by the damage, which is reported in the archive's own bytes
    elif wrong and len(found) == 1:
        raise _Bad(wrong)  # the block is whole, so it is the header (which has no digest) or the member's checksum
    if not any(isinstance(x, Record) for x in found):
        raise _Bad(wrong or found[0].reason)
    for x in found:
        x.inner, x.offset, x.length = x.offset, at, end - at
    return found, end, wrong


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Valid records and gaps of an archive, in order; together they cover every byte.

    Plain records, members of one record (as the standard has it) and members of many are read. Of a damaged member the
    records before the damage are good, and a gap follows; an empty member counts as the end of what is before it.
    """
    at, size = 0, len(data)
    while at < size:
        begin, reason, found, end = at, "", [], size
        while at < size:
            try:
                found, end, wrong = _at(data, at)
                break
            except _Bad as bad:
                reason = reason or bad.reason
                m = _START.search(data, at + 1)
                at = m.start() if m else size
        if at > begin:
            yield Gap(begin, at - begin, reason)
        if at == size:
            return
        while not wrong and data.startswith(_EMPTY, end):  # take empty members with what is before them
            end += len(_EMPTY)
        for x in found:
            if x.offset + x.length < end:
                x.length = end - x.offset
        yield from found
        if not found:
            yield Gap(at, end - at, "empty gzip member")
        at = end
        if wrong:  # the rest of the member is searched for other starts
            m = _START.search(data, at)
            begin, at = at, m.start() if m else size
            if at > begin:
                yield Gap(begin, at - begin, wrong)


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, compress: bool = False) -> bytes:
    """One record as ``write`` lays it out, for archives made outside Spark; ``compress``: as a gzip member of its own."""
    digest = hashlib.sha1(payload).hexdigest()
    block = _HTTP.encode() + (b"" if kind == "revisit" else payload)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{digest}\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nPayload-Length: {len(payload)}\r\n"
    if refers_to is not None:
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{refers_to}>\r\n"
    whole = (head + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + _END
    return gzip.compress(whole, mtime=0) if compress else whole


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with the payload, its digest and size, record_type and refers_to (a page_id).

    Of rows with equal payloads of at least ``revisit_bytes``, the ones with the largest page_id are responses and
    the others revisit it. A null html is an empty payload. A null page_id is never the largest; if a group has no other,
    all are responses. Repeated rows each give a row, an empty table none. Only payloads that repeat are looked up, those of very many pages by broadcast.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = rows.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("size") >= revisit_bytes, F.col("page_id"))).alias("first")).where("rows > 1")
    found = lookup(rows, groups, ["digest", "size"], F.xxhash64("page_id", "url").cast("string"), pages.count())
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _packed(batches):
    """Each record as a gzip member without its last byte, which is 0 (the upper byte of a size below 16 MB)."""
    for batch in batches:
        for part in slices(batch, 4 << 20, "value"):
            out = []
            for record in part.column("value").to_pylist():
                plain = record.encode()
                member = gzip.compress(plain, 6, mtime=0) + (_EMPTY if len(plain) >= _SMALL else b"")
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(planned: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "none") -> None:
    """Write planned records as WARC 1.1 files under ``path``, through Spark's own text sink (any store it can write to).

    ``compression`` "gzip" makes each record a gzip member of its own. Null and empty payloads are records of no bytes; repeated
    rows are repeated records; a null page_id is written as ``none``, a null url as ``about:blank``. An empty table
    writes no record.
    """
    line = "\r\n"
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(_HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("about:blank"))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), "record_type", F.lit(f"{line}WARC-Record-ID: <{_URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(f">{line}WARC-Date: 1970-01-01T00:00:00Z{line}WARC-Target-URI: "), uri,
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), "digest", F.lit(f"{line}WARC-Block-Digest: sha1:"), F.sha1(block), F.lit(f"{line}Payload-Length: "), F.col("size").cast("string"), F.lit(line),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <{_URN}"), F.col("refers_to").cast("string"), F.lit(f">{line}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{line}Content-Length: "), F.octet_length(block).cast("string"), F.lit(line + line), block, F.lit(line),
    )
    records, end = planned.select(head.alias("value")), line
    if compression == "gzip":  # a binary column cast to a string keeps its bytes, and the sink writes them as they are
        whole = records.select(F.concat("value", F.lit(line)).alias("value"))
        records, end = whole.mapInArrow(tidy(_packed), "value binary").select(F.col("value").cast("string").alias("value")), "\x00"
    elif compression != "none":
        raise ValueError(f"compression: none or gzip, not {compression}")
    records.write.option("lineSep", end).option("maxRecordsPerFile", records_per_file).text(path)


def _row(name: str, x: Record | Gap, payloads: bool) -> dict:
    if isinstance(x, Gap):
        return {"path": name, "offset": x.offset, "inner": x.inner, "length": x.length, "kind": "gap", "reason": x.reason}
    f, payload = x.fields, x.payload
    again = f["warc-type"] == "revisit"
    stated = f.get("payload-length", "")
    digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None
    return {
        "path": name, "offset": x.offset, "inner": x.inner, "length": x.length, "kind": "record", "record_type": f["warc-type"], "record_id": f["warc-record-id"].strip("<>"), "target_uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest if again else hashlib.sha1(payload).hexdigest(), "payload_bytes": (int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None) if again else len(payload), "payload": payload if payloads and not again else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (``kind``) of all archives under ``path``.

    Of a record: where it is, its fields, payload digest and size: of the payload itself, or of a revisit as it states them (null
    where it doesn't, or not as a number). Of a gap: where it is and the first check that failed. Repeated records give repeated
    rows. Empty files, and folders without files of records, give no rows.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for x in salvage(data.as_py()):
                    rows.append(_row(name, x, payloads))
                    if len(rows) >= 200:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(k, types[t]) for k, t in (x.split() for x in _SCHEMA.split(", "))])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidy(run), _SCHEMA)
