"""WARC archives: writing with revisit records, and a salvage reader.

Reading: a record is taken when its version line, header block and length
hold together and its payload matches its digest. After a failed check the
reader searches for the next version line (or, in compressed files, for the
next valid gzip member), goes on there, and logs the bytes between as a
quarantined gap. No byte is unaccounted for: records and gaps tile the file.

Writing goes through Spark's own text sink, so it reaches any store that Spark
can open: records end in two line breaks, which serve as the sink's line
separator, and each row holds records of about ``ROW_BYTES``.

Scale: each task writes files of up to about ``FILE_BYTES``; each file is read by one
task. Of equal payloads only digests and numbers are shuffled to find the one
that is written whole.

Defined results: a null html is an empty payload; payloads under
``REVISIT_BYTES`` are always responses; rows that repeat page_id and payload
are all responses when they hold the largest page_id; a null page_id gives
records without a page number (smallest of its group); a null url leaves the
target out; no rows in, no rows out. A header that can't be read (lengths,
digests, ids of any form) makes a gap, never a failed job; an id that isn't a
page's gives a record without a page number.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.skew import spread_join
from stowage.llm.words import rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import Scratch, table

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
#: Records that go to the sink as one row, at about so many bytes.
ROW_BYTES = 1 << 20
#: What a gzip member may hold: no row holds more.
MEMBER_BYTES = (1 << 31) - 1
#: Lengths have this many digits at most: nothing is longer than 2**63.
LENGTH_DIGITS = 19
#: Groups of equal payloads are broadcast up to this size, at so many bytes each; beyond it they are joined by shuffling.
BROADCAST_BYTES = 32 << 20
KEY_BYTES = 160
ID_PREFIX = "urn:page:"
_ID = re.compile(rf"<?{re.escape(ID_PREFIX)}(-?[0-9]{{1,{LENGTH_DIGITS}}})>?")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def header_value(text: str) -> str:
    """One line: line breaks and percent signs are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain_value(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def label_digest(label: str) -> bytes | None:
    """The digest of a ``sha1:`` label in base 32 or hexadecimal digits; None if it is neither."""
    digits = label[len("sha1:") :].strip()
    try:
        made = bytes.fromhex(digits) if len(digits) == 40 else base64.b32decode(digits, casefold=True)
    except ValueError:
        return None
    return made if len(made) == 20 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record without the two line breaks that end it."""
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {sha1_label(digest)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return VERSION + "\r\n".join(lines).encode() + END + body


def member(data: bytes) -> bytes:
    """A record as a gzip member of its own, with the line breaks that end it."""
    maker = zlib.compressobj(6, zlib.DEFLATED, 31)
    return maker.compress(data + END) + maker.flush()


class Bad(ValueError):
    """A record that fails a check."""


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; ``Bad`` if it fails a check."""
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    split = data.find(END, at)
    if split < 0:
        raise Bad("header block without an end")
    fields = {}
    for line in data[at + len(VERSION) : split].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without a colon")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "").lstrip("0") or "0"
    if "content-length" not in fields or not (length.isascii() and length.isdigit()):
        raise Bad("no content length")
    start = split + len(END)
    stop = start + int(length) if len(length) <= LENGTH_DIGITS else len(data)
    if not data.startswith(END, stop):
        raise Bad("content not followed by its end")
    payload = data[start:stop]
    kind = fields.get("warc-type")
    if kind is None:
        raise Bad("no record type")
    digest = fields.get("warc-payload-digest", "")
    if digest.lower().startswith("sha1:"):
        told = label_digest(digest)
        if told is None:
            raise Bad("a digest that can't be read")
        if kind != "revisit" and told != hashlib.sha1(payload).digest():
            raise Bad("payload doesn't match its digest")
    return fields | {"payload": payload}, stop + len(END)


def unzip(data: bytes, at: int) -> tuple[bytes, int]:
    reader = zlib.decompressobj(31)
    out, size = [], 0
    try:
        while not reader.eof and at < len(data):
            out.append(reader.decompress(data[at : at + (1 << 16)]))
            at += 1 << 16
            size += len(out[-1])
            if size > MEMBER_BYTES:
                raise Bad("member too large")
    except zlib.error as e:
        raise Bad(str(e)) from None
    if not reader.eof:
        raise Bad("member without an end")
    return b"".join(out), min(at, len(data)) - len(reader.unused_data)


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[str, int, int, dict | str]]:
    """('record', start, end, fields) and ('gap', start, end, reason), which tile ``data`` in order.

    Positions in compressed files are those of the members; members in members aren't opened.
    """
    at = lost_from = 0
    reason = ""
    next_version = -1
    while at < len(data):
        try:
            if members and data.startswith(MEMBER, at):
                plain, end = unzip(data, at)
                inner = list(salvage(plain, False))
                if not inner:
                    raise Bad("empty member")
                found = [(kind, at, end, x) for kind, _, _, x in inner]
            else:
                fields, end = parse(data, at)
                found = [("record", at, end, fields)]
            if lost_from < at:
                yield "gap", lost_from, at, reason
            yield from found
            at = lost_from = end
            reason = ""
        except Bad as e:
            reason = reason or str(e)
            if next_version <= at:
                next_version = data.find(VERSION, at + 1) % (len(data) + 1)  # none: where the data end
            next_member = data.find(MEMBER, at + 1, next_version) if members else -1
            at = next_version if next_member < 0 else next_member
    if lost_from < len(data):
        yield "gap", lost_from, len(data), reason


def plan(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to`` set for those that revisit another's payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= least
    keyed = rows.withColumn("key", F.when(large, F.sha2("payload", 256)))
    first = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = Scratch(pages.sparkSession).store(first.select("key", "first_id"), "first")
    if first.count() * KEY_BYTES <= BROADCAST_BYTES:  # then payloads needn't move to find their group
        joined = keyed.join(F.broadcast(first), "key", "left")
    else:
        keys = Scratch(pages.sparkSession).store(keyed.select("key"), "keys")
        joined = spread_join(keyed, first, ["key"], "left", like=keys)
    # of a group without any page number none can be referred to
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"))


def write(planned: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per row of ``plan()``'s result below ``path``."""

    def run(batches: Iterable[pa.RecordBatch]):
        held: list[bytes] = []
        size = 0
        # html comes as text, so records are UTF-8
        out = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary()).view(pa.string())], names=["value"])
        for batch in rows_by_bytes(batches, 2):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to, refers_to is not None))
                size += len(held[-1])
                if size >= row_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    row_bytes = min(ROW_BYTES, file_bytes)
    rows = planned.select("page_id", "url", "payload", "refers_to").mapInArrow(lean(run), "value string")
    rows.write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, file_bytes // row_bytes)).text(path)


def number(name: str) -> int | None:
    """The page number of a record id; None if it has none, or one that no 64-bit number holds."""
    found = _ID.fullmatch(name)
    value = int(found[1]) if found else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


RECORDS = "file string, start long, end long, kind string, page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary, reason string"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record and every quarantined gap (``kind``) of the archives below ``path``."""

    schema = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string())]
        + [("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())]
    )

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for kind, start, end, x in salvage(data.as_py()):
                    if kind == "gap":
                        rows.append((file, start, end, kind, None, None, None, None, None, None, None, x))
                        continue
                    body, label = x["payload"], x.get("warc-payload-digest", "")
                    revisit = x["warc-type"] == "revisit"
                    digest = label_digest(label).hex() if revisit and label.lower().startswith("sha1:") else hashlib.sha1(body).hexdigest()
                    uri = x.get("warc-target-uri")
                    rows.append((file, start, end, kind, number(x.get("warc-record-id", "")), None if uri is None else plain_value(uri), x["warc-type"], number(x.get("warc-refers-to", "")), digest, None if revisit else len(body), body if with_payload else None, None))
                    held += len(body) if with_payload else 100
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("path", "content").mapInArrow(lean(run), RECORDS)


def gaps(found: DataFrame) -> DataFrame:
    """(file, reason, gaps, bytes) of the quarantined gaps among ``read``'s rows."""
    lost = found.where("kind = 'gap'")
    return lost.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


def report_gaps(found: DataFrame, shown: int = 100) -> None:
    """Logs the files and reasons with the most quarantined bytes."""
    for r in gaps(found).orderBy(F.col("bytes").desc(), "file", "reason").limit(shown).collect():
        logging.getLogger("stowage").warning("%s: %d gaps of %d bytes quarantined: %s", r["file"], r["gaps"], r["bytes"], r["reason"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("warc")
    write(plan(table(spark, sf_dir, "pages")), path)
    found = scratch.store(read(spark, path, with_payload=False).select("file", "start", "end", "kind", "page_id", "record_type", "refers_to", "digest", "payload_bytes", "reason"), "records")
    report_gaps(found)
    found = found.where("kind = 'record'").select("page_id", "record_type", "refers_to", "digest", "payload_bytes")
    scratch.drop("warc")
    sizes = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest"), F.col("payload_bytes").alias("full")).dropDuplicates(["refers_to", "digest"])
    # a revisit's length is that of the response which it names
    revisits = spread_join(found.where("record_type = 'revisit'"), sizes, ["refers_to", "digest"], "left").withColumn("payload_bytes", F.col("full"))
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
     g as (select body, max(page_id) as first_id from p where octet_length(body) >= 1000 group by body)
select page_id, octet_length(p.body)::bigint as payload_bytes, sha1(p.body) as payload_digest,
       case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
       case when first_id <> page_id then first_id end as refers_to
from p left join g on p.body = g.body
"""
