"""WARC archives: a writer with revisit records and a salvage reader.

Each writing task streams its rows into gzip members, one per record, in files
of about ``ROLL`` bytes below a folder all executors share.  A file appears under
its final name only when complete.  Names hold the task attempt, and the manifest
lists the files of the attempts that succeeded: what a lost attempt left behind
is not read.

The reader takes whole files (bounded by ROLL) from Spark's binaryFile source
and checks each record: gzip CRC, version line, header, length, block digest.
After a failed check it searches for the next valid member or version line,
goes on from there, and logs the bytes between as a quarantined gap.  Digests are
compared in any of their usual spellings; one of an algorithm that hashlib does
not have proves nothing and is left unchecked.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrello.store import fresh_path, keep, table

ROLL = 8 << 20
#: Payloads below this size are always full responses.
REVISIT_BYTES = 1000
#: Tasks that the rows of one payload are dealt to.
SALT = 32
#: Bytes given to the decompressor at a time.
SLICE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digest(told: str) -> tuple[str, bytes] | None:
    """Algorithm and raw digest of ``algorithm:digest``, in base 16, 32 or 64 and
    any case; None if it cannot be read."""
    kind, _, value = told.strip().partition(":")
    kind = kind.strip().lower().replace("-", "").replace("_", "")
    value = value.strip()
    if kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    size = hashlib.new(kind).digest_size
    if len(value) == 2 * size and re.fullmatch(r"[0-9a-fA-F]+", value):
        return kind, bytes.fromhex(value)
    try:
        bare = value.rstrip("=")
        if len(bare) == -(-8 * size // 5):
            return kind, base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        if len(bare) == -(-8 * size // 6):
            return kind, base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        pass
    return None


def _contradicts(told: str | None, data: bytes) -> bool:
    """Whether a declared digest can be read and is not that of ``data``."""
    known = _digest(told) if told else None
    return known is not None and hashlib.new(known[0], data).digest() != known[1]


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record with its length and block digest."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {re.sub(r'[\x00-\x20]+', '%20', v)}" for k, v in headers)]
    lines += [f"WARC-Date: {DATE}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with the payload, or a revisit that refers to another page's."""
    named = ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")
    common = [named, ("WARC-Target-URI", url or "urn:none"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    common += [("X-Payload-Length", str(len(payload)))]
    head = (_HTTP + f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        return record("response", [*common, ("Content-Type", "application/http;msgtype=response")], head + payload)
    return record("revisit", [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http;msgtype=response")], head)


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def with_roles(pages: DataFrame) -> DataFrame:
    """Add payload_digest and refers_to: of equal payloads of at least
    REVISIT_BYTES the row with the largest page_id answers, the others revisit it.

    Groups are counted on digests alone.  Payloads then meet only the digests of
    groups above one, ``SALT`` narrow copies of each, so the rows of a hot payload
    go to as many tasks; small payloads, whose digests are the commonest, meet
    nothing and are spread by their address."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text.alias("html")).withColumn("payload_digest", F.sha1(F.encode("html", "utf-8")))
    large = F.octet_length("html") >= REVISIT_BYTES
    again = rows.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = again.select(F.col("payload_digest").alias("_of"), "_top", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_at"))
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")
    salted = rows.withColumn("_key", F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))).withColumn("_salt", place)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top"))
    met = salted.join(again, (F.col("_key") == F.col("_of")) & (F.col("_salt") == F.col("_at")), "left")
    return met.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html, payload_digest,
    refers_to) below ``folder``; returns ``(file, records, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files: list[tuple[str, int, int]] = []
        out = part = None

        def close() -> None:
            nonlocal out
            if out is not None:
                files[-1] = (*files[-1][:2], out.tell())
                out.close()
                store.move(part, f"{root}/{files[-1][0]}")
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and out.tell() >= ROLL:
                    close()
                if out is None:
                    name = f"pages-{task:06d}-{attempt}-{len(files):05d}.warc.gz"
                    part = f"{root}/_{name}.part"
                    out = store.open_output_stream(part)
                    files.append((name, 0, 0))
                    out.write(member(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                out.write(member(page_record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["payload_digest"], row["refers_to"])))
                files[-1] = (files[-1][0], files[-1][1] + 1, 0)
        close()
        names, counts, sizes = zip(*files, strict=True) if files else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "file string, records long, bytes long")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at ``at``; or why it is invalid."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        return "header without end"
    headers: dict[str, str] = {}
    name = None
    for line in data[version.end() : end].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name is not None:  # the value goes on
            headers[name] = f"{headers[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return "malformed header"
        name = name.strip().lower()
        headers[name] = value.strip()
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        return "a mandatory header is missing"
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "length does not end at a record's end"
    block = data[start:stop]
    if _contradicts(headers.get("warc-block-digest"), block):
        return "block digest differs"
    return headers, block, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The member at ``at`` and its end.  The input goes in slices, so what is
    read beyond the member's end is bounded however many members follow."""
    squeeze, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not squeeze.eof and at < len(data):
            out.append(squeeze.decompress(view[at : at + SLICE]))
            at += SLICE
    except zlib.error as e:
        return f"gzip: {e}"
    return (b"".join(out), min(at, len(data)) - len(squeeze.unused_data)) if squeeze.eof else "gzip: member cut short"


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes] | tuple[int, int, str]]:
    """Records (start, end, headers, block) and gaps (start, end, reason), in order.

    Every byte of ``data`` belongs to a valid record or to a gap.  Plain records
    and gzip members may follow each other; a member may hold several records."""
    at, bad = 0, None
    while at < len(data):
        found: list[tuple[dict[str, str], bytes]] = []
        reason, end = "", at
        if data[at : at + 2] == b"\x1f\x8b":
            got = _member(data, at)
            if isinstance(got, str):
                reason = got
            else:
                inner, end = got
                place = 0
                while place < len(inner):
                    one = _parse(inner, place)
                    if isinstance(one, str):
                        reason = one
                        following = _VERSION.search(inner, place + 1)
                        place = following.start() if following else len(inner)
                    else:
                        found.append(one[:2])
                        place = one[2]
                if reason and found:  # some records of a damaged member are sound
                    yield at, end, f"inside a member: {reason}"
                    reason = ""
        else:
            one = _parse(data, at)
            if isinstance(one, str):
                reason = one
            else:
                found, end = [one[:2]], one[2]
        if found or (not reason and end > at):
            if bad:
                yield bad[0], at, bad[1]
                bad = None
            for headers, block in found:
                yield at, end, headers, block
            at = end
        else:
            bad = bad or (at, reason)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
    if bad:
        yield bad[0], len(data), bad[1]


_READ = "file string, start long, end long, gap string, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per sound record and per quarantined gap (``gap`` holds the reason).

    payload_digest is bare lower-case hex; for records that hold their payload it
    (SHA-1) and payload_bytes are computed from what was read, for revisits they are
    what the record declares, or null.  A payload that does not match its
    declared digest makes a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "end", "gap", "record_type", "record_id", "refers_to", "url", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for got in salvage(content.as_py()):
                    row = dict.fromkeys(names) | {"file": path.as_py(), "start": got[0], "end": got[1]}
                    if len(got) == 3:
                        rows.append(row | {"gap": got[2]})
                        continue
                    headers, block = got[2:]
                    kind = headers.get("warc-type")
                    row |= {"record_type": kind, "record_id": headers.get("warc-record-id"), "refers_to": headers.get("warc-refers-to"), "url": headers.get("warc-target-uri")}
                    told = headers.get("warc-payload-digest")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if _contradicts(told, payload):
                            rows.append(dict.fromkeys(names) | {"file": path.as_py(), "start": got[0], "end": got[1], "gap": "payload digest differs"})
                            continue
                        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
                        if with_payload:
                            row["payload"] = payload
                    elif kind == "revisit":
                        size, known = headers.get("x-payload-length", ""), _digest(told) if told else None
                        row |= {"payload_bytes": int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None, "payload_digest": known[1].hex() if known else None}
                    rows.append(row)
                schema = pa.schema([(n, {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(run, _READ + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back, one row per page:
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Null html is an empty payload.  Rows may repeat: every row is a record, and
    rows that repeat the answering page_id are responses as well.  A row with a
    null page_id revisits when a page with an id has its payload, and answers
    otherwise.  An empty table writes no archive."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    manifest = keep(write_archives(with_roles(pages), folder), "warc-files")
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    of = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(.*)>$", 1)
    ident = lambda c: F.when(of(c) != "", of(c)).cast(kind)
    read = read_archives(spark, folder).withColumn("file", F.substring_index("file", "/", -1))
    read = keep(read.join(manifest.select("file"), "file", "left_semi"), "warc-read")
    rows = read.where(F.col("record_type").isin("response", "revisit") & F.col("gap").isNull())
    lost = manifest.join(rows.groupBy("file").agg(F.count(F.lit(1)).alias("_read")), "file", "left").where(F.coalesce("_read", F.lit(0)) != F.col("records"))
    if not lost.isEmpty():
        raise RuntimeError(f"records of {lost.count()} archives below {folder} did not come back")
    return rows.select(ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))


def op7_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), top AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN top.top IS NULL OR top.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top.top <> p.page_id THEN top.top END AS refers_to
FROM p LEFT JOIN top USING (payload_digest)
"""
