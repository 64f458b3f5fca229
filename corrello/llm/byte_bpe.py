"""Byte-level BPE by overlapping chunks, and decoding.

Pre-tokens are found by a pattern that looks ahead a little and never behind, so
a scan that starts anywhere agrees with the true scan from the first place where
both begin a match.  A long text is therefore cut into overlapping chunks that
are scanned apart (in parallel: chunks of long texts are dealt over the
cluster); each scan's first boundaries are doubtful until it meets one of its
predecessor's in the overlap, and its last match may be cut short.  Stitching
keeps what is certain; where two scans never meet in the overlap (one run longer
than it) the predecessor's last boundary is continued by a direct scan.  Pieces
between boundaries are then encoded one by one and remembered.

Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corrello.store import keep, table

#: Code points of a chunk and of its overlap with the next; texts up to
#: CHUNK + OVERLAP are one chunk.
CHUNK, OVERLAP = 32_768, 512
#: A match this near a chunk's end may depend on text beyond it.
DOUBT = 3
#: Pieces whose ids a worker remembers in each of two generations.
CACHE = 400_000
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ids of pre-tokens under a rank file, remembered; bytes of ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self.scan = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, pieces: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of pre-tokens, each by itself."""
        try:
            return b"".join([self.young[p] for p in pieces])
        except KeyError:
            if len(self.young) > CACHE:  # the young generation becomes the old one
                self.old, self.young = self.young, {}
            young, old, encode = self.young, self.old, self.bpe.encode_ordinary
            for p in pieces:
                if p not in young:
                    young[p] = old.get(p) or np.array(encode(p), "<u4").tobytes()
            return b"".join([young[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def chunk_starts(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    return list(range(0, max(1, length - overlap), chunk))


def boundaries(scan, part: str, start: int, last: bool) -> np.ndarray:
    """Ends of the matches in one chunk that do not depend on text beyond it,
    counted from the text's start; the first is the chunk's own start."""
    ends = np.fromiter((m.end() for m in scan.finditer(part)), np.int64)
    if not last:
        ends = ends[ends <= len(part) - DOUBT]
    return np.concatenate(([start], ends + start))


def stitch(scan, text: str, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """All boundaries of ``text`` from those of its chunks, in order of start."""
    done = [parts[0][1]]
    for _, found in parts[1:]:
        known = done[-1]
        tail = known[known >= found[0]]
        meet = np.intersect1d(tail, found)
        at = int(known[-1])
        while not len(meet):  # go on scanning from the last certain boundary until the chunk's scan is met
            match = scan.match(text, at)
            if match is None or match.end() > found[-1]:
                break
            at = match.end()
            done.append(np.array([at]))
            meet = np.intersect1d([at], found)
        if len(meet):
            first = int(meet[0])
            whole = np.concatenate(done)
            done = [np.concatenate((whole[whole <= first], found[found > first]))]
        else:
            done = [np.concatenate(done)]
    edge = int(done[-1][-1])
    rest = [m.end() for m in scan.finditer(text, edge)] if edge < len(text) else []
    return np.concatenate([*done, np.array(rest, np.int64)]).astype(np.int64)


def pre_tokens(scan, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pattern's matches in ``text``, by way of overlapping chunks."""
    if len(text) <= chunk + overlap:
        return scan.findall(text)
    starts = chunk_starts(len(text), chunk, overlap)
    parts = [(s, boundaries(scan, text[s : s + chunk + overlap], s, s == starts[-1])) for s in starts]
    return _cut(text, stitch(scan, text, parts))


def _cut(text: str, ends: np.ndarray) -> list[str]:
    at = ends.tolist()
    return [text[s:e] for s, e in zip(at, at[1:], strict=False)]


def _digest(code: Codec, pieces: list[str]) -> tuple[int, str, str]:
    ids = code.encode(pieces)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])`` per row of ``docs``.

    Null and empty texts have no tokens.  Rows may repeat.  Texts longer than a
    chunk go the way of dealt chunks: only they are shuffled, by a key of row
    and chunk, and each row's chunk boundaries come together again with its text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def result(ids: pa.Array, pieces_of: list[list[str]]) -> pa.RecordBatch:
        code = codec(path, pattern)
        rows = [_digest(code, p) for p in pieces_of]
        cols = [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
        if with_ids:
            cols.append(pa.array([np.frombuffer(code.encode(p), "<u4").astype(np.int32) for p in pieces_of], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = codec(path, pattern).scan
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield result(part.column(0), [scan.findall(t.as_py() or "") for t in part.column(1)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = codec(path, pattern).scan
        for batch in batches:
            found = []
            for part, start, last in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                found.append(boundaries(scan, part, start, last))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, pa.list_(pa.int64()))], ["_row", "start", "ends"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = codec(path, pattern).scan
        for batch in batches:
            pieces = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                order = sorted((p["start"], np.array(p["ends"], np.int64)) for p in parts)
                pieces.append(_cut(text, stitch(scan, text, order)))
            yield result(batch.column(0), pieces)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > CHUNK + OVERLAP, F.lit(False))
    brief = rows.where(~is_long).mapInArrow(short, out)
    # equal long texts have equal tokens: they are encoded once and given back to every row
    big = rows.where(is_long).withColumn("_row", F.sha2(F.encode("text", "utf-8"), 256))
    texts = keep(big.select("_row", "text").dropDuplicates(["_row"]), "bpe-long")
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - OVERLAP - 1, F.lit(0)), F.lit(CHUNK))
    chunks = texts.select("_row", F.length("text").alias("n"), "text", F.explode(starts).alias("start"))
    part = F.substring("text", F.col("start") + 1, F.lit(CHUNK + OVERLAP))
    chunks = chunks.select("_row", "n", part.alias("part"), F.col("start").cast("long").alias("start"), (F.col("start") + CHUNK + OVERLAP >= F.col("n")).alias("last"))
    dealt = chunks.repartition("_row", "start").mapInArrow(spread, "_row string, start long, ends array<long>")
    whole = dealt.groupBy("_row").agg(F.collect_list(F.struct("start", "ends")).alias("parts"))
    encoded = texts.join(whole, "_row").select(F.col("_row").alias("doc_id"), "text", "parts").mapInArrow(joined, out.replace(f"doc_id {kind}", "doc_id string", 1))
    names = [c for c in brief.columns if c != "doc_id"]
    given = big.select("doc_id", "_row").join(encoded.withColumnRenamed("doc_id", "_row"), "_row").select("doc_id", *names)
    return brief.union(given)


def decode_ids(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary), the concatenated bytes of each row's ids; null stays null."""
    schema = StructType([*rows.schema.fields, StructField("decoded", BinaryType())])
    at, names = rows.columns.index(ids_col), [*rows.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in batches:
            raw = [None if x is None else b"".join(map(code.bytes_of.__getitem__, x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names)

    return rows.mapInArrow(run, schema)


def op4_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
