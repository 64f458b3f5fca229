"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the sorted array of the k smallest different 64-bit hashes of a
text's five-word shingles (fewer words: the whole sequence; no word: no shingle).
With fewer than k entries it is the whole set.  The sketch of a union is the
bottom k of both, so parts of a text, or texts of a source, are sketched apart and
merged in any order.  Below the least of the two full sketches' greatest hashes
both sets are known whole; that uniform sample gives the resemblance (shared
shingles of all), the containment (shared of one's) and, with the greatest hash
itself, the number of different shingles.  The error of a share is about
sqrt(share (1 - share) / k): 0.04 at k = 128.

Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered are hashed by XXH64, the words of a
shingle are mixed in numpy; two different shingles agree with a chance of 2^-64.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrello.store import keep, table

K, WORDS = 128, 5
#: Words sketched at a time; words whose hash a task remembers.
PART, REMEMBERED = 65_536, 500_000
#: Bytes of text of one range of documents, and the most ranges.
RANGE_BYTES, MOST_RANGES = 16 << 20, 50_000
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], np.uint64)


class _WordHashes(dict):
    """XXH64 of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, WORDS)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known = _WordHashes()


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    size = min(words, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += _mixed(hashes[j : j + n]) * _ODD[j]
    return _mixed(total)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The sketch of a whole text; null and blank texts give an empty one.

    Long texts are sketched in parts that share ``words`` - 1 words and merged."""
    found = np.empty(0, np.uint64)
    if not text:
        return found
    each = text.encode("utf-8", "surrogatepass").lower().split()
    for at in range(0, max(len(each) - words + 1, min(len(each), 1)), PART):
        part = each[at : at + PART + words - 1]
        hashes = _shingles(np.fromiter(map(_known.__getitem__, part), np.uint64, len(part)), words)
        if len(found) == k:
            hashes = hashes[hashes < found[-1]]
        found = merge(found, hashes, k)
    return found


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Shared hashes, those of a and those of b, as far as both sets are known."""
    full = [x[-1] for x in (a, b) if len(x) >= k]
    if full:
        a, b = (x[: np.searchsorted(x, min(full), "right")] for x in (a, b))
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either text that are in both; 1 for two empty sets."""
    shared, na, nb = _common(a, b, k)
    return shared / (na + nb - shared) if na + nb else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are b's too; 1 if a has none."""
    shared, na, _ = _common(a, b, k)
    return shared / na if na else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def to_string(a: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, big-endian, ascending."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


# ------------------------------------------------------------------ DataFrames


def with_sketch(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """``docs`` with the sketch of each whole text as a string column.

    Null and blank texts get the empty string, equal texts equal strings; every row
    stays, repeated ones too.  A column that already has the name is replaced."""

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([to_string(sketch(t, k, words)) for t in texts], dtype=object)

    return docs.withColumn(name, told(F.col(text_col).cast("string")))


def merged(sketches: DataFrame, by: str, name: str = "fingerprint", k: int = K) -> DataFrame:
    """``(by, name)``: one sketch for everything a key's rows stand for.

    Each task first merges the rows of a key that it holds, so a key with most of
    the rows sends one sketch per task; these meet per key.  Null keys are a key of
    their own, null sketches count as empty; an empty table gives none."""
    rows = sketches.select(F.col(by).alias("by"), F.col(name).alias("s"))

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([to_string(held[x]) for x in keys], pa.string())], ["by", "s"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[key] = merge(held.get(key, np.empty(0, np.uint64)), from_string(s or ""), k)
                if len(held) > 100_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    each = rows.mapInArrow(merging, rows.schema)
    return each.repartition("by").sortWithinPartitions("by").mapInArrow(merging, rows.schema).select(F.col("by").alias(by), F.col("s").alias(name))


def estimated(kind: str, a: Column, b: Column | None = None, k: int = K) -> Column:
    """``resemblance``, ``containment`` (of a in b) or ``distinct`` (of a) as a column; null for nulls."""
    does = {"resemblance": resemblance, "containment": containment, "distinct": distinct}[kind]

    @F.pandas_udf("double")
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else does(from_string(s), from_string(t), k) for s, t in zip(x, y, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def one(x: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else does(from_string(s), k) for s in x], dtype="float64")

    return one(a) if b is None else two(a, b)


_KEY = np.dtype([("void", "i1"), ("id", "i8"), ("mark", "i8")])


def _keys(ids: np.ndarray, void: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Keys whose order is that of documents: ids descending, null ones last, then marks."""
    out = np.empty(len(ids), _KEY)
    out["void"], out["id"], out["mark"] = void, np.where(void, 0, ~ids), marks
    return out


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts dealt so that the next document's text follows each: ``(bucket, lent,
    doc_id, text)``, sorted so within partitions.

    Documents are in the order of descending ids (bigint), null ids last, ties by a
    hash of the text (mark).  Buckets are ranges of that order, cut by keys alone; the
    first document of a bucket is lent to the one before (of the first: to the last),
    where it stands behind all others.  So texts are shuffled once, and only the first
    key of each range comes to the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    keys = keep(rows.select("doc_id", "mark", F.octet_length("text").alias("size")), "sketch-keys")
    size = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                break

    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").asc()]
    first = keys.select("doc_id", "mark").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(heads, "doc_id long, mark long").collect()
    void = np.array([r[0] is None for r in first], bool)
    starts = _keys(np.array([r[0] or 0 for r in first], np.int64), void, np.array([r[1] for r in first], np.int64))
    starts = np.unique(starts)

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, marks: pa.Array) -> pa.Array:
        own = _keys(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), marks.to_numpy(zero_copy_only=False))
        at = np.searchsorted(starts, own, "right") - 1
        lent = starts[at] == own
        return pa.array([[a, (a - 1) % len(starts)] if x else [a] for a, x in zip(at.tolist(), lent.tolist(), strict=True)], pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "mark", "text", F.posexplode(places("doc_id", "mark")).alias("lent", "bucket"))
    return dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "lent", *order).select("bucket", "lent", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [(c, pa.float64()) for c in ("near_edited", "near_next", "contained_edited", "n_shingles")]
)


def _values(column: pa.Array) -> Iterator:
    """A batch's values one at a time, so that its texts are not all held twice."""
    return (x.as_py() for x in column)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """One row per document: ``(doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, contained_edited, n_shingles)``.

    Compared are the document with its edited text and with the next document, by
    descending doc_id (see ``beside_next``; after the last the first).  Null texts are
    empty; two texts without a word resemble each other fully, one and another not
    at all.  Rows that repeat an id and a text are one document: each gets a row, and the
    next is the next different one; a sole document is its own next.  An empty table gives
    no rows.  Only the two columns named are read, so others cannot clash."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # bucket, doc_id, text and sketch of the document whose next one is awaited
        times = 0  # rows that repeat it

        def row(following: str, beside: np.ndarray) -> tuple:
            _, ident, text, own = held
            changed = edited(text, following)
            other = sketch(changed, k, words)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            likeness = resemblance(own, other, k), resemblance(own, beside, k), containment(own, other, k), distinct(own, k)
            return ident, len(text), digest, to_string(own), to_string(other), *likeness

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _RESULT.types, strict=True)], schema=_RESULT)
            out.clear()
            return done

        for batch in batches:
            for bucket, lent, ident, text in zip(*(_values(c) for c in batch.columns), strict=True):
                if held is None and lent:
                    continue  # a repeat of what has closed its bucket
                if held and held[0] != bucket:
                    raise RuntimeError("a range of documents ends without the first of the next")
                if held and not lent and held[1:3] == (ident, text):
                    times += 1
                    continue
                own = sketch(text, k, words)
                if held:
                    out.extend([row(text, own)] * times)
                held, times = (None, 0) if lent else ((bucket, ident, text, own), 1)
                if len(out) >= 512:
                    yield flush()
        if held:
            raise RuntimeError("a range of documents ends without the first of the next")
        if out:
            yield flush()

    return beside_next(docs, id_col, text_col).mapInArrow(tell, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, n_shingles double")


def op11_bottom_k_sketch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
