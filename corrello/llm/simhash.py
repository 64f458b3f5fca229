"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Fingerprints of equal texts are equal, so everything after fingerprinting works
on *distinct* fingerprints; a text copied a million times costs one row.

Two fingerprints link at Hamming distance <= 3.  Cut the 64 bits into three
blocks.  At distance <= 3 some block holds at least a third of the differing
bits, so with that block left out the rest differs in at most 2 bits.  For each
of the three choices a fingerprint emits every variant of the kept bits within
half of that radius, i.e. 1 flip: 44 + 43 + 44 = 131 variants.  Two linked
fingerprints always meet in a common variant.  (Variants of all 64 bits within
half of 3, rounded up to 2, would be 2,081 per fingerprint.)  Variants are
shuffled, and the colliding fingerprints of one variant are verified exactly.

Within a variant no list of pairs is written: each task keeps a union-find and
emits only the edges that join two trees, so the edge count is below the number
of fingerprints it saw.  Buckets above ``BRUTE`` members use an exact linear
probe instead of comparing all members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from corrello.operators.components import connected_components
from corrello.store import keep, table

RADIUS = 3
#: Fingerprints with more than one in so many rows are hot.
HOT = 1000
#: (shift, bits) of the three blocks.
BLOCKS = ((0, 21), (21, 22), (43, 21))
#: Members of one variant up to which all of them are compared in one numpy step.
BRUTE = 1024
#: Shingles hashed at a time and entries of a task's union-find before it starts afresh.
STEP, FOREST = 65_536, 1_000_000
FULL = (1 << 64) - 1


def fingerprint(text: str | bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text (see ``fingerprints``); 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    k, n = words_per_shingle, max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: Column) -> DataFrame:
    """``(doc_id, others..., fp)`` for every row: 3-word shingles, XXH64 seed 42, majority bit.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space,
    and fewer than three words form one shingle.  Null and empty texts get 0.
    Bytes are read as they are stored, valid UTF-8 or not.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), *others)
    names = [*rows.columns[1:], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            stored = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            fps = np.array([fingerprint(t.as_py()) for t in stored], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], StructField("fp", LongType())]))


def _ball() -> list[tuple[int, np.uint64, np.ndarray]]:
    """For each left-out block: its number, the mask of the kept bits, the flips."""
    out = []
    for j, (shift, bits) in enumerate(BLOCKS):
        mask = FULL ^ (((1 << bits) - 1) << shift)
        flips = [0] + [1 << b for b in range(64) if mask >> b & 1]
        out.append((j, np.uint64(mask), np.array(flips, np.uint64)))
    return out


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ball = _ball()
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(all_fps), 4096):
            fps = all_fps[at : at + 4096]
            for j, mask, flips in ball:
                keys = ((fps & mask)[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), j, np.int8)), pa.array(np.repeat(fps, len(flips)).view(np.int64))],
                    ["key", "part", "fp"],
                )


class _Forest:
    """Union-find that reports an edge only when it joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))

    def join_all(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            self.join(a, b)


def _link_small(fps: np.ndarray, forest: _Forest) -> None:
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
    left, right = np.nonzero(np.triu(near, 1))
    forest.join_all(fps[left], fps[right])


def _link_large(fps: np.ndarray, part: int, key: int, forest: _Forest) -> None:
    """All members are within one flip of the variant in the kept bits, so the
    kept bits of two members differ in 0, 1 or 2 places.  What is left for the
    left-out block x decides; each case is a lookup of x or of the fingerprint."""
    shift, bits = BLOCKS[part]
    fps = np.sort(fps)
    x = (fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    values, first = np.unique(x, return_index=True)
    heads = fps[first]
    forest.join_all(fps, heads[np.searchsorted(values, x)])  # equal x: kept bits differ in <= 2

    def look(xs: np.ndarray, own: np.ndarray, flip: int) -> None:
        want = xs ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(values, want), len(values) - 1)
        hit = values[at] == want
        forest.join_all(own[hit], heads[at[hit]])

    for b in range(bits):  # one bit of x: kept bits may differ in 2
        look(values, heads, 1 << b)
    centre = (fps & ~np.uint64(((1 << bits) - 1) << shift)) == np.uint64(key)
    for pair in combinations(range(bits), 2):  # two bits of x: kept bits may differ in 1, so one is the centre
        look(x[centre], fps[centre], sum(1 << b for b in pair))
    for weight in (2, 3):  # the same kept bits
        for some in combinations(range(bits), weight):
            want = fps ^ np.uint64(sum(1 << b for b in some) << shift)
            at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
            hit = fps[at] == want
            forest.join_all(fps[hit], want[hit])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = _Forest()

    def table() -> pa.RecordBatch:
        edges = np.array(forest.edges, np.uint64).reshape(-1, 2).view(np.int64)
        forest.edges = []
        if len(forest.up) > FOREST:
            forest.up = {}
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    def link(part: int, key: int, fps: np.ndarray) -> None:
        (_link_small(fps, forest) if len(fps) <= BRUTE else _link_large(fps, part, key, forest))

    held: tuple[int, int, list[np.ndarray]] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        key, fp = key.view(np.uint64), fp.view(np.uint64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        if held and held[:2] == (int(part[0]), int(key[0])):
            held[2].append(fp[: ends[0]])
            if len(starts) == 1:
                continue
            starts, ends = starts[1:], ends[1:]
        if held and sum(map(len, held[2])) > 1:
            link(held[0], held[1], np.concatenate(held[2]))
        held = (int(part[starts[-1]]), int(key[starts[-1]]), [fp[starts[-1] :].copy()])
        starts, ends = starts[:-1], ends[:-1]
        size = ends - starts
        two = starts[size == 2]
        left, right = fp[two], fp[two + 1]
        near = np.bitwise_count(left ^ right) <= RADIUS
        forest.join_all(left[near], right[near])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            link(int(part[s]), int(key[s]), fp[s:e])
        if forest.edges:
            yield table()
    if held and sum(map(len, held[2])) > 1:
        link(held[0], held[1], np.concatenate(held[2]))
    yield table()


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints at distance <= 3, reduced
    to a forest per task: the same connected classes as all links."""
    variants = distinct_fps.select("fp").mapInArrow(_variants, "key long, part byte, fp long")
    dealt = variants.repartition("key").sortWithinPartitions("part", "key")
    return dealt.select("part", "key", "fp").mapInArrow(_links, "a long, b long").distinct()


def _with_classes(fps: DataFrame) -> DataFrame:
    """Add component_id (least doc_id of the class) and class_fp (one per class) to
    rows with doc_id and fp, which must be a written table.

    A fingerprint with more than a thousandth of all rows is hot; there are fewer
    than HOT of them whatever the data, so their classes are broadcast, and the
    rows of all others are dealt by fingerprint."""
    nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    classes = connected_components(fingerprint_links(nodes)).select(F.col("node").alias("fp"), "component")
    linked = nodes.join(classes, "fp", "left").withColumn("class_fp", F.coalesce("component", "fp"))
    lowest = linked.groupBy("class_fp").agg(F.min("first_id").alias("component_id"))
    owner = keep(linked.join(lowest, "class_fp").select("fp", "n", "class_fp", "component_id"), "simhash-owner")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > total / HOT
    common = F.broadcast(owner.where(hot).drop("n"))
    rest = fps.join(F.broadcast(owner.where(hot).select("fp")), "fp", "left_anti").join(owner.where(~hot).drop("n"), "fp")
    return rest.unionByName(fps.join(common, "fp"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint is reachable over
    links, the row's own included.  Texts without words share fingerprint zero.
    Rows with a null doc_id are classed like any other; a class of nulls only
    has a null component_id.  Repeated rows stay repeated, an empty table gives no rows,
    and columns other than the two named are not read, so none clashes.
    """
    rows = _with_classes(keep(fingerprints(docs, id_col, text_col), "simhash-fps"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest doc_id stays.

    Rows without a doc_id come behind all others of their class, so such a row stays
    only where no row with an id is like it.  If rows of a class share the id, the one
    with the least hash of its text stays, then of all its columns: which row it is does
    not depend on how rows are dealt.  Rows that share a doc_id but not a class are each
    judged in their own.  An empty table stays empty; rows keep all their columns."""
    mark = F.xxhash64("text").alias("mark")
    rows = _with_classes(keep(fingerprints(docs, "doc_id", "text", mark), "simhash-fps"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "mark")).alias("s")
    stay = rows.groupBy("class_fp").agg(first).select(F.col("s.doc_id").alias("_id"), F.col("s.mark").alias("_mark")).distinct()
    carried = docs.select("doc_id", mark, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    nth = F.row_number().over(W.partitionBy("doc_id", "mark").orderBy(F.xxhash64("row")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    kept = carried.join(stay, same, "left_semi").withColumn("nth", nth).where("nth = 1")
    return kept.select("row.*")
