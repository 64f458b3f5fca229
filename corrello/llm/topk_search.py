"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers, floor(256 x), held as doubles (which is exact: a floor
of a double is a double).  Lifted by one coordinate that brings every vector to
the same length M, the largest inner product is the least distance:
d^2 = |q|^2 + M^2 - 2 <q, v>.  Pivots are chosen far from each other on a bounded
sample; there are more of them when there are more vectors.  Each vector is
keyed by its nearest pivot and its distance to it, cut into ``RINGS`` annuli of
equal width.  The catalogue of annuli holds their counts, their distance ranges
to the own pivot and to ``GUIDES`` common ones; it is bounded by
MOST_PIVOTS * (RINGS + 1) rows, whatever the data.

An annulus is stored in blocks of about ``BLOCK`` vectors, dealt by an id hash,
so a hot annulus (a vector copied a million times) becomes many blocks.

A query sorts the annuli by the least distance the triangle inequality allows.
It expands them in growing waves; after each, its k-th best score bounds what is
still needed, and annuli (and results) below it are skipped.  The last wave
takes every annulus not excluded by its bound, so the result is exact.
Queries meet an annulus in blocks: no table of query-vector pairs is made.
Vectors of different lengths have no inner product: each length has its own index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corrello.store import keep, table

LEAST_PIVOTS, MOST_PIVOTS, PER_PIVOT, GUIDES = 16, 256, 4000, 8
#: Vectors that pivots are chosen from.
SAMPLE = 4096
RINGS, BLOCK, QUERY_BLOCK = 16, 2048, 1024
WAVES = (4, 28)
#: Vectors up to this length have exact products in double arithmetic.
PLAIN = float(1 << 26)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` with vec = floor(256 x) as doubles that are integers.

    Null ids, null or empty vectors and vectors with null or non-finite components
    take no part.  Rows that repeat an id and a vector count once; rows that share
    an id only are all candidates, and as queries share one list of results."""
    x = F.col(vec_col)
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(sound)
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    vec = F.transform(x, lambda v: whole(v.cast("double") * 256.0))
    return keep(rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).distinct(), "topk-vectors")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim) if dim else flat.reshape(len(column), 0)


def _lifted(vecs: np.ndarray, pivots: np.ndarray, square: float) -> np.ndarray:
    """Distances of lifted vectors (rows) to lifted pivots (columns)."""
    na, nb = (vecs * vecs).sum(1), (pivots * pivots).sum(1)
    up = np.sqrt(np.maximum(square - na, 0))[:, None] * np.sqrt(np.maximum(square - nb, 0))[None, :]
    return np.sqrt(np.maximum(2 * square - 2 * (vecs @ pivots.T + up), 0))


def far_first(sample: np.ndarray, count: int, square: float) -> np.ndarray:
    """Up to ``count`` different vectors of the sample, each the farthest from those before."""
    chosen = [0]
    near = _lifted(sample, sample[:1], square)[:, 0]
    while len(chosen) < min(count, len(sample)):
        best = int(near.argmax())
        if near[best] <= 0:
            break
        chosen.append(best)
        near = np.minimum(near, _lifted(sample, sample[best : best + 1], square)[:, 0])
    return sample[chosen]


class Catalogue:
    """What a query needs to know of the annuli: bounded, and sent to tasks."""

    def __init__(self, pivots: np.ndarray, square: float, rows: list) -> None:
        self.pivots, self.square = pivots, square
        self.annulus = np.array([r["annulus"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high"))
        self.guides = len(pivots[:GUIDES])
        self.lows, self.highs = (np.array([[r[f"{c}{g}"] for g in range(self.guides)] for r in rows], np.float64).reshape(len(rows), self.guides) for c in ("low", "high"))
        self.count = np.array([r["n"] for r in rows], np.int64)
        self.blocks = -(-self.count // BLOCK)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Highest possible score of each query (rows) in each annulus (columns)."""
        with np.errstate(all="ignore"):
            own = (q * q).sum(1)
            to_pivot = np.sqrt(np.maximum(own[:, None] + self.square - 2 * q @ self.pivots.T, 0))  # a query is lifted by 0
            far = to_pivot[:, self.annulus // (RINGS + 1)]
            least = np.maximum(np.maximum(far - self.high, self.low - far), 0)
            for g in range(self.guides):
                far = to_pivot[:, g, None]
                least = np.maximum(least, np.maximum(far - self.highs[:, g], self.lows[:, g] - far))
            bound = (own[:, None] + self.square - least**2) / 2 + 1e-6 * (1 + self.square + own[:, None])
        return np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=np.inf)  # numbers too large for a bound exclude nothing


def _sampled(vectors: DataFrame, count: int) -> DataFrame:
    """The ``SAMPLE`` rows of the lowest hashes, of ``count`` different ones.

    Every task hands its own lowest rows to the driver, so only rows whose hash is in
    the lowest part of all, four times as many as wanted, get that far."""
    mark = F.xxhash64("vec_id", "vec")
    if count > 4 * SAMPLE:
        vectors = vectors.where(mark < LOWEST + (4 * SAMPLE << 64) // count)
    return vectors.orderBy(mark, "vec_id", "vec").limit(SAMPLE)


class _Part:
    """The index of the vectors of one length."""

    def __init__(self, vectors: DataFrame, dim: int, count: int) -> None:
        norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
        self.dim, self.count = dim, count
        square = float(vectors.agg(F.max(norm)).first()[0])
        if not np.isfinite(square):
            raise OverflowError("vectors are too long for scores of 64 bits")
        sample = _sampled(vectors, count).collect()  # a bounded sample
        pivots = far_first(np.array([r["vec"] for r in sample], np.float64), min(MOST_PIVOTS, max(LEAST_PIVOTS, count // PER_PIVOT)), square)
        guides = len(pivots[:GUIDES])
        width = 2 * np.sqrt(square) / RINGS or 1.0

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = _lifted(_matrix(batch.column(1), dim), pivots, square)
                    near = far.argmin(axis=1)
                    dist = far[np.arange(len(far)), near]
                    annulus = near * (RINGS + 1) + np.minimum((dist / width).astype(np.int64), RINGS)
                    cols = [*batch.columns, pa.array(annulus.astype(np.int32)), pa.array(dist), *(pa.array(far[:, g].copy()) for g in range(guides))]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "vec", "annulus", "dist", *(f"g{g}" for g in range(guides))])

        placed = keep(vectors.select("vec_id", "vec").mapInArrow(place, "vec_id long, vec array<double>, annulus int, dist double" + "".join(f", g{g} double" for g in range(guides))), "topk-placed")
        ranges = [f(c).alias(f"{n}{i}") for c, i in (("dist", ""), *((f"g{g}", g) for g in range(guides))) for f, n in ((F.min, "low"), (F.max, "high"))]
        rows = placed.groupBy("annulus").agg(F.count(F.lit(1)).alias("n"), *ranges).orderBy("annulus").collect()
        self.catalogue = cat = Catalogue(pivots, square, rows)
        spark = vectors.sparkSession
        parts = spark.createDataFrame([(int(a), int(b)) for a, b in zip(cat.annulus, cat.blocks, strict=True)], "annulus int, parts long")
        dealt = placed.join(F.broadcast(parts), "annulus").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        grouped = dealt.groupBy("annulus", "part").agg(F.collect_list(F.struct("vec_id", "vec")).alias("m"))
        self.table = keep(grouped.select("annulus", "part", F.col("m.vec_id").alias("ids"), F.flatten("m.vec").alias("vecs")), "topk-index")


class Index:
    """One part for each length of vectors."""

    def __init__(self, vectors: DataFrame) -> None:
        sizes = vectors.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect()
        self.parts = [_Part(vectors.where(F.size("vec") == r["dim"]), r["dim"], r["count"]) for r in sizes]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where vectors are short enough, else Python's integers."""
    large_q, large_v = ((np.sqrt((x * x).sum(1)) > PLAIN) for x in (q, v))
    if not large_q.any() and not large_v.any():
        return (q @ v.T).astype(np.int64)
    out = np.zeros((len(q), len(v)), object)
    whole = lambda x: np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)
    small = np.ix_(~large_q, ~large_v)
    out[small] = (q[~large_q] @ v[~large_v].T).astype(np.int64)
    out[large_q] = whole(q[large_q]) @ whole(v).T
    out[:, large_v] = whole(q) @ whole(v[large_v]).T
    return out


def _best(scores: np.ndarray, floor: int, own: np.ndarray, vec_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query's scores, ties to the smaller id."""
    if scores.dtype == object:
        usable = [i for i, s in enumerate(scores) if s >= floor and not own[i]]
        usable = heapq.nsmallest(k, usable, key=lambda i: (-scores[i], vec_ids[i]))
        if any(not LOWEST <= scores[i] <= HIGHEST for i in usable):
            raise OverflowError("a score does not fit in 64 bits")
        return np.array(usable, np.int64)
    usable = np.flatnonzero((scores >= floor) & ~own)
    if len(usable) > k:
        best = -np.partition(-scores[usable], k - 1)[k - 1]
        usable = usable[scores[usable] >= best]
        usable = usable[np.lexsort((vec_ids[usable], -scores[usable]))[:k]]
    return usable


def _search(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, q, floors, vec_ids, v = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(5))
            scores = _products(q.reshape(-1, dim), v.reshape(-1, dim))
            own = ids[:, None] == vec_ids[None, :]
            found = [_best(scores[i], floors[i], own[i], vec_ids, k) for i in range(len(ids))]
            size = [len(f) for f in found]
            flat = np.concatenate(found)
            got = scores[np.repeat(np.arange(len(ids)), size), flat].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(vec_ids[flat]), pa.array(got)], ["query_id", "vec_id", "score"])


_RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(queries: DataFrame, index: Index, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner
    products (all, if fewer) with vectors of its length, ties to the smaller
    vec_id, never its own id.  A score of the result beyond 64 bits is an error."""
    found = [_top_k_part(queries.where(F.size("vec") == part.dim), part, k) for part in index.parts]
    if not found:
        return queries.sparkSession.createDataFrame([], _RESULT)
    ranked = reduce(DataFrame.union, found)
    if len(found) > 1:  # one id may have queries of several lengths
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top_k_part(queries: DataFrame, index: _Part, k: int) -> DataFrame:
    state = keep(queries.select(F.col("vec_id").alias("query_id"), "vec", F.lit(str(LOWEST)).cast("long").alias("floor")), "topk-queries")
    chunks = max(1, -(-state.count() // QUERY_BLOCK))
    best: DataFrame | None = None
    cat, dim = index.catalogue, index.dim
    cuts = [0, *np.cumsum(WAVES).tolist(), len(cat.annulus)]
    for first, last in zip(cuts, cuts[1:], strict=False):
        last = min(last, len(cat.annulus))
        if first >= last:
            break

        def expand(batches: Iterator[pa.RecordBatch], first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    bound = cat.bounds(_matrix(part.column(1), dim))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    wanted = np.take_along_axis(bound, order, 1) >= part.column(2).to_numpy(zero_copy_only=False)[:, None]
                    row, col = np.nonzero(wanted)
                    which = order[row, col]
                    times = cat.blocks[which]
                    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    take = pa.array(np.repeat(row, times))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(cat.annulus[which], times).astype(np.int32)), pa.array(block.astype(np.int32)), *(c.take(take) for c in part.columns)],
                        ["annulus", "part", "query_id", "vec", "floor"],
                    )

        wanted = state.mapInArrow(expand, "annulus int, part int, query_id long, vec array<double>, floor long")
        chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")
        asked = wanted.groupBy("annulus", "part", chunk).agg(F.collect_list(F.struct("query_id", "vec", "floor")).alias("m"))
        asked = asked.select("annulus", "part", F.col("m.query_id").alias("qids"), F.flatten("m.vec").alias("qs"), F.col("m.floor").alias("floors"))
        # the plan knows the queries' size before they meet their annuli only, and would broadcast them
        met = asked.hint("merge").join(index.table, ["annulus", "part"]).select("qids", "qs", "floors", "ids", "vecs")
        found = met.mapInArrow(lambda b: _search(b, dim, k), "query_id long, vec_id long, score long")
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "topk-best")
        floors = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("_f"))
        state = keep(state.join(floors, "query_id", "left").select("query_id", "vec", F.coalesce("_f", "floor").alias("floor")), "topk-queries")
    return best.select("query_id", "rank", "vec_id", "score")


def share_excluded(queries: DataFrame, index: Index, found: DataFrame, k: int = 5) -> float:
    """Share of the (query, vector) pairs whose annulus the bounds exclude once
    the k-th best score is known: what the index can spare at best."""
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    spared = pairs = 0
    for part in index.parts:
        cat, dim = part.catalogue, part.dim

        def count(batches: Iterator[pa.RecordBatch], cat=cat, dim=dim) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    out = cat.bounds(_matrix(some.column(0), dim)) < some.column(1).to_numpy(zero_copy_only=False)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array((out * cat.count).sum(1))], ["n"])

        own = queries.where(F.size("vec") == dim).join(floors, "vec_id").select("vec", "score")
        row = own.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("q")).first()
        spared, pairs = spared + row["s"], pairs + row["q"] * part.count
    return spared / pairs if pairs else 0.0


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), Index(vectors), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
