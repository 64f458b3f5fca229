"""Lloyd's clustering with two trees: cover trees over vectors, a tree over centroids.

Vectors are integers of one length.  Every task cuts its vectors into blocks of
``BLOCK``, near ones together, and builds a cover tree over each: a node stands
for one of its vectors and all below it lie within half the parent's reach.
Trees are written once.  Each round builds the same kind of tree over the
centroids and walks it against every block's tree.  For a vector node with
representative p and radius r and a centroid node with centre c and radius s,
every vector below is within |p - c| + r of some centroid and no closer to any
below the other node than |p - c| - r - s; a pair whose least distance is above
the best of the former is pruned.  A vector node left with one centroid is
assigned whole, by differences of running sums; leaf pairs are compared exactly
in integers.  Bounds are widened by ``SLACK``, so rounding prunes nothing that
could win or tie.

A round shuffles one row per task and cluster; centroids are the only thing that
is sent to tasks or collected, and their number is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrello.store import keep, table

#: Vectors of one cover tree, and of what is put in order at a time before cutting.
BLOCK, CHUNK = 1024, 16_384
#: Vectors of a leaf of a vector tree.
LEAF = 8
#: Components up to this size have squared distances that fit 64 bits (64 of them).
LARGEST = 1 << 26
SLACK = 1e-9


class Tree(NamedTuple):
    """A cover tree over the rows of ``points``, which are in the order of its leaves:
    node i holds the rows first[i]:last[i], its representative is row rep[i], its
    children are the nodes child[i]:child[i] + children[i]; node 0 is the root."""

    points: np.ndarray
    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rep: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over at least one point; repeated points are points like others.

    A node whose farthest vector is at distance in (2^(i-1), 2^i] has children that
    reach 2^(i-1); the first keeps its representative, and the others' are more than
    2^(i-1) from those before them.  Nodes of at most ``leaf`` points are not cut."""
    between = _distances(points, points)
    # distances from a product of matrices are off by up to this much
    blur = np.sqrt(float((points.astype(np.float64) ** 2).sum(1).max(initial=0.0)) * 1e-13)
    nodes: list[list] = [[0, np.arange(len(points))]]  # representative, members
    child, children, radius = [], [], []
    at = 0
    while at < len(nodes):
        rep, some = nodes[at]
        far = between[rep, some]
        reach = float(far.max())
        child.append(len(nodes))
        radius.append(reach + blur)
        if len(some) > leaf:
            half = 2.0 ** (np.ceil(np.log2(reach)) - 1) if reach > blur else -1.0
            if half < 0:  # all the same: cut evenly
                cuts = [[rep if rep in x else x[0], x] for x in np.array_split(some, -(-len(some) // leaf))]
            else:
                cuts, left, centre = [], some, rep
                while len(left):
                    near = between[centre, left] <= half
                    near |= left == centre
                    cuts.append([centre, left[near]])
                    left = left[~near]
                    centre = left[0] if len(left) else -1
            nodes.extend(cuts)
        children.append(len(nodes) - child[-1])
        at += 1
    # rows in the order of the leaves, and each node's range of them
    first, last = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    order, stack = [], [(0, False)]
    done = 0
    while stack:
        node, out = stack.pop()
        if out:
            last[node] = done
            continue
        first[node] = done
        stack.append((node, True))
        if children[node]:
            stack.extend((c, False) for c in reversed(range(child[node], child[node] + children[node])))
        else:
            order.append(nodes[node][1])
            done += len(nodes[node][1])
    order = np.concatenate(order)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    rep = place[np.array([n[0] for n in nodes], np.int64)]
    return Tree(points[order], order, first, last, rep, np.array(child, np.int64), np.array(children, np.int64), np.array(radius))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then those of start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def nearest(tree: Tree, middles: Tree) -> tuple[np.ndarray, dict[str, int]]:
    """For each row of ``tree.points`` the number of its nearest centroid (ties: the
    smaller), and how many pairs of nodes were bounded and of vectors compared.

    ``middles`` is a tree with leaves of one centroid; its order holds their numbers."""
    out = np.full(len(tree.points), -1, np.int64)
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    seen = {"bounded": 0, "compared": 0}
    a, b = tree.points.astype(np.float64), middles.points.astype(np.float64)
    while len(v):
        seen["bounded"] += len(v)
        gap = np.sqrt(((a[tree.rep[v]] - b[middles.rep[c]]) ** 2).sum(1))
        r, s = tree.radius[v], middles.radius[c]
        node, v_at = np.unique(v, return_inverse=True)
        best = np.full(len(node), np.inf)
        np.minimum.at(best, v_at, gap + r)
        stay = gap - r - s <= best[v_at] * (1 + SLACK) + SLACK
        v, c, v_at, r, s = v[stay], c[stay], v_at[stay], r[stay], s[stay]
        inner_c, inner_v = middles.children[c] > 0, tree.children[node] > 0
        many, open_c = np.bincount(v_at, minlength=len(node)), np.bincount(v_at, inner_c, minlength=len(node)) > 0
        widest = np.zeros(len(node))
        np.maximum.at(widest, v_at, np.where(inner_c, s, 0.0))
        # one centroid left: the whole node is its
        whole = (many == 1) & ~open_c
        for i in np.flatnonzero(whole[v_at]):
            out[tree.first[v[i]] : tree.last[v[i]]] = middles.order[middles.first[c[i]]]
        # nothing left to open: compare exactly
        exact = ~whole & ~open_c & ~inner_v
        if exact.any():
            own = exact[v_at]
            size = (tree.last - tree.first)[v[own]]
            rows = _spread(tree.first[v[own]], size)
            which = np.repeat(middles.first[c[own]], size)
            seen["compared"] += len(rows)
            gaps = ((tree.points[rows] - middles.points[which]) ** 2).sum(1)
            number = middles.order[which]
            rank = np.lexsort((number, gaps, rows))
            rows, number = rows[rank], number[rank]
            head = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            out[rows[head]] = number[head]
        # open the wider side: the centroid nodes at least as wide as the vector node, or the vector node
        by_c = ~whole & open_c & (~inner_v | (widest >= tree.radius[node]))
        by_v = ~whole & ~exact & ~by_c
        cut = by_c[v_at] & inner_c & (~inner_v[v_at] | (s >= r))
        rest = by_c[v_at] & ~cut
        down = by_v[v_at]
        v, c = (
            np.concatenate((np.repeat(v[cut], middles.children[c[cut]]), v[rest], _spread(tree.child[v[down]], tree.children[v[down]]))),
            np.concatenate((_spread(middles.child[c[cut]], middles.children[c[cut]]), c[rest], np.repeat(c[down], tree.children[v[down]]))),
        )
    return out, seen


_BLOCKS = "ids array<long>, points binary, n int, order binary, first binary, last binary, rep binary, child binary, children binary, radius binary"


def _pack(ids: pa.Array, tree: Tree) -> pa.RecordBatch:
    raw = [pa.array([x.astype("<f8" if x.dtype.kind == "f" else "<i8").tobytes()], pa.binary()) for x in (tree.points, *tree[1:])]
    listed = pa.ListArray.from_arrays([0, len(ids)], ids.take(pa.array(tree.order)))
    return pa.RecordBatch.from_arrays([listed, raw[0], pa.array([len(ids)], pa.int32()), *raw[1:]], [c.split()[0] for c in _BLOCKS.split(", ")])


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Tree]]:
    for row in batch.to_pylist():
        n = row["n"]
        parts = [np.frombuffer(row[c], "<f8" if c == "radius" else "<i8") for c in ("order", "first", "last", "rep", "child", "children", "radius")]
        yield pa.array(row["ids"], pa.int64()), Tree(np.frombuffer(row["points"], "<i8").reshape(n, -1), *parts)


class Clusters:
    """Centroids after some rounds over ``vectors`` (``vec_id``, ``vec`` array<long>,
    one length, no nulls in vec), and the nearest of them for every vector.

    ``start``: the first centroids, in order.  Rows with a null id and repeated rows
    count like others.  Without vectors there is nothing to start from and nothing is
    returned.  Components beyond ``LARGEST`` are an error: squared distances would not
    fit 64 bits."""

    def __init__(self, vectors: DataFrame, start: list[list[int]]) -> None:
        self.spark, self.centroids = vectors.sparkSession, [list(map(int, c)) for c in start]
        first = np.array(self.centroids, np.int64)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[pa.Array, np.ndarray]] = []

            def cut() -> Iterator[pa.RecordBatch]:
                ids, points = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                if np.abs(points).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST}: squared distances would not fit 64 bits")
                gaps = _distances(points, first)
                rank = np.lexsort((gaps.min(1), gaps.argmin(1)))
                for at in range(0, len(rank), BLOCK):
                    some = rank[at : at + BLOCK]
                    yield _pack(ids.take(pa.array(some)), cover_tree(points[some]))
                held.clear()

            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    held.append((part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)))
                    if sum(len(h[0]) for h in held) >= CHUNK:
                        yield from cut()
            if held:
                yield from cut()

        self.trees = keep(vectors.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<long>")).mapInArrow(build, _BLOCKS), "cluster-trees") if start else None

    def _middles(self) -> Tree:
        return cover_tree(np.array(self.centroids, np.int64), 1)

    def round(self) -> None:
        """Assign every vector, then move each non-empty centroid to the floored mean."""
        if self.trees is None:
            return
        middles, k = self._middles(), len(self.centroids)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(k, np.int64), np.zeros((k, middles.points.shape[1]), np.int64)
            for batch in batches:
                for _, tree in _unpack(batch):
                    to, _ = nearest(tree, middles)
                    runs = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                    np.add.at(sums, to[runs], np.add.reduceat(tree.points, runs, axis=0))
                    counts += np.bincount(to, minlength=k)
            some = np.flatnonzero(counts)
            if len(some):
                flat = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * sums.shape[1], pa.array(sums[some].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), flat], ["cluster", "n", "sums"])

        parts = self.trees.mapInArrow(add, "cluster int, n long, sums array<long>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
        total = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for row in total.collect():  # clusters x components, whatever the data
            self.centroids[row["cluster"]][row["at"]] = int(row["x"]) // row["n"]

    def assigned(self) -> DataFrame:
        """``(vec_id, cluster, distance)``: the nearest centroid and the squared distance."""
        if self.trees is None:
            return self.spark.createDataFrame([], "vec_id long, cluster int, distance long")
        middles, centroids = self._middles(), np.array(self.centroids, np.int64)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, tree in _unpack(batch):
                    to, _ = nearest(tree, middles)
                    gaps = ((tree.points - centroids[to]) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(to.astype(np.int32)), pa.array(gaps)], ["vec_id", "cluster", "distance"])

        return self.trees.mapInArrow(tell, "vec_id long, cluster int, distance long")

    def work(self) -> dict[str, int]:
        """Pairs of nodes bounded and pairs of vectors compared by one more pass, and
        all pairs of a vector and a centroid."""
        if self.trees is None:
            return {"bounded": 0, "compared": 0, "pairs": 0}
        middles, k = self._middles(), len(self.centroids)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, tree in _unpack(batch):
                    seen = nearest(tree, middles)[1]
                    yield pa.RecordBatch.from_pydict({"bounded": [seen["bounded"]], "compared": [seen["compared"]], "pairs": [len(tree.points) * k]})

        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return self.trees.mapInArrow(count, "bounded long, compared long, pairs long").agg(*map(total, ("bounded", "compared", "pairs"))).first().asDict()


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)``: vectors of ``dim`` components, none null or non-finite, each
    component floor(scale * x).  Other vectors take no part; other columns are left."""
    x, far = F.col(vec_col), float("inf")
    sound = F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < far) & ~F.isnan(v.cast("double")), F.lit(False)))
    rows = vectors.where(x.isNotNull() & (F.size(x) == dim)).where(sound)
    # beyond 2^62 floor has no long: such components stay what they are, too large for Clusters
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * float(scale), F.lit(float(1 << 62))), F.lit(-float(1 << 62))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("vec"))


def hashed_start(vectors: DataFrame, k: int) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 of ``1:<vec_id>``, in that order (rows
    of one id: by vector).  Rows without an id are not chosen."""
    rows = vectors.where("vec_id is not null").withColumn("_h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return [list(r["vec"]) for r in rows.orderBy("_h", "vec").limit(k).collect()]


def op12_dual_tree_lloyd(spark, sf_dir: str, k: int = 16, rounds: int = 3) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``."""
    vectors = keep(quantised(table(spark, sf_dir, "embeddings")), "cluster-vectors")
    found = Clusters(vectors, hashed_start(vectors, k))
    for _ in range(rounds):
        found.round()
    rows = keep(found.assigned(), "cluster-assigned")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    facts = [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()]
    return rows.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    near = f"(SELECT rid, arg_min(c.c, ({gap}) * {k} + c.c) AS c, min({gap}) AS d FROM v CROSS JOIN {{0}} c GROUP BY rid)"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS {near.format(f'c{i}')}")
        steps.append(f"m{i} AS (SELECT c, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a.c, p.pos, sum(v.q[p.pos]) AS s, count(*) AS n FROM v JOIN a{i} a USING (rid), (SELECT unnest(range(1, 65)) AS pos) p GROUP BY 1, 2))")
        steps.append(f"c{i + 1} AS (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY pos) AS q FROM m{i} GROUP BY c) n USING (c))")
    joined = ",\n".join(steps)
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), h AS (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c FROM v WHERE vec_id IS NOT NULL),
c0 AS (SELECT c, q FROM h WHERE c < {k}),
{joined},
z AS {near.format(f"c{rounds}")}
SELECT v.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN z USING (rid) JOIN c{rounds} c ON c.c = z.c
"""


OP12_SQL = _op12_sql()
