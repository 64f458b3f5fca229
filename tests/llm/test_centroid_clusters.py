"""op12 against plain loops, with the awkward rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from corrello.llm import centroid_clusters as cc

VEC = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, k=16, rounds=3):
    """{(vec_id, cluster, distance, cluster_inertia, inertia, sha): times}"""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    ranked = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    middles = [list(q) for _, q in ranked[:k]]
    if not middles:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), c) for c, m in enumerate(middles)) for _, q in kept]

    for _ in range(rounds):
        to = assign()
        for c in range(len(middles)):
            own = [q for (_, q), (_, t) in zip(kept, to, strict=True) if t == c]
            if own:
                middles[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assign()
    total = sum(d for d, _ in to)
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted(((i is None, i), c, d, sum(x for x, y in to if y == c), total, sha[c]) for (i, _), (d, c) in zip(kept, to, strict=True))


def rows_of(rng, n, spread):
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [np.float32(x + rng.gauss(0, spread)).item() for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_lloyd_equals_plain_loops(spark, tmp_path, monkeypatch, spread):
    rng = random.Random(3)
    monkeypatch.setattr(cc, "BLOCK", 64)
    rows = rows_of(rng, 220, spread)
    rows += [(i, rows[5][1]) for i in range(300, 380)]  # one vector, many rows
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, None), (401, []), (402, [0.5] * 63), (403, [None] * 64), (404, [float("nan")] * 64), (405, [float("-inf")] * 64)]
    spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(((r[0] is None, r[0]), *r[1:]) for r in cc.op12_dual_tree_lloyd(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_lloyd_equals_its_sql(spark, tmp_path):
    rows = rows_of(random.Random(4), 90, 0.5)
    spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(((r[0] is None, r[0]), *r[1:]) for r in con.execute(cc.OP12_SQL).fetchall())
    assert sorted(((r[0] is None, r[0]), *r[1:]) for r in cc.op12_dual_tree_lloyd(spark, str(tmp_path)).collect()) == want == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 9])
def test_few_vectors_and_none(spark, tmp_path, n):
    rows = rows_of(random.Random(5), n, 1.0)
    spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(((r[0] is None, r[0]), *r[1:]) for r in cc.op12_dual_tree_lloyd(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_too_large_components_are_an_error(spark, tmp_path):
    spark.createDataFrame([(1, [1e30] * 64, 0, "x")], VEC).write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="64 bits"):
        cc.op12_dual_tree_lloyd(spark, str(tmp_path)).collect()


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(6)
    points = np.concatenate((rng.integers(-40, 40, (300, 4)), np.repeat(rng.integers(-9, 9, (1, 4)), 50, 0)))
    tree = cc.cover_tree(points, 1)
    assert sorted(tree.order.tolist()) == list(range(350)) and (tree.points == points[tree.order]).all()
    gap = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    for i in range(len(tree.rep)):
        below = tree.points[tree.first[i] : tree.last[i]]
        assert tree.first[i] <= tree.rep[i] < tree.last[i]
        assert all(gap(x, tree.points[tree.rep[i]]) <= tree.radius[i] + 1e-9 for x in below)
        kids = range(tree.child[i], tree.child[i] + tree.children[i])
        if len(kids):
            assert tree.first[kids[0]] == tree.first[i] and tree.last[kids[-1]] == tree.last[i]
            assert tree.rep[i] in [tree.rep[j] for j in kids]  # nesting
            widest = max(gap(x, tree.points[tree.rep[i]]) for x in below)
            if widest:
                half = 2.0 ** (np.ceil(np.log2(widest)) - 1)
                assert all(tree.radius[j] <= half + 1e-3 for j in kids)
                assert all(gap(tree.points[tree.rep[a]], tree.points[tree.rep[b]]) > half - 1e-6 for a in kids for b in kids if a < b)


def test_pruning_spares_most_pairs_of_clustered_vectors(spark):
    rows = spark.createDataFrame([(i, v, 0, "x") for i, v in rows_of(random.Random(8), 3000, 0.02)], VEC)
    vectors = cc.quantised(rows)
    found = cc.Clusters(vectors, cc.hashed_start(vectors, 16))
    found.round()
    seen = found.work()
    assert seen["pairs"] == 48_000 and seen["bounded"] + seen["compared"] < 0.5 * seen["pairs"]
