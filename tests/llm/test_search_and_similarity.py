"""op1 and op6 against brute force, with the awkward rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corrello.llm import simhash, topk_search

VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q))[:k]
            out[q] = [(c, -s) for s, c in scores]
    return out


def test_topk_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    rng = random.Random(1)
    rows = [(i, [np.float32(rng.gauss(0, 0.4)).item() for _ in range(8)]) for i in range(260)]
    rows += [(i, rows[3][1]) for i in range(300, 400)]  # a common vector: ties go to the smaller id
    rows += [(500, None), (501, []), (502, [None] * 8), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (505, [0.5] * 3), (None, [0.1] * 8), (550, [0.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    vectors = topk_search.quantised(df.withColumn("rank", F.lit("clash")))
    got = {}
    for r in topk_search.top_k(vectors.where("vec_id % 50 = 0"), topk_search.Index(vectors), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(rows, 5)


def test_topk_of_few_and_none(spark):
    few = topk_search.quantised(spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0)], VEC))
    got = topk_search.top_k(few.where("vec_id % 50 = 0"), topk_search.Index(few), 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 256 * 128)]
    none = topk_search.quantised(spark.createDataFrame([], VEC))
    assert topk_search.top_k(none, topk_search.Index(none), 5).count() == 0


def test_topk_sends_the_driver_a_bounded_sample_and_broadcasts_no_queries(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SAMPLE", 50)
    rng = np.random.default_rng(5)
    df = topk_search.quantised(spark.createDataFrame([(i, rng.normal(size=4).tolist(), 0) for i in range(4000)], VEC))
    sample = topk_search._sampled(df, 4000)
    assert sample.count() == 50
    assert 100 < df.where(F.xxhash64("vec_id", "vec") < topk_search.LOWEST + (200 << 64) // 4000).count() < 300
    lowest = df.orderBy(F.xxhash64("vec_id", "vec")).limit(50)
    assert sorted(r["vec_id"] for r in sample.collect()) == sorted(r["vec_id"] for r in lowest.collect())
    joins = []
    kept = topk_search.keep

    def seen(frame, name):
        if name == "topk-best":
            joins.append(frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().sparkPlan().toString())
        return kept(frame, name)

    index = topk_search.Index(df)
    monkeypatch.setattr(topk_search, "keep", seen)
    topk_search.top_k(df.where("vec_id % 50 = 0"), index, 5)
    assert joins and all("SortMergeJoin [annulus" in j and "BroadcastHashJoin [annulus" not in j for j in joins)


def test_topk_drops_no_sound_vector(spark):
    big, small = float(1 << 40), [0.25, -0.5]
    rows = [(0, [3.0, 1.0]), (1, small), (2, [big, -big]), (3, [-big, 1.0]), (4, [1e30, 1e30]), (50, [1.0] * 3), (51, [2.0] * 3), (52, [0.1] * 4), (100, [0.0, 0.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5])]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    df = topk_search.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows if i != 4], "vec_id long, embedding array<double>, label int"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df.where("vec_id % 50 = 0"), topk_search.Index(df), 3).collect())
    want = []
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), j) for i, v in whole if i == q for j, c in whole if j not in (q, 4) and len(c) == len(v))
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores[:3])]
    assert got == want
    whole_df = topk_search.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(whole_df.where("vec_id % 50 = 0"), topk_search.Index(whole_df), 3).collect()


def test_index_excludes_far_annuli(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.01) for c in centres[i % 12]], 0) for i in range(1200)]
    df = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    index, queries = topk_search.Index(df), df.where("vec_id % 50 = 0")
    found = topk_search.top_k(queries, index, 5)
    assert found.count() == 24 * 5 and topk_search.share_excluded(queries, index, found) > 0.5


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def reach(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(len(fps))]


def test_fingerprints(spark, docs):
    texts = [None, "", "one", "One TWO", "one two", "a b c", "a b c d É é", " \t\n", "word " * 70_000]
    got = {r["doc_id"]: r for r in simhash.near_duplicate_classes(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["fingerprint"] == f"{slow_fingerprint(t):016x}"
    assert got[1]["component_id"] == got[7]["component_id"] == 0 and got[4]["component_id"] == 3


def test_links_equal_brute_force(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for c in centres:
        for _ in range(25):
            f = c
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6])):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    want = reach(fps)
    assert [root(f) for f in fps] == [fps[w] for w in want]


def test_large_buckets_link_like_small_ones():
    rng = random.Random(9)
    for part, (shift, bits) in enumerate(simhash.BLOCKS):
        mask = simhash.FULL ^ (((1 << bits) - 1) << shift)
        centre = rng.getrandbits(64) & mask
        kept = [b for b in range(64) if mask >> b & 1]
        base = [rng.getrandbits(bits) for _ in range(4)]
        members = set()
        for _ in range(160):
            x = rng.choice(base)
            for b in rng.sample(range(bits), rng.randint(0, 4)):
                x ^= 1 << b
            members.add(centre ^ rng.choice([0, 1 << rng.choice(kept)]) | x << shift)
        fps = np.array(sorted(members), np.uint64)
        small, large = simhash._Forest(), simhash._Forest()
        simhash._link_small(fps, small)
        simhash._link_large(fps, part, centre, large)
        ids = fps.tolist()
        assert all((a ^ b).bit_count() <= 3 for a, b in large.edges)
        assert [min(j for j in ids if small.root(j) == small.root(i)) for i in ids] == [min(j for j in ids if large.root(j) == large.root(i)) for i in ids]


def test_one_of_each_class_stays(spark, docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = docs([(5, text), (3, text), (3, text), (9, "quite another text " * 9), (None, text), (None, None)])
    kept = simhash.drop_near_duplicates(spark, rows, "")
    assert kept.columns == rows.columns
    # a copy without an id goes like any other; what is like no row with an id stays, once
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0)]
    alone = simhash.drop_near_duplicates(spark, docs([(None, text), (None, text), (None, ""), (4, None)]), "")
    assert sorted((r["doc_id"] is None, r["text"] is None) for r in alone.collect()) == [(False, True), (True, False)]
    assert simhash.near_duplicate_classes(docs([])).count() == 0


def test_stage_is_deterministic_and_carries_rows(spark, docs):
    text, other = " ".join(f"w{i}" for i in range(200)), "quite another text " * 9
    rows = docs([(4, text), (4, other), (7, other), (4, text), (8, text + " w0")]).withColumn("_nth", F.lit(5)).withColumn("row", F.lit("r")).withColumn("a.b", F.col("doc_id") * 2)
    got = [sorted(map(tuple, simhash.drop_near_duplicates(spark, rows.repartition(n), "").collect())) for n in (1, 3)]
    assert got[0] == got[1] and sorted(r[1] for r in got[0]) == sorted([text, other]) and all(r[0] == 4 and r[-3:] == (5, "r", 8) for r in got[0])
    assert simhash.drop_near_duplicates(spark, docs([]), "").count() == 0


def test_hot_fingerprints(spark, docs, monkeypatch):
    rows = docs([(i, "a common text of some words") for i in range(40)] + [(100 + i, f"text number {i} is {i * 7} alone") for i in range(30)])
    want = sorted(map(tuple, simhash.near_duplicate_classes(rows).collect()))
    assert len(want) == 70
    for hot in (1, 2, 10**9):
        monkeypatch.setattr(simhash, "HOT", hot)
        assert sorted(map(tuple, simhash.near_duplicate_classes(rows).collect())) == want
