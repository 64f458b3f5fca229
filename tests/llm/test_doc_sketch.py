"""op11 against brute force, with the awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corrello.llm import doc_sketch as ds


def shingle_set(text, words=5):
    each = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {" ".join(each[i : i + words]) for i in range(max(1, len(each) - words + 1))} if each else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(rng.choice(("la", "Der", "und", "vi", "que", "été", "日本", "ok.", "tion")) + str(rng.randrange(40)) for _ in range(n))


def test_a_sketch_is_the_bottom_of_its_shingles(monkeypatch):
    monkeypatch.setattr(ds, "PART", 50)
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 6, 49, 50, 51, 54, 55, 130, 700):
        text = prose(rng, n)
        mixed = set()
        for s in shingle_set(text):
            total = len(s.split(" "))
            for j, w in enumerate(s.split(" ")):
                total += int(ds._mixed(np.array([xxhash.xxh64_intdigest(w.encode(), 5)], np.uint64))[0]) * int(ds._ODD[j])
            mixed.add(int(ds._mixed(np.array([total & (2**64 - 1)], np.uint64))[0]))
        assert len(mixed) == len(shingle_set(text))
        assert ds.sketch(text).tolist() == sorted(mixed)[: ds.K]
        assert (ds.from_string(ds.to_string(ds.sketch(text))) == ds.sketch(text)).all()


def test_estimates_are_near_the_truth_and_exact_for_short_texts():
    rng = random.Random(2)
    errors = []
    for n in (20, 60, 400, 2000):
        for share in (0.1, 0.4, 0.8, 1.0):
            a = prose(rng, n).split()
            b = a[: int(n * share)] + prose(rng, n - int(n * share)).split()
            sa, sb = ds.sketch(" ".join(a)), ds.sketch(" ".join(b))
            true = jaccard(" ".join(a), " ".join(b))
            got = ds.resemblance(sa, sb)
            assert got == ds.resemblance(sb, sa) and abs(got - true) < 0.15
            x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
            assert abs(ds.containment(sa, sb) - len(x & y) / len(x)) < 0.15
            assert abs(ds.distinct(sa) / len(x) - 1) < 0.35
            errors.append(abs(got - true))
            if n < 100:
                assert got == pytest.approx(true)
    assert sum(errors) / len(errors) < 0.04
    none = ds.sketch(" \n")
    assert ds.resemblance(none, none) == ds.containment(none, sa) == 1.0 and ds.resemblance(none, sa) == ds.distinct(none) == 0.0


def brute(rows):
    """Rows in the order of descending ids, null last, ties by the mark given."""
    order = []
    for r in rows:
        if not order or (order[-1][0], order[-1][1]) != (r[0], r[1]):
            order.append((r[0], r[1], 1))
        else:
            order[-1] = (*order[-1][:2], order[-1][2] + 1)
    out = []
    for (i, t, n), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        out += [(i is None, i or 0, len(t), hashlib.sha256(changed.encode()).hexdigest(), ds.to_string(ds.sketch(t)), ds.to_string(ds.sketch(changed)), ds.resemblance(ds.sketch(t), ds.sketch(changed)), ds.resemblance(ds.sketch(t), ds.sketch(after)))] * n
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3])
def test_documents_meet_their_next(spark, docs, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(ds, "RANGE_BYTES", 3000)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice((0, 1, 2, 9, 60)))) for i in range(0, 300, 2)]
    rows += [(400 + i, "the same text " * 30) for i in range(80)]
    rows += [(7, None), (9, ""), (11, "🙂" * 9), (13, "word " * 40_000), (5, "five"), (5, "five"), (5, "other five"), (None, "no id"), (None, None), (-3, "low"), (1 << 60, "high"), ((1 << 60) + 1, "higher")]
    df = docs(rows).withColumn("lent", F.lit("x")).withColumn("bucket", F.lit("clash")).repartition(partitions)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marked = [(r[0], r[1], r[2]) for r in df.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    marked.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    got = sorted((r[0] is None, r[0] or 0, *r[1:7]) for r in ds.op11_bottom_k_sketch(spark, str(tmp_path)).collect())
    assert got == brute(marked)


def test_one_document_and_none(docs):
    assert ds.fingerprints(docs([])).count() == 0
    (one,) = ds.fingerprints(docs([(4, "abcd")])).collect()
    assert (one["n_chars"], one["edited_sha256"], one["near_next"]) == (4, hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_merged_parts_are_the_sketch_of_the_whole(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", prose(rng, 30)) for i in range(200)] + [(None, "x y z"), ("a", None)]
    df = ds.with_sketch(spark.createDataFrame(rows, "source string, text string").repartition(5))
    got = {r["source"]: r["fingerprint"] for r in ds.merged(df, "source").collect()}
    for key in ("a", "b", None):
        whole = np.empty(0, np.uint64)
        for k, t in rows:
            if k == key:
                whole = ds.merge(whole, ds.sketch(t))
        assert got[key] == ds.to_string(whole)
    assert ds.merged(df.where("1 = 0"), "source").count() == 0
    both = df.where("source = 'a'").limit(1).select(ds.estimated("resemblance", F.col("fingerprint"), F.col("fingerprint")), ds.estimated("distinct", F.col("fingerprint")), ds.estimated("containment", F.col("fingerprint"), F.lit(None).cast("string")))
    assert tuple(both.first()) == (1.0, 26.0, None)
