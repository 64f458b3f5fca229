"""The whole pipeline against its stages in plain Python."""

import random

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from corrello.llm import packing, quality_classifier, quality_rules, simhash
from tests.llm.test_search_and_similarity import reach, slow_fingerprint


def test_run(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_classifier, "STEPS", 120)
    rng = random.Random(12)
    stems = [a + b for a in ("th", "er", "on", "an", "re") for b in ("e", "in", "ou", "st", "at", "al")]
    good = lambda: " ".join(rng.choice(stems) for _ in range(rng.randint(30, 120))) + "."
    rows = [(i, good()) for i in range(150)]
    rows += [(200 + i, " ".join(rng.choice(stems).upper() + "!!" for _ in range(60))) for i in range(60)]  # bad
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(340 + i, rows[30 + i][1] + " the") for i in range(5)]  # exact and near copies
    rows += [(400, None), (401, ""), (402, "short text"), (403, "a b c d e f g h " * 9), (404, good()[:-1] + " <|endoftext|> " + good()), (0, rows[0][1])]
    frame = docs(rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(200 + i, 0, 0) for i in range(60)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # rules: held against plain Python by their own test; their decisions are taken from them
    kept = [(r["doc_id"], r["text"]) for r in quality_rules.score_quality(frame, labels).where("kept").collect()]
    params = quality_classifier.train(*quality_classifier.training_texts(frame, labels))
    kept = [(i, t) for i, t in kept if quality_classifier.probability([t.encode()], params)[0] >= quality_classifier.CUT]
    kept = sorted(set(kept))
    classes = reach([slow_fingerprint(t) for _, t in kept])
    first = {}
    for (i, t), c in zip(kept, classes, strict=True):
        first[c] = min(first.get(c, (i, t)), (i, t))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in first.values()}
    have: dict[int, int] = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
    assert have == want and len(want) > 100 and not any(200 <= i < 320 for i in want) and 404 in want
    assert not {400, 401, 402, 403} & want.keys()
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_texts_of_any_bytes_pass_the_last_two_stages(spark, docs):
    """Text that is no valid UTF-8 is a text like any other."""
    broken = docs([(i, f"one two three four {i}") for i in range(3)]).selectExpr("doc_id", "cast(concat(cast(text as binary), X'FFFE41') as string) AS text", "lang", "source", "n_chars")
    fps = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(broken).collect()}
    for i, fp in fps.items():
        words = f"one two three four {i}".encode().split()
        words[-1] += b"\xff\xfea"  # letters are compared in lower case
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[at : at + 3]), 42) for at in range(3)]
        assert fp == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) >= 2)
    kept = simhash.drop_near_duplicates(spark, broken, "")
    assert kept.count() == len(set(reach(list(fps[i] for i in range(3)))))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(plain.encode(f"one two three four {i}\ufffd\ufffdA", add_special_tokens=False).ids) + 1 for i in range(3)}
    assert {r["doc_id"]: r["length"] for r in packing.pack_stage(spark, broken, "").collect()} == want
