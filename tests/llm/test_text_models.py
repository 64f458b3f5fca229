"""op2, op3, op9 against plain Python, with the awkward rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corrello.llm import lm_scoring, quality_classifier, quality_rules

LABELS = "doc_id long, quality int, toxic int"
TEXTS = [None, "", "   \n", "short text", "a b c d e f g h " * 6, "line one here\nline one here\n\n  \nother line\nline one here", "x" * 50_000, "tie tie tie", "tie tie tie"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if found[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def corpus(docs):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("th", "er", "on", "an") for b in ("e", "in", "ou", "st", "at")]
    rows = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) + ".") for i in range(120)]
    rows += [(300 + i, " ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(60))) for i in range(40)]
    return rows + list(enumerate(TEXTS)) + [(100, rows[0][1])]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (7, None, None)], LABELS)


def test_quality_rules(spark, docs, corpus, labels):
    df = docs(corpus).withColumn("kept", F.lit("clash"))
    got = quality_rules.score_quality(df, labels).collect()
    assert len(got) == len(corpus)
    trusted = {r["doc_id"] for r in quality_rules.trusted_ids(labels).collect()}
    grams = []
    for i, t in corpus:
        tok = [hash_of(x) for x in re.findall(r"\w+|[^\w\s]+", (t or "").lower())]
        grams.append([h % quality_rules.BUCKETS for h in tok] + [hash_of(a, b) % quality_rules.BUCKETS for a, b in zip(tok, tok[1:], strict=False)])
    target, raw = Counter(), Counter()
    for (i, _), g in zip(corpus, grams, strict=True):
        raw.update(g)
        if i in trusted:
            target.update(g)
    nt, nr = sum(target.values()), sum(raw.values())
    w = lambda b: round(math.log((target[b] + 1) / (nt + quality_rules.BUCKETS)) - math.log((raw[b] + 1) / (nr + quality_rules.BUCKETS)), 6)
    want = {(i, t): (*counts(t), sum(map(w, g)) / len(g) if g else 0.0) for (i, t), g in zip(corpus, grams, strict=True)}
    for r in got:
        *base, llr = want[r["doc_id"], r["text"]]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == base
        assert r["llr"] == pytest.approx(llr, abs=1e-9)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality_rules.THRESHOLD)
    assert all(r["kept"] for r in got if 100 <= r["doc_id"] < 220) and not any(r["kept"] for r in got if r["doc_id"] >= 300)


def test_quality_rules_without_labels_or_rows(spark, docs, labels):
    none = labels.limit(0)
    assert quality_rules.score_quality(docs([(1, "a b " * 40), (2, None)]), none).where("llr <> 0").count() == 0
    assert quality_rules.score_quality(docs([]), none).count() == 0


def test_quality_classifier(spark, docs, corpus, labels, monkeypatch):
    monkeypatch.setattr(quality_classifier, "STEPS", 120)
    rows = quality_classifier.score_documents(docs(corpus).withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == len(corpus) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {100 + i: 1 for i in range(120)} | {300 + i: 0 for i in range(40)}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert quality_classifier.score_documents(docs([]), labels.limit(0)).count() == 0


def test_classifier_scores_do_not_depend_on_neighbours(monkeypatch):
    params = quality_classifier.train([b"good words here " * 5] * 4, [b"BAD!! " * 9] * 4)
    texts = [b"", b"x", b"good words " * 900, b"BAD!! " * 3000, b"tail"]
    together = quality_classifier.probability(texts, params)
    alone = np.array([quality_classifier.probability([t], params)[0] for t in texts])
    monkeypatch.setattr(quality_classifier, "BLOCK", 1)
    pieces = quality_classifier.probability(texts, params)
    assert together == pytest.approx(alone, abs=1e-6) and pieces == pytest.approx(alone, abs=1e-5)
    assert quality_classifier.probability([b"a"], quality_classifier.train([b"x"], []))[0] == pytest.approx(1.0)
    assert quality_classifier.probability([b"a"], quality_classifier.train([], []))[0] == 0.5


def all_segmentations(lattice, word):
    text = "▁" + word

    def rest(i):
        if i == len(text):
            return 1.0
        total = math.exp(sum(lattice.byte[b] for b in text[i].encode())) * rest(i + 1)
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in lattice.piece:
                total += math.exp(lattice.piece[text[i:j]]) * rest(j)
        return total

    return math.log10(rest(0))


def test_lattice_sums_all_segmentations():
    import public_tokenizers

    pieces, spell = lm_scoring.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lattice = lm_scoring.Lattice(pieces, spell, {pieces["▁the"]: 50, pieces["th"]: 9, pieces["e"]: 4}, 10)
    for word in ("the", "hello", "é漢", "a", "tion!!"):
        assert lattice.word(word) == pytest.approx(all_segmentations(lattice, word), rel=1e-9)
    assert math.isfinite(lattice.word("z" * 3000))


def test_lm_scores(spark, docs, corpus, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(lm_scoring, "COMMON", 10)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lm_scoring.score_documents(docs(corpus).withColumn("row", F.lit("clash")), path).collect()
    tokens = {(i, t): [w.decode() for w in (t or "").encode().lower().split()] + [""] for i, t in corpus}
    seen = Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update(tokens[i, t])
    n, v = sum(seen.values()), len(seen)
    base = {}
    for (i, t), tok in tokens.items():
        base.setdefault(i, set()).add((len(tok), sum(seen[w] > 0 for w in tok), round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tok), 6)))
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_tokens"], r["n_known"], round(r["base_score"], 6)) in base[r["doc_id"]] and r["train_tokens"] == n
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lm_scoring.score_documents(docs([]), path).count() == 0


def test_hot_long_words_are_scored_in_the_tasks(spark, docs, monkeypatch):
    import public_tokenizers

    path, word = public_tokenizers.path("piece_bpe_32k.model"), "É" + "ab" * 60
    df = docs([(i, f"{word} {word} some other words {i}") for i in range(30)] + [(50, "x" * 90)])
    want = sorted(map(tuple, lm_scoring.score_documents(df, path).collect()))
    for most in (1, 3):  # none, and the one that is a third of the words
        monkeypatch.setattr(lm_scoring, "HOT_LONG", most)
        got = sorted(map(tuple, lm_scoring.score_documents(df, path).collect()))
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_classifier_sample_is_taken_of_labelled_texts(spark, docs, corpus, labels):
    ids = spark.createDataFrame([(i, 0, 0) for i in range(10_000, 10_400)], LABELS)  # labels without a document
    good, bad = quality_classifier.training_texts(docs(corpus), labels.union(ids), per_class=20)
    assert len(good) == len(bad) == 20
    long = docs([(i, ("word " if i < 140 else "ZZ!! ") * 9_000) for i in range(100, 180)])
    both = spark.createDataFrame([(i, int(i < 140), 0) for i in range(100, 180)], LABELS)
    good, bad = quality_classifier.training_texts(long, both)
    assert good and bad and {len(t) for t in good + bad} == {quality_classifier.TRAIN_BYTES}


def test_long_texts_are_learned_from_all_over():
    text = bytes(range(256)) * 1000
    some = quality_classifier.spread(text)
    assert len(some) == quality_classifier.TRAIN_BYTES and some.startswith(text[:1024]) and some.endswith(text[-1024:])
    places = [text.find(some[i : i + 1024]) for i in range(0, len(some), 1024)]
    assert all(p >= 0 for p in places)
    assert quality_classifier.spread(text[:32_768]) == text[:32_768] and quality_classifier.spread(b"") == b""
    marked = b"".join(b"%08d " % i for i in range(40_000))
    some = quality_classifier.spread(marked)
    at = [int(some[i : i + 1024].split()[1]) for i in range(0, len(some), 1024)]
    assert at == sorted(at) and max(b - a for a, b in zip(at, at[1:], strict=False)) < 1.1 * 40_000 / 31


def test_classifier_stage_learns_from_the_whole_table(spark, docs, corpus, labels, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_classifier, "STEPS", 120)
    whole = docs(corpus)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    # no labelled bad text is left by the stage before; two bad ones without a label are
    rest = whole.where("doc_id < 300").union(docs([(900 + i, "THIN!! EROU!! ONST!! " * 20) for i in range(2)]))
    kept = {r["doc_id"] for r in quality_classifier.keep_likely_good(spark, rest, str(tmp_path)).collect()}
    assert not kept & {900, 901} and len(kept & set(range(100, 220))) > 110


def test_quality_rules_count_the_whole_target(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    trusted = quality_rules.trusted_ids(labels.union(labels))
    assert trusted.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20_000))
    texts = spark.range(20_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'even', 'odd') as text").union(spark.sql("select null, 'odd'"))
    even, odd = (sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(k, 20_000, 2)) for k in (0, 1))
    weights = quality_rules.bucket_weights(texts, trusted)
    for word, t, n in (("even", even, 10_000), ("odd", odd, 10_001)):
        want = math.log((t + 1) / (even + odd + quality_rules.BUCKETS)) - math.log((n + 1) / (20_001 + quality_rules.BUCKETS))
        assert weights[hash_of(word) % quality_rules.BUCKETS] == pytest.approx(want, abs=1e-6)


def test_broken_bytes_are_scored_and_repeated_rows_stay_on_the_executors(spark, monkeypatch):
    """Text that is no valid UTF-8 is read as it is stored; copies of a row are one row before they are collected."""
    rows = [(i, f"good words number {i} " * 5 if i % 2 else f"x$#@ {i} " * 9) for i in range(12) for _ in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "if(doc_id % 3 = 0, cast(concat(cast(text as binary), X'FFC3') as string), text) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got = []
    kept = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: got.append(kept(df)) or got[-1])
    good, bad = quality_classifier.training_texts(docs, labels)
    assert max(map(len, got)) <= 12 and any(t.endswith(b"\xff\xc3") for t in good + bad)
    monkeypatch.undo()
    assert quality_classifier.score_documents(docs, labels).where("score between 0 and 1").count() == 240


def test_short_texts_are_scored_in_small_groups():
    params = quality_classifier.train([], [])
    texts = [bytes([97 + i % 26]) * 1000 for i in range(1200)]
    tracemalloc.start()
    scores = quality_classifier.probability(texts, params)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (scores == 0.5).all() and most < 40e6
