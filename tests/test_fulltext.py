"""Stems by hand; search against a scan of all texts."""

import random
import re

import numpy as np
import pytest

from corrello.functions.porter import normal, stem
from corrello.operators import fulltext

STEMS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing,
conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky,
relational relat, conditional condit, rational ration, valenci valenc, digitizer digit, radicalli radic, differentli differ, vileli vile, analogousli analog,
vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal,
sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good,
revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac,
adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect,
bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, running run, runs run, training train, trained train, by by, is is"""


def test_stems_of_the_published_examples():
    for pair in STEMS.replace("\n", " ").split(", "):
        word, want = pair.split()
        assert stem(word) == want, word
    assert normal("déjà") == "deja" and normal("Ünits".lower()) == "unit" and normal("running", False) == "running"
    assert stem("a" * 70 + "ing") == "a" * 70 + "ing"


def test_a_last_e_stays_behind_two_letters(spark):
    assert [stem(w) for w in ("ofes", "one", "uses", "ofing", "ofed")] == ["ofe", "one", "use", "of", "of"]
    rows = [(1, "ofes the licensed"), (2, "of the licensed"), (3, "ofing the licensed")]
    index = fulltext.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"])
    assert sorted(r["id"] for r in fulltext.search(index, '"of the" AND licensed', None).collect()) == [2, 3]


def scan(rows, query_words, fits):
    """ids for which ``fits`` holds of {phrase: count} by reading every text."""
    out = []
    for ident, *texts in rows:
        count = {}
        for phrase in query_words:
            want = [normal(w) for w in phrase.split()]
            count[phrase] = 0
            for text in texts:
                have = [normal(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
                count[phrase] += sum(have[i : i + len(want)] == want for i in range(len(have)))
        if fits(count):
            out.append(ident)
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    fulltext.BLOCK = 500  # many blocks
    rng = random.Random(4)
    words = "run running runs fee fees training trained period telegram code coding challenge of the Wallet été".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 5))), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None, None), (201, "", "..."), (202, "training", "fee"), (203, "the " * 3000, None), (204, "wallets, été", "x"), (205, "only ETE", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, title string, body string, term string, length int")
    return rows, fulltext.build(df, "id", ["title", "body"])


@pytest.mark.parametrize(
    "query, phrases, fits",
    [
        ("run", ["run"], lambda c: c["run"]),
        ('"training fee" OR "training period"', ["training fee", "training period"], lambda c: c["training fee"] or c["training period"]),
        ('telegram AND "coding challenge"', ["telegram", "coding challenge"], lambda c: c["telegram"] and c["coding challenge"]),
        ("wallet NOT (run OR fee)", ["wallet", "run", "fee"], lambda c: c["wallet"] and not (c["run"] or c["fee"])),
        ('"of the the"', ["of the the"], lambda c: c["of the the"]),
        ("ete", ["ete"], lambda c: c["ete"]),
        ("nothing", ["nothing"], lambda c: c["nothing"]),
    ],
)
def test_search_equals_a_scan(corpus, query, phrases, fits):
    rows, index = corpus
    assert sorted(r["id"] for r in fulltext.search(index, query, None).collect()) == scan(rows, phrases, fits)


def test_scores_and_order(corpus):
    import math

    rows, index = corpus
    got = fulltext.search(index, '"training fee" OR run', 10).collect()
    lists = {r[0]: [normal(w) for t in r[1:] for w in [*re.findall(r"[^\W_]+", (t or "").lower()), ""]] for r in rows}
    lengths = {i: len(x) - 2 for i, x in lists.items() if len(x) > 2}
    mean, n = sum(lengths.values()) / len(lengths), len(lengths)
    score = {i: 0.0 for i in lists}
    for phrase in (["train", "fee"], ["run"]):
        tf = {i: sum(x[j : j + len(phrase)] == phrase for j in range(len(x))) for i, x in lists.items()}
        df = sum(v > 0 for v in tf.values())
        for i, f in tf.items():
            if f:
                score[i] += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
    want = sorted((-round(s, 9), i) for i, s in score.items() if s)[:10]
    assert [(-round(r["score"], 9), r["id"]) for r in got] == want


def test_a_query_reads_no_text_and_only_its_buckets(corpus):
    _, index = corpus
    plan = index.lists(["run"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "ReadSchema: struct<block:bigint,term:string,list:binary>" in plan
    met = fulltext.matches(index, '"of the" NOT run')._jdf.queryExecution().toString()
    assert "title" not in met and "body" not in met


def test_lists_are_packed_and_unpacked():
    rng = np.random.default_rng(1)
    for top in (1, 100, 1 << 14, 1 << 21, (1 << 32) - 1):
        values = rng.integers(0, top + 1, 200)
        assert (fulltext._unpack(fulltext._pack(values)[0].tobytes()) == values).all()
    assert len(fulltext._unpack(b"")) == 0


def test_snippets(corpus, spark):
    assert fulltext.excerpt("a b c the fox d", [(3, 2)], 12) == "a b c [the fox] d"
    assert fulltext.excerpt("the fox, the dog", [(2, 2)], 12) == "the fox, [the dog]"  # a word of the phrase alone is no hit
    long = " ".join(f"w{i}" for i in range(40))
    assert fulltext.excerpt(long, [(20, 1)], 6) == "…w18 w19 [w20] w21 w22 w23…"
    assert fulltext.excerpt("", [(0, 1)]) == "" and fulltext.excerpt("no hit", []) == "no hit"
    df = spark.createDataFrame([(1, "Fee", "A running dog asked for fees."), (2, "x", "nothing")], "id long, title string, body string")
    index = fulltext.build(df, "id", ["title", "body"])
    (row,) = fulltext.search(index, "run AND fee", shown="body").collect()
    assert row["snippet"] == "A [running] dog asked for [fees]."


def test_an_empty_index(spark):
    index = fulltext.build(spark.createDataFrame([], "id long, text string"), "id", ["text"])
    assert fulltext.search(index, "a OR b").count() == 0
