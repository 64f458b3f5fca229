"""Joins, graph, state and search operators against brute force or by hand."""

import random
import re
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corrello import store
from corrello.operators import dedup, enrichment, evidence, graph, overlap, pivots, search, similarity, state
from corrello.operators.components import connected_components


def classes_of(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    got = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == classes_of(pairs)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25))) for _ in range(60)]
    texts += [texts[0], texts[1] + " extra words here", texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        from corrello.functions.text import STOPWORDS

        w = [x for x in w if x not in STOPWORDS]
        s = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        if len(s) >= 6:
            sets[i] = s
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 3) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.2}
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.similar_pairs(df, "id", "text", 0.2).collect()}
    assert got == pytest.approx(want, abs=0.0011) and got.keys() == want.keys()


def test_minhash_estimates_jaccard(spark):
    a, b = [f"x{i}" for i in range(100)], [f"x{i}" for i in range(20, 120)]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    est = df.select(similarity.estimated_jaccard(similarity.minhash(F.col("a")), similarity.minhash(F.col("b")))).first()[0]
    assert abs(est - 80 / 120) < 0.2


def test_embedding_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<double>")
    assert [(r["a"], r["b"]) for r in similarity.embedding_pairs(df, "id", "v", 0.9).collect()] == [(1, 2)]


ITEMS = "id string, author string, title string, body string, published_at timestamp, fetched_at timestamp"


def item(ident, author, title, day, body="", fetched=None):
    at = datetime(2024, 1, 1) + timedelta(days=day)
    return ident, author, title, body, at, at if fetched is None else datetime(2024, 1, 1) + timedelta(days=fetched)


def test_repeat_folding(spark):
    long = "same body " * 40
    rows = [
        item("p1", "Ann", "Is this a scam", 0), item("p2", "ann", "is  this a SCAM", 1), item("p3", "Bob", "Is this a scam", 1),
        item("p4", "ann", "is this a scam", 8), item("p5", "ann", "other", 8.5, long), item("p6", "ann", "another", 9, long), item("p7", "[deleted]", "x", 0), item("p8", "[deleted]", "x", 0),
        item("p9", None, "x", 0), item("q1", "cat", "t", 0, "short"), item("q2", "cat", "u", 0, "short"),
    ]
    got = {r["id"]: r["dup_of"] for r in dedup.fold_repeats(spark.createDataFrame(rows, ITEMS)).collect()}
    # p4 is within a week of p2 but p2 is no anchor
    assert got == {"p1": None, "p2": "p1", "p3": None, "p4": None, "p5": None, "p6": "p5", "p7": None, "p8": None, "p9": None, "q1": None, "q2": None}
    assert dedup.fold_repeats(spark.createDataFrame([], ITEMS)).count() == 0


EDGE = "case_id string, type string, value string"


def test_graph_prunes_and_suppresses_hubs(spark):
    rows = [("a", "domain", "d"), ("b", "domain", "d"), ("b", "ip", "1"), ("c", "ip", "1"), ("c", "ip", "2"), ("d", "ip", "2"), ("c", "nameserver", "n"), ("d", "nameserver", "n")]
    rows += [("a", "brand", "B"), ("d", "brand", "B")] + [(f"h{i}", "email", "hub@x.example") for i in range(30)]
    edges = spark.createDataFrame(rows, EDGE)
    none = spark.createDataFrame([("a", "z", 0.4)], "a string, b string, sim double")
    g = graph.case_graph(edges, none, 34)
    assert {(r["a"], r["b"]) for r in g.collect()} == {("a", "b"), ("c", "d"), ("a", "z")}
    assert [tuple(r) for r in graph.hubs(edges, 25).collect()] == [("email", "hub@x.example")]
    assert {r["case_id"]: r["component"] for r in graph.clusters(g).collect()} == {"a": "a", "b": "a", "z": "a", "c": "c", "d": "c"}


@pytest.mark.parametrize(
    "groups, alone, level",
    [
        ([("g1", "high"), ("g2", "high")], False, "strongly_clustered"), ([("g1", "high"), ("g1", "high")], False, "probable"),
        ([("g1", "high"), ("g2", "medium"), ("g3", "medium")], False, "strongly_clustered"), ([("g1", "medium"), ("g2", "medium")], False, "probable"),
        ([("g1", "medium"), ("g2", "low")], False, "possible"), ([("g1", "low"), ("g1", "high")], False, "probable"), ([("g1", "high"), ("g2", "high")], True, "possible"),
    ],
)
def test_ladder(spark, groups, alone, level):
    rows = spark.createDataFrame([("c", g, s) for g, s in groups], "component string, grp string, specificity string")
    who = spark.createDataFrame([("c", alone)], "component string, single_reporter boolean")
    got = evidence.confidence(rows, who).first()
    assert got["confidence"] == level and got["basis"].endswith("; capped: single reporter") == alone


def test_identity_is_greedy_and_stable(spark):
    taken, gone = state.match_clusters([("a", 3), ("b", 2)], [("a", "CLU-0001", 2), ("b", "CLU-0001", 2), ("b", "CLU-0002", 1)], {"CLU-0001": 4, "CLU-0002": 3, "CLU-0003": 2})
    assert taken == {"a": "CLU-0001", "b": "CLU-0002"} and gone == ["CLU-0003"]
    as_of = F.lit("2024-01-01").cast("timestamp")
    members = spark.createDataFrame([("k", "x"), ("k", "y"), ("m", "z"), ("m", "w")], "component string, case_id string")
    none = spark.createDataFrame([], "cluster_id string, case_id string")
    start = spark.createDataFrame([], "cluster_id string, status string, is_new boolean, created_at timestamp, updated_at timestamp, size int")
    clusters, cases = state.persist_identity(members, none, start, as_of)
    assert {r["cluster_id"] for r in clusters.collect()} == {"CLU-0001", "CLU-0002"}
    seen = state.mark_seen(clusters)
    again, _ = state.persist_identity(members, cases, seen, as_of)
    assert sorted((r["cluster_id"], r["status"], r["is_new"]) for r in again.collect()) == [("CLU-0001", "seen", False), ("CLU-0002", "seen", False)]
    fewer, _ = state.persist_identity(members.where("component = 'k'"), cases, seen, as_of)
    assert {r["cluster_id"]: r["status"] for r in fewer.collect()} == {"CLU-0001": "seen", "CLU-0002": "closed"}
    assert {r["status"] for r in state.assess(seen, "CLU-0001", "same").collect()} == {"investigating", "seen"}
    with pytest.raises(ValueError):
        state.assess(seen, "CLU-0001", "maybe")


def test_search(spark):
    rows = [(1, "red fox", "the red fox runs"), (2, "blue", "a fox sleeps"), (3, None, "red paint, red car"), (4, "", "")]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    ids = lambda q: [r["id"] for r in search.search(df, "id", ["title", "body"], q).collect()]
    assert ids("fox")[0] == 1 and set(ids("fox")) == {1, 2}
    assert ids('"red fox"') == [1] and set(ids("red NOT fox")) == {3} and set(ids("sleeps OR car")) == {2, 3} and ids("(fox OR car) AND blue") == [2]
    assert "[fox]" in search.search(df, "id", ["body"], "fox").first()["snippet"]
    with pytest.raises(ValueError):
        search.parse_query("AND fox")


def test_queries_of_a_case(spark):
    schema = "case_id string, source_class string, phrases array<string>, telegram array<string>, wallet_eth array<string>, wallet_btc array<string>, wallet_trx array<string>, domain array<string>, email array<string>, github_user array<string>, brand array<string>"
    row = ["please clone repo test task quickly today"]
    cases = spark.createDataFrame([("c1", "reddit", row, ["jane"], [], [], [], ["a.gov.au", "bad.example"], ["x@y.example"], [], ["Acme"]), ("c2", "rss", row, [], [], [], [], ["bad.example"], [], [], [])], schema)
    profile = {"lure_keywords": ["repo", "task"], "pivot_templates": {}}
    got = pivots.case_queries(cases, profile).collect()
    one = {(r["kind"], r["term"]): r["priority"] for r in got if r["case_id"] == "c1"}
    assert one[("reddit", "@jane")] == 1 and one[("reddit", "Acme scam")] == 4 and ("reddit", "a.gov.au") not in one and one[("github", '"bad.example"')] == 3
    assert ("reddit", '"please clone repo test task quickly today"') in one
    assert not [r for r in got if r["case_id"] == "c2" and "bad.example" in r["term"]]
    stored = pivots.store_queries(pivots.case_queries(cases, profile), None, F.lit("2024-01-01").cast("timestamp"))
    assert {r["status"] for r in stored.where("kind = 'web'").collect()} == {"manual"}


def test_enrichment_edges(spark):
    at = datetime(2024, 1, 10)
    rdap = '{"events":[{"eventAction":"registration","eventDate":"2024-01-01T00:00:00Z"}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Reg Inc"]]]}],"nameservers":[{"ldhName":"NS2.X"},{"ldhName":"ns1.x"}]}'
    log = spark.createDataFrame(
        [
            ("domain", "d.example", "dns", at, True, '{"a":["9.9.9.9"],"ns":["ns1.x"],"mx":["10 mx.d.example."]}'),
            ("domain", "d.example", "rdap", at, True, rdap),
            ("domain", "d.example", "rdap", datetime(2023, 1, 1), True, "{}"),
            ("github_repo", "o/r", "github", at, True, '{"created_at":"2024-01-10T00:00:00Z","owner":{"login":"O"},"dependencies":["npm:react","npm:odd-lib"],"stargazers_count":2}'),
        ],
        "type string, value string, provider string, fetched_at timestamp, ok boolean, payload string",
    )
    as_of = F.lit("2024-01-10").cast("timestamp")
    facts = enrichment.rdap_facts(log, as_of).first()
    assert facts["registrar"] == "Reg Inc" and facts["age_days"] == 9 and facts["newly_registered"] and facts["nameservers"] == ["ns1.x", "ns2.x"]
    assert enrichment.github_facts(log, as_of).first()["young"]  # created today is young
    edges = spark.createDataFrame([("c1", "domain", "d.example"), ("c2", "github_repo", "o/r")], EDGE)
    new, rel = enrichment.derived(edges, log, as_of)
    assert {(r["case_id"], r["type"], r["value"]) for r in new.collect()} == {("c1", "ip", "9.9.9.9"), ("c1", "nameserver", "ns1.x"), ("c2", "dependency", "npm:odd-lib"), ("c2", "github_user", "o")}
    assert ("registered-via", "Reg Inc") in {(r["predicate"], r["dst_value"]) for r in rel.collect()}
    todo = spark.createDataFrame([("domain", "d.example", 3, at), ("domain", "e.example", 1, at)], "type string, value string, case_count int, last_seen timestamp")
    assert {(r["provider"], r["value"]) for r in enrichment.queue(todo, log, as_of).where("provider in ('dns', 'rdap')").collect()} == {("dns", "e.example"), ("rdap", "e.example")}
    deps = spark.createDataFrame([('{"dependencies":{"a":"1"},"devDependencies":{"b":"2"}}', "# c\nFlask>=2\n-r x\nodd_lib[x]==1")], "p string, r string")
    assert deps.select(enrichment.dependencies(F.col("p"), F.col("r"))).first()[0] == ["npm:a", "npm:b", "pypi:flask", "pypi:odd_lib"]


def test_dense_links_give_the_classes_of_all_pairs(spark):
    import random

    rng = random.Random(11)
    kinds = ["domain", "ip", "nameserver", "dependency", "phrase"]
    rows = [(rng.randint(0, 60), rng.choice(kinds), f"v{rng.randint(0, 9)}") for _ in range(220)] + [(i, "ip", "big") for i in range(70, 90)] + [(i, "nameserver", "wide") for i in range(75, 95)]
    edges = spark.createDataFrame(rows, "case_id long, type string, value string")
    none = spark.createDataFrame([], "a long, b long, sim double")

    def classes(dense):
        held = graph.case_graph(edges, none, 1, absolute=40, fraction=0.0, dense=dense)
        return sorted(map(tuple, graph.clusters(held, 1).collect())), held.count()

    (want, pairs), (got, links), (all_star, fewest) = classes(None), classes(5), classes(1)
    assert got == want == all_star and pairs > links > fewest > 0


def test_copies_as_a_star(spark):
    texts = ["one two three four five six seven eight nine ten"] * 12 + ["one two three four five six seven eight nine eleven"] * 2 + ["quite other words stand here today instead of those others there friend"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    every = similarity.similar_pairs(df, "id", "text", 0.3)
    star = similarity.similar_pairs(df, "id", "text", 0.3, most_copies=3)
    assert every.count() == 91 and star.count() == 11 + 1 + 2
    one = lambda links: sorted(map(tuple, graph.clusters(links, 1).collect()))
    assert one(every) == one(star)


@pytest.mark.parametrize("seed", range(4))
def test_claims_in_rounds_equal_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    comps = {f"k{i}": rng.randrange(1, 12) for i in range(40)}
    sizes = {f"CLU-{i:04d}": rng.randrange(1, 14) for i in range(25 if seed % 2 else 8)}
    overlaps = sorted({(k, c, rng.randrange(1, 6)) for k in comps for c in rng.sample(sorted(sizes), 4)})
    best = {(k, c): n for k, c, n in overlaps}
    want, _ = state.match_clusters(comps.items(), [(k, c, n) for (k, c), n in best.items()], sizes)
    rows = spark.createDataFrame([(k, comps[k], c, sizes[c], n) for (k, c), n in best.items()], "component string, size long, cluster_id string, cluster_size long, shared long")
    assert {r["component"]: r["cluster_id"] for r in state.claims(rows).collect()} == want
    assert state.claims(rows.where("1 = 0")).count() == 0


def test_a_long_chain_of_claims_settles(spark):
    # every component's first wish is held by the one before it
    rows = [(f"k{i:02d}", 100 - i, f"CLU-{j:04d}", 2, 9 - (j != i - 1)) for i in range(12) for j in (i - 1, i) if j >= 0]
    df = spark.createDataFrame(rows, "component string, size long, cluster_id string, cluster_size long, shared long")
    assert {r["component"]: r["cluster_id"] for r in state.claims(df).collect()} == {f"k{i:02d}": f"CLU-{i:04d}" for i in range(12)}


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "date"])
def test_embedding_pairs_of_any_ids_and_lengths(spark, kind):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(48)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in base[i % 6]]) for i in range(90)] + [(100 + i, [1.0, float(i)]) for i in range(5)]
    rows += [(200, None), (201, []), (202, [0.0] * 48), (203, [float("nan")] * 48), (204, [None] * 48), (205, [float("inf"), 1.0]), (None, base[0]), (3, rows[9][1])]
    df = spark.createDataFrame(rows, "n int, v array<double>").withColumn("a", F.lit("clash"))
    name = {"int": "n", "bigint": "cast(n as bigint)", "string": "format_string('%03d', n)", "date": "date_add(date'2024-01-01', n)"}[kind]
    name = f"if(n is null, null, {name})"
    df = df.withColumn("id", F.expr(name))
    back = {r["id"]: r["n"] for r in df.where("n is not null").select("id", "n").collect()}
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and abs(x) < 1e300 for x in v) and any(v)]
    want = set()
    for (i, v), (j, w) in combinations(sound, 2):
        if i != j and len(v) == len(w):
            cos = sum(x * y for x, y in zip(v, w, strict=True)) / (sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5)
            if cos >= 0.7:
                want.add((min(i, j), max(i, j), round(cos, 9)))
    got = similarity.embedding_pairs(df, "id", "v", 0.7, block=16).collect()
    assert {(back[r["a"]], back[r["b"]], round(r["cosine"], 9)) for r in got} == want and len(want) > 200
    assert similarity.embedding_pairs(df.where("1 = 0"), "id", "v", 0.7).count() == 0


def test_bounds_spare_most_of_far_pairs(spark):
    rng = random.Random(6)
    heavy = lambda: [rng.gauss(0, 1) * 0.85**k for k in range(64)]  # noqa: E731  a few components hold most of the norm
    df = spark.createDataFrame([(i, heavy()) for i in range(300)], "id int, v array<double>")
    assert similarity.embedding_work(df, "id", "v", 0.9) < 0.2


def test_an_author_of_many_years_is_many_units(spark):
    start, day = datetime(2020, 1, 1), 86_400
    rng = random.Random(7)
    when = sorted(rng.randrange(0, 900) * day + rng.choice((0, 1, day - 1)) for _ in range(120)) + [3000 * day, 3007 * day, 3014 * day + 1]
    rows = [(f"i{i:03d}", "firehose", "the same", "", start + timedelta(seconds=s), start + timedelta(days=4000, seconds=i)) for i, s in enumerate(rng.sample(when, len(when)))]
    rows.append(("void", "firehose", "the same", "", None, None))
    df = spark.createDataFrame(rows, "id string, author string, title string, body string, published_at timestamp, fetched_at timestamp")
    fold, want = dedup.Fold(), {"void": None}
    for r in rows[:-1]:
        want[r[0]] = fold.add(r[0], r[4].timestamp(), ["t"])
    assert {r["id"]: r["dup_of"] for r in dedup.fold_repeats(df).collect()} == want
    units = dedup.sessions(df.where("id <> 'void'").select("author", F.unix_timestamp("published_at").alias("at")), "author", "at")
    times = sorted(r[4].timestamp() for r in rows[:-1])
    assert units.select("session").distinct().count() == 1 + sum(b - a > 7 * day for a, b in zip(times, times[1:], strict=False)) > 20
    pairs = {(r["id"], r["earlier"]) for r in dedup.repeat_pairs(df).collect()}
    at = {r[0]: r[4].timestamp() for r in rows[:-1]}
    assert pairs == {(b, a) for a, b in combinations([r[0] for r in rows[:-1]], 2) if abs(at[a] - at[b]) <= 7 * day}


@pytest.mark.parametrize("most", [0, 1000])
def test_shared_windows(spark, most):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice((" ", "!  ", ", ")).strip() for _ in range(n))
    items = [(f"b{i}", prose(30)) for i in range(6)] + [("short", "a b"), ("void", None)]
    docs = [(i, prose(20) + " " + rng.choice(items[:6])[1][: rng.randrange(60)]) for i in range(40)] + [(7, items[0][1]), (90, None), (91, ""), (92, "a " * 5000)]
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    windows = lambda t: {tuple(words(t)[i : i + 4]) for i in range(len(words(t)) - 3)}
    of_doc, of_item = {}, {i: windows(t) for i, t in items}
    for i, t in docs:
        of_doc[i] = of_doc.get(i, set()) | windows(t)
    want = {(d, b, len(x & y)) for d, x in of_doc.items() for b, y in of_item.items() if x & y}
    left = spark.createDataFrame(docs, "doc_id int, text string").withColumn("w", F.lit("clash"))
    got = overlap.shared_windows(left, spark.createDataFrame(items, "item_id string, text string"), "doc_id", "item_id", size=4, most=most)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40


@pytest.mark.parametrize("most", [0, 1000])
def test_only_texts_with_a_shared_window_are_split_again(spark, most, monkeypatch):
    split = []
    real = overlap._worded
    monkeypatch.setattr(overlap, "_worded", lambda df, *a: split.append(df) or real(df, *a))
    left = spark.createDataFrame([(i, f"x{i} y{i} z{i} a b c d" if i < 3 else f"x{i} y{i} z{i} a b") for i in range(50)], "doc_id int, text string")
    got = overlap.shared_windows(left, spark.createDataFrame([("b", "a b c d e")], "item_id string, text string"), "doc_id", "item_id", size=4, most=most)
    assert {tuple(r) for r in got.collect()} == {(i, "b", 1) for i in range(3)}
    assert split[-1].count() == 3


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8])
def test_hashes_of_windows_tell_their_words(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.choice("ab") for _ in range(rng.randrange(size, size + 12))]) for i in range(40)]
    made = {(r["id"], r["at"]): r["h"] for r in overlap._hashed(spark.createDataFrame(rows, "id int, w array<string>"), size).collect()}
    want = {(i, at): tuple(w[at : at + size]) for i, w in rows for at in range(len(w) - size + 1)}
    assert made.keys() == want.keys() and len(set(made.values())) == len({(made[k], want[k]) for k in made}) == len(set(want.values()))


def test_tokens_of_one_set_only_are_not_written(spark, monkeypatch):
    """What is kept of the sets is what pairs can share; copies of a set count once."""
    written = {}

    def keep(df, name, real=similarity.keep):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(similarity, "keep", keep)
    monkeypatch.setattr(similarity, "forget", lambda df: None)
    own = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    alike = own[0].split()
    rows = [*own, own[3], own[3], " ".join(alike[:30] + ["new"] * 2), None]
    members, pairs = similarity.similar_classes(spark.createDataFrame(list(enumerate(rows)), "id long, text string"), "id", "text", 0.3)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(0, 22)] and members.count() == 23
    assert all("set" not in df.columns for df in written.values())
    tokens = [t for r in written["sim-common"].where("tokens is not null").collect() for t in r["tokens"]]
    assert len(tokens) == 2 * 29 and len(set(tokens)) == 29


def test_packed_tokens_come_back():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, top in ((1, 2**64), (2, 2**64), (500, 2**64), (500, 300), (3, 1)):
        tokens = np.sort(rng.integers(0, top - 1, n, np.uint64, endpoint=True))
        docs = rng.integers(0, 1 << 16, n)
        back = similarity._unpack(similarity._pack(tokens, docs))
        assert back[0].tolist() == tokens.tolist() and back[1].tolist() == docs.tolist()


def test_blocks_of_vectors_are_few(spark):
    """Vectors are sent once per block, so blocks must not follow their number; every pair
    of blocks, of even and odd rings, meets once."""
    import numpy as np

    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(700, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, v array<double>").repartition(3)
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.8), strict=True) if i < j}
    for block in (None, 100, 117, 350, 700):  # 3, 7, 6, 2 and 1 blocks
        got = [(r["a"], r["b"]) for r in similarity.embedding_pairs(df, "id", "v", 0.8, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    many = spark.range(20_000).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    work = similarity._embedding_blocks(many, "id", "v", 1.1, None).where("a is null").count()
    assert work == similarity.FEWEST * (similarity.FEWEST + 1) // 2


@pytest.mark.parametrize("dense", [None, 4])
@pytest.mark.parametrize("listed", [3, 1000])
def test_pairs_are_not_shuffled(spark, monkeypatch, dense, listed):
    monkeypatch.setattr(graph, "LISTED", listed)
    rng = random.Random(3)
    rows = sorted({(f"c{rng.randrange(30):02d}", rng.choice(("domain", "email")), f"v{rng.randrange(12)}") for _ in range(160)})
    sims = [("c01", "c02", 0.4), ("c01", "c02", 0.7), ("zz", "zzz", 0.5)]
    edges, similar = spark.createDataFrame(rows, "case_id string, type string, value string"), spark.createDataFrame(sims, "a string, b string, sim double")
    found = graph.similar_or_shared_pairs(edges, 9, dense, similar)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\d+L?, b#", plan)
    cases, want = {}, {}
    for c, t, v in rows:
        cases.setdefault((t, v), []).append(c)
    for key, some in cases.items():
        if 2 <= len(some) <= 9:
            firsts = some[:1] if dense and len(some) > dense else some
            for a, b in ((a, b) for a in firsts for b in some if a < b):
                want.setdefault((a, b), [[], None])[0].append(key)
    for a, b, s in sims:
        w = want.setdefault((a, b), [[], None])
        w[1] = max(s, w[1] or 0)
    got = {(r["a"], r["b"]): [[(e["type"], e["value"]) for e in r["evidence"]], r["sim"]] for r in found.collect()}
    assert got == {k: [sorted(e), s] for k, (e, s) in want.items()}
    assert {e["weight"] for r in found.collect() for e in r["evidence"]} == {1.0}


def test_lookups_are_told_apart_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Edges to derive from are dealt by rows, not by their compressed size, and not told apart before."""
    monkeypatch.setattr(store, "TASK_ROWS", 20, raising=False)
    edges = spark.createDataFrame([(i % 90, "domain", f"d{i % 7}.example") for i in range(200)], "case_id int, type string, value string")
    payload = '{"a":["8.8.4.4"],"ns":["ns1.example"],"resolves":true}'
    log = [("domain", f"d{i}.example", "dns", datetime(2024, 1, 1), True, payload) for i in range(7)]
    new, _ = enrichment.derived(edges, spark.createDataFrame(log, "type string, value string, provider string, fetched_at timestamp, ok boolean, payload string"), F.lit(datetime(2024, 6, 1)))
    rows = new.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["case_id"], r["type"], r["value"]) for r in rows} == {(i, *x) for i in range(90) for x in (("ip", "8.8.4.4"), ("nameserver", "ns1.example"))} and len(rows) == 180
    assert len({r["task"] for r in rows}) > 4


def _unwound(df, marker):
    return df._jdf.queryExecution().optimizedPlan().toString().count(marker)


def test_features_of_clusters_are_counted_once(spark):
    """A summary reads the edges once, evidence lists cases of shared features only."""
    members = spark.createDataFrame([(1, c) for c in range(6)], "component int, case_id int")
    at = datetime(2024, 1, 1)
    cases = spark.createDataFrame([(c, "rss:x", "a", at, "l", ["line"]) for c in range(6)], "case_id int, source string, author string, published_at timestamp, lure_type string, lure_text array<string>")
    edges = spark.createDataFrame([(c, t, f"{t}{c // 2}") for c in range(6) for t in ("domain", "brand", "ip", "github_repo") for _ in range(2)], "case_id int, type string, value string").where("rand() < 2 and value <> 'marker'")
    none = spark.createDataFrame([], "a int, b int, evidence array<struct<type:string,value:string,weight:double>>, sim double")
    hubs = spark.createDataFrame([("ip", "ip0")], "type string, value string")
    parents = spark.createDataFrame([], "type string, value string, parent string")
    found = evidence.cluster_evidence(members, edges, none, parents, hubs)
    assert {(r["feature"], r["value"], *r["cases"]) for r in found.collect()} == {(t, f"{t}{c}", 2 * c, 2 * c + 1) for t in ("domain", "ip", "github_repo") for c in range(3)} - {("ip", "ip0", 0, 1)}
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    kept = spark.createDataFrame(found.collect(), found.schema)
    rdap = spark.createDataFrame([("domain1", True)], "value string, newly_registered boolean")
    told = evidence.summaries(members, cases, edges, none, kept, hubs, rdap)
    row = told.first()
    assert (row["brands"], row["young_domains"], row["shared_ips"], row["repos"]) == (["brand0", "brand1", "brand2"], ["domain1"], ["ip1", "ip2"], ["github_repo0", "github_repo1", "github_repo2"])
    assert _unwound(told, "marker") == 0


def test_hard_links_read_their_edges_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 20, raising=False)
    edges = spark.createDataFrame([(c, "domain", f"d{c // 3}") for c in range(90) for _ in range(2)] + [(c, "ip", "x") for c in range(9)], "case_id int, type string, value string")
    held = []
    monkeypatch.setattr(graph, "keep", lambda df, name: held.append(df) or store.keep(df, name))
    links = {tuple(r) for r in graph.hard_links(edges, 25).collect()}
    assert links == {(c, c - c % 3) for c in range(90) if c % 3}
    assert held[0].withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4


def test_sets_alike_are_not_found_once_per_token(spark, monkeypatch):
    """Many texts alike meet in blocks, others by their rare shingles."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.choice((3, 8, 20))):
            words[at] = f"x{i}{chr(97 + at % 26)}{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"z{i}q{k}" for k in range(20)) + f" tail{j}" for i in range(5) for j in range(3)]  # few near copies
    shingled = [{a + " " + b for a, b in zip(t.split(), t.split()[1:], strict=False)} for t in texts]
    want = {}
    for a, b in combinations(range(len(texts)), 2):
        j = len(shingled[a] & shingled[b]) / len(shingled[a] | shingled[b])
        if j >= 0.3:
            want[a, b] = j
    kept = {}

    def spy(df, name, own=similarity.keep):
        kept[name] = own(df, name)
        return kept[name]

    monkeypatch.setattr(similarity, "keep", spy)
    for name, value in (("CROWD", 3), ("CROWD_SHARE", 10**9), ("CROWD_BLOCK", 16), ("PAIR_BLOCK", 2)):
        monkeypatch.setattr(similarity, name, value)
    for block in (similarity.BLOCK, 40):
        monkeypatch.setattr(similarity, "BLOCK", block)
        members, pairs = similarity.similar_classes(spark.createDataFrame([(f"t{i:03d}", t) for i, t in enumerate(texts)], "id string, text string"), "id", "text", 0.3)
        got = {(int(r["a"][1:]), int(r["b"][1:])): r["jaccard"] for r in pairs.collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] for k in want) and pairs.count() == len(want)
    assert len(want) > 500 and kept["sim-found"].count() < len(want) / 3


def test_sketches_rule_out_far_pairs_only(spark):
    rng = random.Random(8)
    sets = {}
    for i in range(40):
        size = rng.choice((3, 20, 70, 300))
        own = [rng.getrandbits(63) for _ in range(size)]
        other = sets[rng.randrange(i)][1] if i else []
        share = rng.sample(other, min(len(other), int(size * rng.choice((0, 0.3, 0.6, 1)))))
        sets[i] = (len({*own, *share}) + rng.choice((0, 5)), sorted({*own, *share}))
    rows = spark.createDataFrame([(i, n, c) for i, (n, c) in sets.items()], "set_id long, n int, common array<long>")
    sized = [(a, b) for a, b in combinations(sets, 2) if min(sets[a][0], sets[b][0]) >= 0.3 * max(sets[a][0], sets[b][0])]
    found = spark.createDataFrame(sized, "a long, b long")
    kept = {(r["a"], r["b"]) for r in similarity.possible_pairs(found, rows, 0.3).collect()}
    near = set()
    for a, b in combinations(sets, 2):
        shared = len({*sets[a][1]} & {*sets[b][1]})
        if shared / (sets[a][0] + sets[b][0] - shared) >= 0.3:
            near.add((a, b))
    assert near and near <= kept and len(kept) < len(sized) / 3


def test_signatures_are_those_of_minhash(spark):
    rows = spark.createDataFrame([(1, ["a", "b c", "d"]), (2, []), (3, [f"x{i}" for i in range(700)]), (4, ["é"])], "id long, s array<string>")
    want = {r["id"]: r["m"] for r in rows.select("id", similarity.minhash(F.col("s")).alias("m")).collect()}
    got = similarity.signatures(rows.select("id", F.transform("s", lambda s: F.xxhash64(s)).alias("hashes")))
    assert {r["id"]: r["m"] for r in got.collect()} == want


def test_what_was_shuffled_for_a_kept_table_goes_with_it(spark):
    stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = stored.getAllFiles().size()
    table = store.keep(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "shuffled")
    assert stored.getAllFiles().size() <= before and table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
