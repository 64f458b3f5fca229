"""Sources, the case pipeline, clustering, reports and the entry, end to end."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corrello.plans import cases, clustering, report
from corrello.sources import readers
from corrello.streaming import cycle

PROFILE = {
    "topic_terms": {"recruiter": 1.5, "interview": 1.5, "job": 1.0}, "harm_terms": {"scam": 1.5, "drained": 1.5, "fake": 1.0},
    "lure_keywords": ["repo", "test", "interview", "wallet"], "lure_types": {"coding_test": {"keywords": {"repo": 1.0, "test": 1.0}}},
    "stages": {"contact": ["recruiter"], "payload": ["repo"]}, "brands": ["Acme", "Globex"], "brand_context_regex": "recruiter", "ignore_domains": ["example.org"],
    "generic_phrases": [], "threshold_by_source": {"rss": 0.95},
}
LURE = "please clone the repo and run the test before the interview tomorrow"
TEXTS = [
    ("r1", "reddit:jobs", "ann", f'A recruiter from Acme wrote "{LURE}" and it was a scam. telegram @hr_jane, https://apply-acme.example.com/start drained my wallet'),
    ("r2", "reddit:scams", "bob", f'Recruiter said "{LURE.capitalize()}". Fake job at Globex, telegram @hr_jane drained me'),
    ("r3", "mastodon", "cat", "fake recruiter scam again hxxps://apply-acme[.]example[.]com/start job interview drained"),
    ("r4", "reddit:jobs", "dan", "scam job recruiter at https://hotel-tasks.top/x drained me"),
    ("r5", "reddit:jobs", "eve", "which job should I take after the interview"),
    ("r6", "rss:news", "fay", "a scam job recruiter drained people"),
    ("r7", "manual", None, "a note without any of the words, see https://note.example.net/a"),
]


@pytest.fixture(scope="module")
def built(spark):
    rows = [(i, s, i, None, a, "", b, datetime(2024, 1, n + 1), datetime(2024, 1, n + 1), 0) for n, (i, s, a, b) in enumerate(TEXTS)]
    rows.append(("r8", "reddit:x", "r8", "https://post.example/8", "ANN", "", TEXTS[0][3] + " " * 3 + "x" * 200, datetime(2024, 1, 3), datetime(2024, 1, 20), 0))
    rows.append(("r9", "reddit:y", "r9", None, "ann", "", TEXTS[0][3] + " " + "x" * 200, datetime(2024, 1, 4), datetime(2024, 1, 21), 0))
    return cases.build_cases(spark.createDataFrame(rows, readers.RAW_ITEM), PROFILE, 0.5)


def test_cases(built):
    got = {r["case_id"]: r for r in built.cases.collect()}
    assert set(got) == {"r1", "r2", "r3", "r4", "r7", "r8"}
    assert got["r7"]["relevance"] == 0.9 and got["r1"]["lure_type"] == "coding_test" and got["r1"]["stages"] == ["contact", "payload"]
    assert got["r1"]["lure_text"][0] == LURE
    assert [(r["id"], r["case_id"]) for r in built.repeats.collect()] == [("r9", "r8")] and got["r8"]["notes"] == "Also posted: r9 (reddit:y)"
    edges = {(r["case_id"], r["type"], r["value"]) for r in built.edges.collect()}
    assert {("r1", "brand", "Acme"), ("r1", "telegram", "hr_jane"), ("r2", "telegram", "hr_jane"), ("r3", "domain", "apply-acme.example.com"), ("r1", "phrase", LURE), ("r2", "phrase", LURE)} <= edges
    assert ("url", "https://apply-acme.example.com/start", "hosted-on", "domain", "apply-acme.example.com") in {tuple(r) for r in built.relationships.collect()}
    assert built.queries.where("kind = 'reddit' and term = '@hr_jane' and priority = 1").count() >= 2


def test_clusters_and_report(spark, built):
    got = clustering.build_clusters(built.cases.where("case_id <> 'r8'"), built.edges, built.relationships, config={"text_similarity_threshold": 0.3})
    rows = {r["component"]: r for r in got.summaries.collect()}
    assert set(rows) == {"r1"} and rows["r1"]["cases"] == ["r1", "r2", "r3"]
    s = rows["r1"]
    assert s["confidence"] == "strongly_clustered" and not s["single_reporter"] and s["common_lure"] == LURE
    assert s["shared_telegram"] == ["hr_jane"] and s["shared_domains"] == ["apply-acme.example.com"] and s["edge_counts"]["hard_pairs"] == 2
    groups = {(e["feature"], e["group"]) for e in s["evidence"]}
    assert ("url", "apply-acme.example.com") in groups and ("domain", "apply-acme.example.com") in groups  # a URL is not independent of its domain
    assert s["sources"] == {"reddit": 2, "mastodon": 1} and s["label"].endswith("@hr_jane") and s["pivots"][0].startswith("Search contact handle @hr_jane")
    none = spark.createDataFrame([], "value string, age_days int, registrar string, newly_registered boolean")
    hub = spark.createDataFrame([], "type string, value string, age_days int, young boolean, stars long")
    fresh = spark.createDataFrame([("hotel-tasks.top", 5, "Reg", True)], none.schema)
    lead = report.leads(built.cases, built.edges, got.members, fresh, hub)
    assert [(r["type"], r["value"], r["why"]) for r in lead.collect()][0] == ("domain", "hotel-tasks.top", "registered 5d ago via Reg")
    shown = report.render(got.summaries, built.cases, got.members, lead)
    assert "hxxps://apply-acme[.]example[.]com/start" in shown and "LEADS OUTSIDE CLUSTERS" in shown and shown.startswith("NEW CANDIDATE CLUSTER")
    assert json.loads(report.render(got.summaries, built.cases, got.members, fmt="json"))[0]["size"] == 3
    assert "```" in report.render(got.summaries, built.cases, got.members, fmt="md", min_confidence="probable")
    assert report.case_bundle("r1", built.cases, built.edges, got.members, built.queries)["case"]["author"] == "ann"
    assert "telegram: hr_jane" in report.evidence_text(s)


def test_sources(spark, tmp_path):
    (tmp_path / "abuse.csv").write_text('# head\n"1","2024-01-02 03:04:05","http://x.example/a","online","","malware_download","Emotet,exe","https://ref.example/1","rep"\n"2","short"\n"3","2024-01-02 03:04:05","http://y","online","","other","z","l","rep"\n')
    one = readers.abuse_feed(spark, str(tmp_path / "abuse.csv"), ["emotet"]).collect()
    assert len(one) == 1 and one[0]["title"] == "URLhaus 1: malware_download [Emotet,exe]" and str(one[0]["published_at"]) == "2024-01-02 03:04:05"
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>https://f.example/1</link><description>&lt;p&gt;Body &amp;amp; more&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>")
    rss = readers.feed(spark, str(tmp_path / "feed.xml"), "f").collect()
    assert [(r["source"], r["source_ref"], r["body"], str(r["published_at"])) for r in rss] == [("rss:f", "https://f.example/1", "Body & more", "2024-01-02 03:04:05")]
    toot = {"uri": "u1", "url": "https://m.example/1", "created_at": "2024-01-02T03:04:05Z", "content": "<p>Hello<br>you</p>", "account": {"acct": "a@m"}}
    (tmp_path / "toots.json").write_text(json.dumps([toot, toot]))
    assert [(r["title"], r["body"], r["author"]) for r in readers.toots(spark, str(tmp_path / "toots.json")).collect()] == [("Hello", "Hello\nyou", "a@m")]
    post = {"id": "p", "subreddit": "s", "author": "a", "title": "t", "selftext": "[removed]", "url": "https://bad.example/x", "permalink": "/r/s/p", "created_utc": 1700000000}
    (tmp_path / "posts.json").write_text(json.dumps({"data": [post, {"id": "e", "selftext": "[deleted]", "title": ""}]}))
    got = readers.reddit_archive(spark, str(tmp_path / "posts.json")).collect()
    assert [(r["source"], r["body"], r["url"], str(r["published_at"])) for r in got] == [("reddit:s", "Link: https://bad.example/x", "https://www.reddit.com/r/s/p", "2023-11-14 22:13:20")]
    repo = {"full_name": "O/R", "description": "d", "html_url": "h", "created_at": "2024-01-01T00:00:00Z", "topics": ["x", "y"], "owner": {"login": "O"}, "readme": "aGVsbG8="}
    (tmp_path / "repos.json").write_text(json.dumps({"items": [repo]}))
    row = readers.repositories(spark, str(tmp_path / "repos.json")).first()
    assert row["title"] == "O/R: d" and row["body"].endswith("Topics: x, y\n\n--- README ---\nhello") and row["source_ref"] == "o/r"
    (tmp_path / "note.html").write_text("<p>Saved page</p>")
    assert readers.text_files(spark, str(tmp_path / "note.html")).first()["body"] == "Saved page"
    page = spark.createDataFrame([("https://w.example", "<p>First</p><p>Second</p>")], "url string, html string")
    assert readers.web_pages(page, "seen").first()["body"] == "Analyst note: seen\n\nFirst\nSecond"
    config = {"urlhaus": {"path": str(tmp_path / "abuse.csv")}, "mastodon": {"path": str(tmp_path / "toots.json")}, "rss": {"path": "x", "name": "f", "enabled": False}}
    every = readers.collect(spark, config, F.lit("2024-02-01"), start=F.lit("2024-01-01").cast("timestamp"))
    assert every.groupBy("source").count().count() == 2 and readers.collect(spark, {}, F.lit("2024-02-01")).count() == 0


def test_stream_takes_items_in_once(spark, tmp_path):
    landing, folder = tmp_path / "in", f"file://{tmp_path}/raw"
    landing.mkdir()
    line = lambda i: json.dumps({"id": i, "source": "s", "source_ref": i, "fetched_at": "2024-01-01T00:00:00Z", "generation": 0})
    (landing / "a.json").write_text("\n".join([line("1"), line("2"), line("2")]))
    cycle.stream_items(spark, str(landing), folder, str(tmp_path / "cp")).awaitTermination()
    (landing / "b.json").write_text("\n".join([line("2"), line("3")]))
    cycle.stream_items(spark, str(landing), folder, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(folder).collect()) == ["1", "2", "3"]


def test_display_ids(spark):
    from corrello.operators.state import display_ids

    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string").repartition(5)
    got = {r["k"]: r["display_id"] for r in display_ids(df, "CASE", ["k"]).collect()}
    assert got == {f"k{i:03d}": f"CASE-{i + 1:04d}" for i in range(50)}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "component"] and df.count() > 0


def test_hard_link_components_take_all_hard_rows(spark, tmp_path):
    from corrello.plans import catalogue

    rng = random.Random(5)
    rows = [(rng.randrange(400), rng.randrange(260), rng.choice("RRAN"), float(rng.randint(1, 50))) for _ in range(700)]
    rows += [(i, 999, "R", 50.0) for i in range(0, 400, 8)]  # in 50 orders: a hub links nothing
    rows += [(1000, 998, "R", 1.0), (1001, 998, "R", 2.0), (1001, 998, "R", 3.0), (1002, 998, "A", 50.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cases = {}
    for order, part, flag, _ in rows:
        if flag == "R":
            cases.setdefault(part, set()).add(order)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for linked in cases.values():
        if 2 <= len(linked) <= 25:
            for order in linked:
                a, b = root(order), root(min(linked))
                up[max(a, b)] = min(a, b)
    got = {r["case_id"]: r["component"] for r in catalogue.QUERIES["hard_link_components"](spark, str(tmp_path)).collect()}
    assert got == {x: root(x) for x in up} and got[1001] == 1000 and 1002 not in got


@pytest.mark.parametrize("name", ["case_relationships", "case_rows", "case_pipeline"])
def test_copies_with_ids_far_apart_are_one_case(spark, tmp_path, name):
    """A document has no date: the distance of ids says nothing about seven days."""
    from corrello.plans import catalogue

    body = "the hash d41d8cd98f00b204e9800998ecf8427e with that and from them " * 5
    rows = [(3, body, "s"), (700_003, body, "s"), (2_000_003, body, "s"), (700_004, body, "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "case_relationships":
        assert {(r["src_value"], r["dst_value"]) for r in got if r["predicate"] == "duplicate-of"} == {("700003", "3"), ("2000003", "3")}
    elif name == "case_rows":
        assert {(r["case_id"], r["repeats"]) for r in got} == {("3", 2), ("700004", 0)}
    else:
        assert {r["case_id"] for r in got} == {"3", "700004"}
