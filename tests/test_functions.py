"""Scalar functions on hand-written rows."""

from pyspark.sql import functions as F

from corrello.functions import html, indicators, scoring, text


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


def test_refang_and_defang(spark):
    assert one(spark, text.refang(F.col("t")), t="see hxxps://bad[.]example/x") == "see https://bad.example/x"
    assert one(spark, text.refang(F.col("t")), t="hr[at]corp(.)example or hr at corp.example") == "hr@corp.example or hr@corp.example"
    assert one(spark, text.refang(F.col("t")), t="a{dot}b c dot d meet at noon") == "a.b c.d meet at noon"
    assert one(spark, text.defang(F.col("t")), t="https://a.b.example/x") == "hxxps://a[.]b[.]example/x"
    assert one(spark, text.refang(F.col("t")), t=None) is None


def test_normalise_sentences_shingles(spark):
    assert one(spark, text.normalise(F.col("t")), t="See  https://x.example/y — It’s GREAT, really!") == "see it's great really"
    assert one(spark, text.sentences(F.col("t")), t="One two three. Too short! Four five six seven?\n\nA new block here") == ["One two three.", "Four five six seven?", "A new block here"]
    assert sorted(one(spark, text.shingles(F.col("t")), t="Quick foxes jump over lazy dogs")) == sorted(["quick foxes", "foxes jump", "jump lazy", "lazy dogs"])
    assert one(spark, text.shingles(F.col("t")), t="single") == ["single"]
    assert one(spark, text.shingles(F.col("t")), t="") == []
    assert one(spark, text.shingles(F.col("t")), t=None) == []


def test_small_text_helpers(spark):
    assert one(spark, text.registrable(F.col("t")), t="a.b.co.uk") == "b.co.uk"
    assert one(spark, text.registrable(F.col("t")), t="a.b.example") == "b.example"
    assert one(spark, text.registrable(F.col("t")), t="localhost") == "localhost"
    assert one(spark, text.snippet(F.col("t"), F.col("n")), t="x " * 60 + "Needle\n here", n="needle").endswith("Needle here")
    assert one(spark, text.snippet(F.col("t"), F.col("n")), t="hay", n="needle") is None
    assert one(spark, text.truncate(F.col("t"), 3), t="abcdef") == "abc\n…[truncated]"
    assert str(one(spark, text.timestamp(F.col("t")), t="1700000000")) == "2023-11-14 22:13:20"
    assert str(one(spark, text.timestamp(F.col("t")), t="2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert one(spark, text.timestamp(F.col("t")), t="soon") is None
    assert one(spark, text.with_hyphens_spread(F.col("t")), t="Fake-Job") == "fake-job fake job"


SINK = (
    "Visit hxxps://pay-me[.]example.com/Login?a=1. mirror http://203.0.113.5/x http://8.8.8.8/y file.py evil-site.top e.g. "
    "mail boss@corp.example.com and 10.0.0.1, 9.9.9.9:443; telegram @recruiter_jane or https://t.me/+JoinUs99 not @user@host.example; "
    "code in github.com/Owner-1/Repo.git and https://github.com/topics/ai; "
    "sha " + "a" * 64 + " md5 " + "1" + "b" * 31 + " eth 0x" + "A1" * 20 + " trx T" + "9" * 33 + " btc 1BoatSLRHtKNngkdXEeobR76b53LETtpyT https://skip.ignored.example.org/z"
)


def test_every_indicator_type(spark):
    df = spark.createDataFrame([(1, SINK), (2, ""), (3, None)], "id int, text string")
    rows = indicators.observables(df, "id", "text", F.array(F.lit("example.org")), [*indicators.COMMON_TLDS]).collect()
    got = {}
    for r in rows:
        assert r["id"] == 1
        got.setdefault(r["type"], set()).add(r["value"])
    assert got["url"] == {"https://pay-me.example.com/Login?a=1", "http://8.8.8.8/y"}
    assert got["domain"] == {"pay-me.example.com", "evil-site.top", "host.example"} - {"host.example"}
    assert got["ip"] == {"8.8.8.8", "9.9.9.9"}
    assert got["email"] == {"boss@corp.example.com", "user@host.example"}
    assert got["telegram"] == {"recruiter_jane", "joinus99"}
    assert got["github_repo"] == {"owner-1/repo"} and got["github_user"] == {"owner-1"}
    assert got["sha256"] == {"a" * 64} and "sha1" not in got and got["md5"] == {"1" + "b" * 31}
    assert got["wallet_eth"] == {"0x" + "a1" * 20} and got["wallet_trx"] == {"T" + "9" * 33}
    assert got["wallet_btc"] == {"1BoatSLRHtKNngkdXEeobR76b53LETtpyT"}


def test_handles_need_context_and_boundaries(spark):
    df = spark.createDataFrame([(1, "write @jane_doe today"), (2, "foot.me/abcd telegram")], "id int, text string")
    assert indicators.observables(df, "id").where("type = 'telegram'").count() == 0


def test_public_ip(spark):
    rows = [("8.8.8.8", True), ("100.64.0.1", True), ("192.0.0.9", True), ("203.0.113.7", False), ("0.1.2.3", False), ("08.8.8.8", False), ("1.2.3.256", False), ("240.0.0.1", False), ("172.32.0.1", True)]
    df = spark.createDataFrame(rows, "ip string, want boolean")
    assert df.where(indicators.is_public_ip(F.col("ip")) != F.col("want")).count() == 0


PROFILE = {
    "topic_terms": {"job": 1.0, "recruiter": 1.5, "interview": 1.5},
    "harm_terms": {"scam": 1.5, "drained": 1.5, "malware": 1.5},
    "campaign_terms": {"harvest lure": 2.0},
}


def test_relevance_gate(spark):
    score = lambda t, title=None: one(spark, scoring.relevance(F.col("t"), F.col("title"), PROFILE), t=t, title=title)
    assert score("a recruiter for a job ran a scam and drained me") > 0.5
    assert score("a nice job interview") == 0.0
    assert score("the market is a scam") == 0.0
    assert score("seen in the Harvest-Lure wave") > 0.6
    assert score("is this job a scam?", "is this job a scam?") > score("is this job a scam?")
    assert score("jobless") == 0.0 and score(None) == 0.0


def test_phrases_and_classes(spark):
    said = 'They wrote “please clone the repo and run the test task today”. Nothing else. Then run the repo test for the interview now.'
    got = one(spark, scoring.lure_phrases(F.col("t"), ["repo", "test", "interview"]), t=said)
    assert got[0] == "please clone the repo and run the test task today" and "then run the repo test for the interview now" in got
    assert one(spark, scoring.lure_phrases(F.col("t"), ["repo"]), t="") == []
    types = {"a": {"keywords": {"wallet": 1.0, "drain": 1.0}}, "b": {"keywords": {"drain": 2.0}}, "c": {"keywords": {"x": 9.0}}}
    assert one(spark, scoring.lure_type(F.col("t"), types), t="wallet drained") == "a"
    assert one(spark, scoring.lure_type(F.col("t"), types), t="nothing") is None
    assert one(spark, scoring.stages(F.col("t"), {"s1": ["pay"], "s2": ["fee"], "s3": ["zzz"]}), t="coffee then PAY") == ["s1", "s2"]


def test_brands():
    find = scoring.BrandFinder(["Target", "Acme"], [r"recruiter from (\w+)"], ["Acme call"], "recruiter|hiring", 40)
    assert find("a recruiter said Target is hiring; our target is fun") == {"Target": 0.9}
    assert find("on an Acme call with a recruiter from Zorb") == {"Zorb": 0.5}
    assert find("recruiter from acme") == {"Acme": 0.9}
    assert find("the Target store " + "x" * 60 + " recruiter") == {} and find(None) == {}


def test_html_to_text():
    page = '<p>One<script>var t="</p>"</script> two<br>three &amp; <a href="https://x.example/a">text</a> <a class="mention" href="https://y.example">@you</a></p><style>p{}</style>'
    assert html.plain_text(page) == "One two\nthree & https://x.example/a @you"
    assert html.plain_text(None) == "" and html.plain_text("<<<") == "<<<"


def test_only_the_types_asked_for_are_looked_for(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/x d41d8cd98f00b204e9800998ecf8427e 9.9.9.9")], "id int, text string")
    found = indicators.observables(df, "id", types=["md5", "sha1", "sha256"])
    assert [tuple(r) for r in found.collect()] == [(1, "md5", "d41d8cd98f00b204e9800998ecf8427e")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "github" not in plan and "telegram" not in plan
