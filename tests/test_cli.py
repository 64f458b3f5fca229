"""The verbs on a small home folder."""

import json
from datetime import UTC, datetime, timedelta

from corrello import cli


def test_verbs(spark, tmp_path):
    profile = tmp_path / "profile.yaml"
    profile.write_text("topic_terms: {job: 1.0, recruiter: 1.5}\nharm_terms: {scam: 1.5}\nlure_keywords: [wallet, test]\n")
    run = lambda *args: cli.main(["--home", str(tmp_path / "home"), "--profile", str(profile), *args])
    assert run("add-text", "a recruiter job scam, telegram @hr_jane drained my wallet") == "1 new items"
    assert run("add-text", "a recruiter job scam, telegram @hr_jane drained my wallet") == "0 new items"
    assert run("add-text", "another job scam by a recruiter on telegram @hr_jane") == "1 new items"
    assert json.loads(run("stats"))["cases"] == 2
    assert "[wallet]" in run("search", "wallet")
    assert run("cluster") == "CLU-0001 new 2"
    assert run("assess", "CLU-0001", "same") and "@hr_jane" in run("pivots")


def test_cycle_with_lookups_and_follow_ups(spark, tmp_path):
    profile = tmp_path / "profile.yaml"
    profile.write_text("topic_terms: {job: 1.0, recruiter: 1.5}\nharm_terms: {scam: 1.5}\nlure_keywords: [wallet, test]\n")
    run = lambda *args: cli.main(["--home", str(tmp_path / "home"), "--profile", str(profile), *args])
    toot = lambda name, text: {"uri": name, "url": f"https://m.example/{name}", "created_at": "2024-01-02T00:00:00Z", "content": text, "account": {"acct": "x" + name}}
    for name, rows in (("seed", [toot("a", "<p>a recruiter job scam at https://hotel-tasks.top/start</p>")]), ("hits", [toot("b", "<p>same recruiter job scam, they use https://hotel-tasks.top/other too</p>")])):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    config, captures = tmp_path / "config.json", tmp_path / "captures.json"
    config.write_text(json.dumps({"mastodon": {"path": str(tmp_path / "seed.json")}, "urlhaus": {"path": str(tmp_path / "missing.csv")}}))
    captures.write_text(json.dumps({"hotel-tasks.top": {"mastodon": {"path": str(tmp_path / "hits.json")}}}))
    assert run("init") and run("profiles", str(tmp_path)) == "profile"
    assert run("collect", str(config)) == "1 new items"
    runs = run("sources")
    assert "mastodon" in runs and "ok 1" in runs and "urlhaus" in runs and "error" in runs
    assert "domain      hotel-tasks.top" in run("enrich")
    rdap = {"events": [{"eventAction": "registration", "eventDate": (datetime.now(UTC) - timedelta(days=5)).strftime("%Y-%m-%dT%H:%M:%SZ")}], "entities": [{"roles": ["registrar"], "handle": "REG"}]}
    answers = tmp_path / "answers.jsonl"
    answers.write_text(json.dumps({"type": "domain", "value": "hotel-tasks.top", "provider": "rdap", "ok": True, "payload": json.dumps(rdap)}))
    assert run("enrich", str(answers)) == "1 answers" and "registered 5d ago via REG" in run("leads")
    assert "done    1 reddit  hotel-tasks.top" in run("pivot", str(captures)) and "done    reddit  hotel-tasks.top" in run("pivots")
    assert cli.Home(spark, str(tmp_path / "home"), None).log("raw").where("generation = 1").count() == 1
    assert run("cluster") == "CLU-0001 new 2"
    assert run("assess", "CLU-0001", "same", "--note", "one crew") and run("cluster") == "CLU-0001 investigating 2"
    shown = run("report", "--new", "--out", str(tmp_path / "report.txt"), "--ack")
    assert shown.startswith("NEW CANDIDATE CLUSTER CLU-0001") and "one crew" in shown and "hotel-tasks[.]top" in shown and (tmp_path / "report.txt").read_text() == shown
    assert "CLU-0001" not in run("report", "--new")
    page = tmp_path / "p.html"
    page.write_text("<h1>Title</h1><p>a recruiter job scam</p>")
    assert run("add-url", "https://x.example/", str(page)) == "1 new items"


def test_only_pending_items_are_processed(spark, tmp_path):
    profile = tmp_path / "profile.yaml"
    profile.write_text("topic_terms: {job: 1.0, recruiter: 1.5}\nharm_terms: {scam: 1.5}\nlure_keywords: [wallet, test]\n")
    home = cli.Home(spark, str(tmp_path / "home"), str(profile))
    toot = lambda name, day, text: {"uri": name, "url": f"https://m.example/{name}", "created_at": f"2024-01-{day:02d}T00:00:00Z", "content": f"<p>{text}</p>", "account": {"acct": "jane"}}
    text = "a recruiter job scam at https://hotel-tasks.top/start " + "that says the same words over and over again " * 6
    batches = [[toot("a", 2, text), toot("b", 3, "a recruiter job scam of another kind")], [toot("c", 5, text), toot("d", 20, text), toot("e", 6, "the weather")], []]
    sizes = []
    for n, rows in enumerate(batches):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows))
        (tmp_path / "config.json").write_text(json.dumps({"mastodon": {"path": str(tmp_path / f"{n}.json")}}))
        cli.main(["--home", str(tmp_path / "home"), "--profile", str(profile), "collect", str(tmp_path / "config.json")])
        sizes.append(home.process())
    assert sizes == [2, 3, 0]
    now = cli.F.lit(datetime(2024, 2, 1)).cast("timestamp")
    built = home.built(now)
    whole = cli.build_cases(home.log("raw"), home.profile, 0.5)
    rows = lambda df: sorted(str(r.asDict(True)) for r in df.select(sorted(df.columns)).collect())
    for name in ("cases", "repeats", "relationships", "queries"):
        assert rows(getattr(built, name)) == rows(getattr(whole, name)), name
    assert rows(home._read("anchors", 3)) == rows(whole.anchors)
    assert rows(built.edges) == rows(whole.edges)
    assert built.cases.count() == 3 and built.repeats.count() == 1 and "Also posted" in built.cases.where("notes is not null").first()["notes"]
    # a batch that was stopped before its list of items was written does not count
    (tmp_path / "3.json").write_text(json.dumps(toot("f", 25, "one more recruiter job scam")))
    (tmp_path / "config.json").write_text(json.dumps({"mastodon": {"path": str(tmp_path / "3.json")}}))
    cli.main(["--home", str(tmp_path / "home"), "--profile", str(profile), "collect", str(tmp_path / "config.json")])
    whole.cases.drop("notes").write.parquet(f"{home._derived()}/cases/batch=2")
    assert home._read("cases", 2).count() == 3 and home.process() == 1 and home.built(now).cases.count() == 4
    assert home.reprocess() == 6 and home.built(now).cases.count() == 4
    profile.write_text("topic_terms: {weather: 3.0}\nharm_terms: {weather: 1.5}\n")
    other = cli.Home(spark, str(tmp_path / "home"), str(profile))
    assert other._derived() != home._derived() and other.built(now).cases.count() == 1
