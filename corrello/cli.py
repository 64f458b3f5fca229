"""Thin verbs over the plans: ``python -m corrello.cli VERB --home DIR ...``.

Tables live as Parquet below the home folder, which may be in any store that
Spark reads: ``raw`` (items), ``runs`` (what each collection brought),
``lookups`` (captured answers of providers) and ``searches`` (follow-up queries
that were run) only grow; ``state`` holds one folder per version of the clusters,
of which the newest complete one counts.  ``derived`` holds what was made of the
items, one folder per profile and batch: a verb makes cases of the items that are
pending, those no batch has, and reads the rest; a changed profile starts anew, and
reprocess does so with the same one.  A batch without its list of items, which is
written last, does not count and is written again.
"""

from __future__ import annotations

import argparse
import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corrello.operators import enrichment, fulltext, pivots, state
from corrello.plans.cases import CaseTables, build_cases, with_notes
from corrello.plans.clustering import build_clusters
from corrello.plans.report import case_bundle, counts_by, leads, member_lines, render, with_state
from corrello.sources import readers
from corrello.store import children, exists, keep, remove, touch
from corrello.streaming.cycle import take_in

_CLUSTERS = "cluster_id string, status string, is_new boolean, created_at timestamp, updated_at timestamp, size int, lineage string, note string"
_MEMBERS = "cluster_id string, case_id string"
#: Tables that only grow.
LOGS = {
    "raw": readers.RAW_ITEM,
    "runs": "name string, run_at timestamp, status string, items long",
    "lookups": "type string, value string, provider string, fetched_at timestamp, ok boolean, payload string",
    "searches": "term string, kind string, generation int, status string, hits long, error string, run_at timestamp",
}
#: What is made of a batch of items.
DERIVED = ("cases", "repeats", "edges", "relationships", "queries", "anchors")
#: Follow-up queries lead to items of the next generation, up to this one.
MOST_GENERATIONS = 2


class Home:
    """The tables of one investigation."""

    def __init__(self, spark: SparkSession, folder: str, profile: str | None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        if profile and not Path(profile).exists():
            raise SystemExit(f"no profile {profile}")
        self.profile = readers.profile(profile) if profile else {}

    def log(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(LOGS[name]).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LOGS[name])

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def start(self) -> None:
        """Empty tables where there are none."""
        for name, schema in LOGS.items():
            if not exists(self.spark, f"{self.folder}/{name}"):
                self.append(name, self.spark.createDataFrame([], schema))

    def _derived(self) -> str:
        told = json.dumps(self.profile, sort_keys=True, default=str)
        return f"{self.folder}/derived/{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def process(self) -> int:
        """Make cases of the pending items, as one more batch; returns how many these were."""
        path = self._derived()
        batch = len(children(self.spark, f"{path}/items"))
        done = self.spark.read.schema("id string, batch int").parquet(f"{path}/items") if batch else None
        pending = self.log("raw") if done is None else self.log("raw").join(done.select("id"), "id", "left_anti")
        pending = keep(pending, "pending")
        if pending.isEmpty() and batch:
            return 0
        before = self._read("anchors", batch) if batch else None
        made = build_cases(pending, self.profile, float(self.profile.get("threshold", 0.5)), anchors=before)
        for name in DERIVED:
            rows = getattr(made, name)
            (rows.drop("notes") if name == "cases" else rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        pending.select("id").write.mode("overwrite").parquet(f"{path}/items/batch={batch}")
        return pending.count()

    def _read(self, name: str, batches: int) -> DataFrame:
        path = f"{self._derived()}/{name}"
        schema = self.spark.read.parquet(f"{path}/batch=0").schema  # an empty batch has files too
        return self.spark.read.schema(schema.add("batch", IntegerType())).parquet(path).where(F.col("batch") < batches).drop("batch")

    def reprocess(self) -> int:
        """Make the cases of all items again."""
        remove(self.spark, self._derived())
        return self.process()

    def built(self, now: Column) -> CaseTables:
        """Cases of all items, with the edges that captured lookups add."""
        self.process()
        count = len(children(self.spark, f"{self._derived()}/items"))
        tables = {name: self._read(name, count) for name in DERIVED}
        tables["cases"] = with_notes(tables["cases"], tables["repeats"])
        tables["relationships"] = tables["relationships"].distinct()
        found = CaseTables(**tables)
        more, facts = enrichment.derived(found.edges, self.log("lookups"), now, bool(self.profile.get("link_registrar")))
        edges = found.edges.unionByName(more.withColumn("context", F.lit(None).cast("string")))
        return CaseTables(found.cases, found.repeats, keep(edges, "cli-edges"), found.relationships.union(facts).distinct(), found.queries)

    def clustered(self, built: CaseTables, now: Column):
        return build_clusters(built.cases, built.edges, built.relationships, enrichment.rdap_facts(self.log("lookups"), now), self.profile.get("clustering"), self.profile.get("labels"))

    def leads(self, built: CaseTables, members: DataFrame, now: Column, limit: int) -> DataFrame:
        log = self.log("lookups")
        return leads(built.cases, built.edges, members, enrichment.rdap_facts(log, now), enrichment.github_facts(log, now), limit)

    def terms(self, built: CaseTables, now: Column) -> DataFrame:
        """Follow-up queries with the outcome of their latest run, if any."""
        stored = pivots.store_queries(built.queries, None, now).join(built.cases.select(F.col("case_id").alias("origin_case"), "generation"), "origin_case")
        last = state.latest(self.log("searches").select("term", "kind", "run_at", F.col("status").alias("_s"), "hits", "error"), ["term", "kind"], "run_at")
        return stored.join(last, ["term", "kind"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")

    def _versions(self) -> list[str]:
        return [v for v in children(self.spark, f"{self.folder}/state") if exists(self.spark, f"{self.folder}/state/{v}/done")]

    def state(self) -> tuple[DataFrame, DataFrame]:
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], _CLUSTERS), self.spark.createDataFrame([], _MEMBERS)
        path = f"{self.folder}/state/{found[-1]}"
        return self.spark.read.schema(_CLUSTERS).parquet(f"{path}/clusters"), self.spark.read.schema(_MEMBERS).parquet(f"{path}/members")

    def save(self, clusters: DataFrame, members: DataFrame) -> None:
        path = f"{self.folder}/state/{len(self._versions()) + 1:06d}"
        clusters.write.mode("overwrite").parquet(f"{path}/clusters")
        members.write.mode("overwrite").parquet(f"{path}/members")
        touch(self.spark, f"{path}/done")  # a version without this mark is not read


def _collect(home: Home, config: dict, now: Column) -> int:
    """Take in every configured source and record how each went."""
    total = 0
    for name in [n for n in readers.REGISTRY if config.get(n)]:
        try:
            count, status = take_in(home.spark, readers.collect(home.spark, config, now, [name]), f"{home.folder}/raw"), "ok"
        except Exception as e:  # one source that cannot be read leaves the others alone
            count, status = 0, f"error: {type(e).__name__}"
        total += count
        home.append("runs", home.spark.createDataFrame([(name, status, count)], "name string, status string, items long").select("name", now.alias("run_at"), "status", "items"))
    return total


def _run_pivots(home: Home, captures: dict, now: Column, limit: int) -> list[str]:
    """Run pending queries: ``captures`` maps a term to the sources that hold what
    it found.  Hits come back as items one generation later."""
    due = pivots.run_queue(home.terms(home.built(now), now), limit, MOST_GENERATIONS - 1).collect()
    out = []
    for row in due:
        if row["term"] not in captures:
            continue
        try:
            found = readers.collect(home.spark, captures[row["term"]], now, generation=row["generation"] + 1)
            hits, status, error = take_in(home.spark, found, f"{home.folder}/raw"), "done", None
        except Exception as e:
            hits, status, error = 0, "error", str(e)[:200]
        done = home.spark.createDataFrame([(row["term"], row["kind"], row["generation"], status, hits, error)], "term string, kind string, generation int, status string, hits long, error string")
        home.append("searches", done.withColumn("run_at", now))
        out.append(f"{status} {hits:>4} {row['kind']:<7} {row['term']}")
    return out


def _cluster(home: Home, built: CaseTables, now: Column):
    got = home.clustered(built, now)
    new, own = state.persist_identity(got.members, home.state()[1], home.state()[0], now)
    home.save(new, own)
    return got


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corrello")
    p.add_argument("--home", required=True)
    p.add_argument("--profile")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("init", "stats", "cluster", "reprocess", "sources"):
        sub.add_parser(verb)
    sub.add_parser("profiles").add_argument("folder")
    for verb in ("collect", "run"):
        sub.add_parser(verb).add_argument("config", help="JSON file: source name to path and options")
    text = sub.add_parser("add-text")
    text.add_argument("text")
    text.add_argument("--title")
    page = sub.add_parser("add-url", help="a page that was captured to a file")
    page.add_argument("url")
    page.add_argument("html")
    page.add_argument("--note")
    sub.add_parser("enrich", help="JSON lines of captured answers, or nothing: what to look up next").add_argument("answers", nargs="?")
    ran = sub.add_parser("pivot", help="JSON file: query to the sources that hold what it found")
    ran.add_argument("captures")
    ran.add_argument("--limit", type=int, default=10)
    shown = sub.add_parser("report")
    shown.add_argument("--format", default="text", choices=["text", "md", "json"])
    shown.add_argument("--min-confidence", default="possible")
    shown.add_argument("--limit", type=int, default=20)
    shown.add_argument("--new", action="store_true")
    shown.add_argument("--out")
    shown.add_argument("--members", default="50", help="members listed of a cluster, or all; with all and --out they go to a folder beside it")
    shown.add_argument("--ack", action="store_true")
    sub.add_parser("leads").add_argument("--limit", type=int, default=20)
    sub.add_parser("pivots").add_argument("--limit", type=int, default=50)
    sub.add_parser("case").add_argument("case_id")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    judge = sub.add_parser("assess")
    judge.add_argument("cluster_id")
    judge.add_argument("lineage", choices=["same", "different", "unknown"])
    judge.add_argument("--note")
    return p


def main(argv: list[str] | None = None) -> str:
    args = _parser().parse_args(argv)
    if args.verb == "profiles":
        return "\n".join(sorted(p.stem for p in Path(args.folder).glob("*.y*ml")))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    home, now = Home(spark, args.home, args.profile), F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
    raw = f"{home.folder}/raw"
    if args.verb == "init":
        home.start()
        return home.folder
    if args.verb == "collect":
        return f"{_collect(home, json.loads(Path(args.config).read_text()), now)} new items"
    if args.verb == "add-text":
        row = spark.createDataFrame([(args.text, args.title, None, None, None)], "text string, title string, url string, author string, published_at string")
        return f"{take_in(spark, readers.raw_items(readers.pasted(row), now), raw)} new items"
    if args.verb == "add-url":
        row = spark.createDataFrame([(args.url, Path(args.html).read_text(encoding="utf-8", errors="replace"))], "url string, html string")
        return f"{take_in(spark, readers.raw_items(readers.web_pages(row, args.note), now), raw)} new items"
    if args.verb == "sources":
        return "\n".join(f"{r['name']:<10} {r['last_run']:%Y-%m-%d %H:%M} {r['last_status']} {r['items_total']}" for r in state.source_runs(home.log("runs")).orderBy("name").collect())
    if args.verb == "assess":
        clusters, members = home.state()
        home.save(state.assess(clusters, args.cluster_id, args.lineage, args.note), members)
        return f"{args.cluster_id}: {args.lineage}"
    if args.verb == "enrich" and args.answers:
        rows = keep(spark.read.schema(LOGS["lookups"]).json(args.answers), "cli-answers")
        home.append("lookups", rows.withColumn("fetched_at", F.coalesce("fetched_at", now)))
        return f"{rows.count()} answers"
    if args.verb == "pivot":
        return "\n".join(_run_pivots(home, json.loads(Path(args.captures).read_text()), now, args.limit))
    if args.verb == "run":
        _collect(home, json.loads(Path(args.config).read_text()), now)
    if args.verb == "reprocess":
        home.reprocess()
    built = home.built(now)
    if args.verb in ("stats", "reprocess"):
        by = {c: [tuple(r) for r in counts_by(df, c).collect()] for df, c in ((home.log("raw"), "source"), (built.edges, "type"))}
        return json.dumps(by | {"items": home.log("raw").count(), "cases": built.cases.count(), "repeats": built.repeats.count()})
    if args.verb == "search":
        index = fulltext.build(built.cases.withColumn("lure", F.array_join("lure_text", "\n")), "case_id", ["title", "body", "lure"])
        found = fulltext.search(index, args.query, args.limit, "body")
        return "\n".join(f"{r['id']}  {r['score']:.3f}  {r['snippet']}" for r in found.collect())
    if args.verb == "pivots":
        return "\n".join(f"{r['priority']} {r['status']:<7} {r['kind']:<7} {r['term']}  ({r['origin_case']})" for r in pivots.listing(home.terms(built, now)).limit(args.limit).collect())
    if args.verb == "enrich":
        seen = built.edges.join(built.cases.select("case_id", F.coalesce("published_at", "fetched_at").alias("seen_at")), "case_id")
        due = enrichment.queue(state.observable_table(seen), home.log("lookups"), now)
        return "\n".join(f"{r['provider']:<9} {r['type']:<11} {r['value']}" for r in due.orderBy("provider", "place").collect())
    if args.verb in ("cluster", "run"):
        got = _cluster(home, built, now)
    else:
        got = home.clustered(built, now)
    if args.verb == "cluster":
        return "\n".join(f"{r['cluster_id']} {r['status']} {r['size']}" for r in home.state()[0].orderBy("cluster_id").collect())
    if args.verb == "case":
        return json.dumps(case_bundle(args.case_id, built.cases, built.edges, got.members, built.queries), default=str, ensure_ascii=False)
    lead = home.leads(built, got.members, now, getattr(args, "limit", 20))
    if args.verb == "leads":
        return "\n".join(f"{r['type']:<12} {r['value']}  {r['why']}" for r in lead.collect())
    clusters, members = home.state()
    summaries = with_state(got.summaries, got.members, clusters, members)
    if args.verb == "run":
        return render(summaries, built.cases, got.members, lead, new_only=True)
    aside = args.members == "all" and args.out
    most = None if args.members == "all" and not args.out else 50 if aside else int(args.members)
    out = render(summaries, built.cases, got.members, lead, args.format, args.min_confidence, args.limit, args.new, most)
    if aside:
        lines = member_lines(built.cases, got.members).sort("component", "published_at", "case_id")
        lines.select("component", "line").write.mode("overwrite").partitionBy("component").text(f"{args.out}.members")
    if args.out:
        Path(args.out).write_text(out, encoding="utf-8")
    if args.ack:
        home.save(state.mark_seen(clusters), members)
    return out


if __name__ == "__main__":
    print(main())
