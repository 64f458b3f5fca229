"""Reports: leads, statistics, bundles and renderings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corrello.plans.clustering import at_least, order

LEAD_TYPES = "domain telegram github_repo github_user wallet_btc wallet_eth wallet_trx".split()


def leads(cases: DataFrame, edges: DataFrame, clustered: DataFrame, rdap: DataFrame, github: DataFrame, limit: int = 20) -> DataFrame:
    """Strong single-case signals outside clusters, one row per observable: new
    domains, handles, young repositories and accounts, wallets."""
    rows = edges.where(F.col("type").isin(LEAD_TYPES)).select("case_id", "type", "value").distinct()
    rows = rows.join(clustered.select("case_id"), "case_id", "left_anti").join(cases.select("case_id", "title", "url", "published_at"), "case_id")
    registered = rdap.select(F.lit("domain").alias("type"), "value", F.col("age_days").alias("_d"), "registrar", F.col("newly_registered").alias("_y"), F.lit(0).cast("long").alias("stars"))
    young = github.select("type", "value", F.col("age_days").alias("_d"), F.lit(None).cast("string").alias("registrar"), F.col("young").alias("_y"), "stars")
    rows = rows.join(registered.union(young), ["type", "value"], "left")
    days, fresh = F.col("_d").cast("string"), F.coalesce("_y", F.lit(False))
    why = (
        F.when((F.col("type") == "domain") & fresh, F.concat(F.lit("registered "), days, F.lit("d ago via "), F.coalesce("registrar", F.lit("?"))))
        .when(F.col("type") == "telegram", "Telegram contact handle")
        .when((F.col("type") == "github_repo") & fresh, F.concat(F.lit("repo "), days, F.lit("d old, "), F.col("stars").cast("string"), F.lit(" stars")))
        .when((F.col("type") == "github_user") & fresh, F.concat(F.lit("account "), days, F.lit("d old")))
        .when(F.col("type").startswith("wallet_"), "crypto wallet in a report")
    )
    once = W.partitionBy("type", "value").orderBy("published_at", "case_id")
    told = rows.withColumn("why", why).where("why is not null").withColumn("_n", F.row_number().over(once)).where("_n = 1")
    rank = F.when(F.col("type") == "domain", 0).when(F.col("type") == "telegram", 1).when(F.col("type") == "github_repo", 2).when(F.col("type") == "github_user", 3).otherwise(9)
    return told.select("type", "value", "why", "case_id", "title", "url", "published_at").orderBy(rank, "published_at", "type", "value").limit(limit)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def case_bundle(case_id: str, cases: DataFrame, edges: DataFrame, members: DataFrame, queries: DataFrame) -> dict:
    """One case with its observables, clusters and queries (bounded by the case)."""
    found = cases.where(F.col("case_id") == case_id).collect()
    if not found:
        raise KeyError(case_id)
    own = lambda df: [r.asDict(True) for r in df.where(F.col("case_id") == case_id).drop("case_id").collect()]
    return {"case": found[0].asDict(True), "observables": own(edges.orderBy("type", "value")), "clusters": own(members), "search_terms": own(queries)}


def cluster_bundle(cases: DataFrame, members: DataFrame, excerpt: int = 1500) -> DataFrame:
    """Members with excerpts, oldest first."""
    return members.join(cases, "case_id").select("component", "case_id", "source", "url", "title", "published_at", "lure_type", "stages", "lure_text", F.substring("body", 1, excerpt).alias("excerpt")).orderBy("component", "published_at", "case_id")


def evidence_text(summary: Row) -> str:
    """The evidence of one cluster as plain text for a reviewer or a model."""
    lines = [f"Cluster of {summary['size']} reports, {summary['confidence']} ({summary['confidence_basis']})"]
    lines += [f"- [{e['specificity']}] {e['feature']}: {e['value']} in {len(e['cases'])} cases (group {e['group']})" for e in summary["evidence"] or []]
    return "\n".join(lines + [f"* {r}" for r in summary["reasons"] or []])


# ---------------------------------------------------------------- rendering

# ---- Fixed values: what readers and scripts look for in a report.
HEADING, LEADS_HEADING = "CANDIDATE CLUSTER", "LEADS OUTSIDE CLUSTERS"
# ---- end of fixed values
#: Members of one cluster that a report lists on the driver unless told otherwise; the
#: rest is counted, and ``member_lines`` gives the lines of all as a table.
MOST_MEMBERS = 50


def _dead(value: str) -> str:
    return value.replace("http://", "hxxp://").replace("https://", "hxxps://").replace(".", "[.]")


@dataclass(frozen=True)
class Shown:
    """One cluster as a report shows it."""

    name: str
    summary: dict
    cases: list[dict]
    is_new: bool = True
    lineage: str = "unknown"
    note: str | None = None

    def items(self, field: str) -> list:
        return list(self.summary.get(field) or [])

    def tally(self, field: str) -> list[str]:
        return [f"{value}: {count}" for value, count in (self.summary.get(field) or {}).items()]


@dataclass(frozen=True)
class Section:
    """A titled part of a report.  ``rows`` gives its lines; a section without
    any is left out, or says ``empty``."""

    title: str
    rows: Callable[[Shown], list[str]]
    empty: str | None = None

    def lines(self, shown: Shown) -> list[str]:
        rows = self.rows(shown) or ([self.empty] if self.empty else [])
        return [self.title.upper(), *(f"  {row}" for row in rows), ""] if rows else []


def _evidence_rows(shown: Shown, most: int = 12, named: int = 4) -> list[str]:
    out = []
    for e in shown.items("evidence")[:most]:
        value = _dead(e["value"]) if e["feature"] in ("domain", "url") else e["value"]
        cases = [str(c) for c in e["cases"]]
        others = f" and {len(cases) - named} more" if len(cases) > named else ""
        out.append(f"{e['feature']} {value} ({e['specificity']}): {', '.join(cases[:named])}{others}")
    return out


def member_lines(cases: DataFrame, members: DataFrame) -> DataFrame:
    """``(component, published_at, case_id, line)``: what a report says of each member, for
    clusters of any size; written by the executors."""
    rows = members.join(cases.select("case_id", "published_at", "source", "title", "url"), "case_id")
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("no date"))
    told = F.concat_ws(" | ", F.col("case_id").cast("string"), day, F.col("source"), F.left(F.coalesce("title", F.lit("")), F.lit(70)))
    line = F.concat(told, F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("\n    "), "url")).otherwise(""))
    return rows.select("component", "published_at", "case_id", line.alias("line"))


def _case_rows(shown: Shown) -> list[str]:
    out = []
    for c in shown.cases:
        day = str(c["published_at"])[:10] if c["published_at"] else "no date"
        out += [f"{c['case_id']} | {day} | {c['source']} | {(c['title'] or '')[:70]}", *([f"    {c['url']}"] if c["url"] else [])]
    rest = shown.summary["size"] - len(shown.cases)
    return out + ([f"and {rest} more"] if shown.cases and rest > 0 else [])


def _infrastructure(shown: Shown) -> list[str]:
    return [_dead(x) for field in ("shared_domains", "shared_urls", "shared_ips") for x in shown.items(field)]


SECTIONS = (
    Section("Confidence", lambda c: [f"{c.summary['confidence']}: {c.summary['confidence_basis']}"]),
    Section("Assessment", lambda c: [f"same operational lineage: {c.lineage}", *([c.note] if c.note else [])]),
    Section("Reasons", lambda c: c.items("reasons"), "none recorded"),
    Section("Wording", lambda c: [f'"{c.summary["common_lure"]}"'] if c.summary.get("common_lure") else []),
    Section("Kinds of lure", lambda c: c.tally("lure_types")),
    Section("Brands", lambda c: c.items("brands")),
    Section("Infrastructure", _infrastructure, "none shared"),
    Section("Contacts", lambda c: [f"@{h}" for h in c.items("shared_telegram")] + c.items("shared_emails")),
    Section("Wallets", lambda c: c.items("shared_wallets")),
    Section("Dependencies", lambda c: c.items("shared_dependencies")),
    Section("New domains", lambda c: [_dead(d) for d in c.items("young_domains")]),
    Section("Repositories", lambda c: [f"github.com/{r}" for r in c.items("repos")]),
    Section("Evidence", _evidence_rows),
    Section("Next steps", lambda c: c.items("pivots")),
    Section("Sources", lambda c: c.tally("sources")),
    Section("Cases", _case_rows),
)


def cluster_text(shown: Shown, sections: Iterable[Section] = SECTIONS) -> str:
    """One cluster as plain text; addresses are made unclickable."""
    s = shown.summary
    since = str(s["first_seen"])[:10] if s.get("first_seen") else "an unknown day"
    head = [f"{'NEW ' if shown.is_new else ''}{HEADING} {shown.name}", f"{s['label']}; {s['size']} cases since {since}", ""]
    return "\n".join([*head, *(line for section in sections for line in section.lines(shown))]).rstrip()


def leads_text(rows: list[Row]) -> str:
    """Leads, one line and the case it comes from; only domains are unclickable."""
    if not rows:
        return ""
    out = [LEADS_HEADING]
    for r in rows:
        value = _dead(r["value"]) if r["type"] == "domain" else r["value"]
        day = str(r["published_at"])[:10] if r["published_at"] else "no date"
        out += [f"  {r['type']} {value}: {r['why']}", f"    {r['case_id']} | {day} | {(r['title'] or '')[:60]}"]
    return "\n".join(out)


def with_state(summaries: DataFrame, members: DataFrame, clusters: DataFrame, cluster_cases: DataFrame) -> DataFrame:
    """Summaries with cluster_id, is_new, lineage and note of the stored clusters.

    A component is the stored cluster it shares most cases with (ties: smaller id)."""
    same = members.join(cluster_cases, "case_id").groupBy("component", "cluster_id").agg(F.count(F.lit(1)).alias("k"))
    named = same.groupBy("component").agg(F.min(F.struct((-F.col("k")).alias("k"), "cluster_id")).alias("m")).select("component", F.col("m.cluster_id").alias("cluster_id"))
    known = clusters.select("cluster_id", "is_new", *[c for c in ("lineage", "note") if c in clusters.columns])
    return summaries.join(named.join(known, "cluster_id"), "component", "left")


def render(summaries: DataFrame, cases: DataFrame, members: DataFrame, lead_rows: DataFrame | None = None, fmt: str = "text", min_confidence: str = "possible", limit: int = 20, new_only: bool = False, most_members: int | None = MOST_MEMBERS) -> str:
    """The report of the first ``limit`` clusters; json leaves the leads out.

    Summaries that went through ``with_state`` are named by cluster id, others by
    component and count as new.  What comes to the driver is bounded: ``limit``
    summaries and ``most_members`` members of each (None: all of them, which are then as
    many as the largest clusters have; ``member_lines`` is the way for very large ones)."""
    rows = at_least(summaries, min_confidence)
    if new_only and "is_new" in rows.columns:
        rows = rows.where(F.coalesce("is_new", F.lit(True)))
    chosen = [r.asDict(True) for r in order(rows).limit(limit).collect()]
    if fmt == "json":
        return json.dumps(chosen, default=str, ensure_ascii=False, indent=1)
    own: dict = {}
    picked = cluster_bundle(cases, members.where(F.col("component").isin([r["component"] for r in chosen]))).drop("lure_text", "excerpt", "stages")
    place = F.row_number().over(W.partitionBy("component").orderBy("published_at", "case_id"))
    picked = picked.withColumn("_nth", place)
    for row in (picked if most_members is None else picked.where(F.col("_nth") <= most_members)).orderBy("component", "_nth").collect():
        own.setdefault(row["component"], []).append(row.asDict(True))
    blocks = []
    for r in chosen:
        new = r.get("is_new")
        shown = Shown(str(r.get("cluster_id") or r["component"]), r, own.get(r["component"], []), new if new is not None else True, r.get("lineage") or "unknown", r.get("note"))
        blocks.append(cluster_text(shown))
    tail = leads_text(lead_rows.collect()) if lead_rows is not None else ""
    blocks += [tail] if tail else []
    if fmt == "md":
        return "\n\n".join([f"# Clusters\n\n{len(chosen)} shown", *[f"```\n{b}\n```" for b in blocks]])
    return f"\n\n{'=' * 78}\n\n".join(blocks) or "No clusters."
