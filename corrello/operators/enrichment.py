"""Enrichment: what needs a lookup, payload parsers, and derived edges.

Lookups themselves happen outside Spark; payloads arrive as JSON text in a log
``(type, value, provider, fetched_at, ok, payload)``, of which the latest per
(type, value, provider) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corrello.functions.text import age_days, timestamp
from corrello.operators.state import latest
from corrello.store import parts_for

# ---- Fixed values.
PROVIDERS = {
    "dns": ["domain"], "rdap": ["domain"], "abusech": ["domain", "url", "ip", "sha256", "md5"],
    "github": ["github_repo", "github_user"], "intelowl": ["domain", "url", "ip", "sha256"],
}
COMMON_DEPENDENCIES = (
    "react react-dom express axios lodash typescript next vite webpack eslint prettier jest dotenv cors mongoose body-parser "
    "nodemon vue tailwindcss postcss autoprefixer @types/node @types/react @types/react-dom react-router-dom redux "
    "@reduxjs/toolkit styled-components sass moment uuid requests numpy pandas flask django pytest fastapi uvicorn pydantic "
    "sqlalchemy python-dotenv beautifulsoup4 matplotlib scikit-learn torch"
).split()
NEW_DOMAIN_DAYS, YOUNG_ACCOUNT_DAYS, YOUNG_REPO_DAYS = 90, 90, 60
# ---- end of fixed values
DNS = "struct<a:array<string>,aaaa:array<string>,ns:array<string>,mx:array<string>,cname:array<string>,resolves:boolean>"
RDAP = (
    "struct<events:array<struct<eventAction:string,eventDate:string>>,entities:array<struct<roles:array<string>,handle:string,vcardArray:string>>,"
    "status:array<string>,nameservers:array<struct<ldhName:string>>>"
)
REPO = "struct<full_name:string,description:string,created_at:string,pushed_at:string,stargazers_count:bigint,owner:struct<login:string>,dependencies:array<string>>"
USER = "struct<login:string,type:string,created_at:string,public_repos:bigint,followers:bigint>"
ABUSE = "struct<urlhaus:array<struct<url:string,threat:string,tags:array<string>>>,threatfox:array<struct<ioc:string,malware:string,confidence:int>>>"


def queue(observables: DataFrame, log: DataFrame, as_of: Column, ttl_days: int = 7, limit: int = 150) -> DataFrame:
    """``(provider, type, value)`` to look up: never fetched or fetched longer
    than the TTL ago; per provider the ``limit`` in most cases, then last seen."""
    pairs = observables.sparkSession.createDataFrame([(p, t) for p, types in PROVIDERS.items() for t in types], "provider string, type string")
    fresh = latest(log, ["type", "value", "provider"], "fetched_at").where(F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {ttl_days} DAYS"))
    due = observables.join(F.broadcast(pairs), "type").join(fresh.select("type", "value", "provider"), ["type", "value", "provider"], "left_anti")
    order = W.partitionBy("provider").orderBy(F.desc("case_count"), F.desc("last_seen"), "type", "value")
    return due.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("provider", "type", "value", "place")


def results(log: DataFrame, provider: str) -> DataFrame:
    rows = latest(log, ["type", "value", "provider"], "fetched_at")
    return rows.where((F.col("provider") == provider) & F.col("ok"))


def dns_records(log: DataFrame) -> DataFrame:
    return results(log, "dns").select("type", "value", F.from_json("payload", DNS).alias("r")).select("type", "value", "r.*")


def mail_hosts(records: Column) -> Column:
    """Hosts of MX records such as "10 mx.example.org.", sorted."""
    return F.array_sort(F.transform(records, lambda r: F.rtrim(F.lower(F.substring_index(r, " ", -1)), F.lit("."))))


def rdap_facts(log: DataFrame, as_of: Column) -> DataFrame:
    """Registration facts; age and newness are computed at ``as_of``."""
    rows = results(log, "rdap").select("value", F.from_json("payload", RDAP).alias("r"))
    event = lambda name: F.get(F.transform(F.filter("r.events", lambda e: e["eventAction"] == name), lambda e: e["eventDate"]), F.lit(0))
    holder = F.get(F.filter("r.entities", lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))
    named = F.regexp_extract(holder["vcardArray"], r'"fn"\s*,\s*\{[^}]*\}\s*,\s*"text"\s*,\s*"([^"]*)"', 1)
    created = timestamp(event("registration"))
    age = age_days(created, as_of)
    return rows.select(
        "value",
        F.coalesce(F.nullif(named, F.lit("")), holder["handle"]).alias("registrar"),
        created.alias("created"),
        timestamp(event("expiration")).alias("expires"),
        age.alias("age_days"),
        F.coalesce(age <= NEW_DOMAIN_DAYS, F.lit(False)).alias("newly_registered"),
        "r.status",
        F.array_sort(F.transform("r.nameservers", lambda n: F.lower(F.coalesce(n["ldhName"], F.lit(""))))).alias("nameservers"),
    )


def github_facts(log: DataFrame, as_of: Column) -> DataFrame:
    """``(type, value, owner, dependencies, age_days, young, stars)``."""
    rows = results(log, "github").select("type", "value", F.from_json("payload", REPO).alias("r"))
    age = age_days(timestamp(F.col("r.created_at")), as_of)
    limit = F.when(F.col("type") == "github_repo", YOUNG_REPO_DAYS).otherwise(YOUNG_ACCOUNT_DAYS)
    return rows.select("type", "value", F.lower("r.owner.login").alias("owner"), "r.dependencies", age.alias("age_days"), F.coalesce(age <= limit, F.lit(False)).alias("young"), F.coalesce("r.stargazers_count", F.lit(0)).alias("stars"))


def dependencies(package_json: Column, requirements: Column) -> Column:
    """``npm:`` and ``pypi:`` names of the two manifests, sorted and distinct."""
    typed = F.from_json(package_json, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    none = F.array().cast("array<string>")
    npm = F.concat(*[F.coalesce(F.map_keys(typed[k]), none) for k in ("dependencies", "devDependencies")])
    lines = F.filter(F.transform(F.split(F.coalesce(requirements, F.lit("")), r"\R"), F.trim), lambda x: ~x.rlike(r"^(#|-|$)"))
    pypi = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^[^=<>!~\[; ]*", 0)))
    return F.array_sort(F.array_distinct(F.concat(F.transform(npm, lambda x: F.concat(F.lit("npm:"), x)), F.transform(pypi, lambda x: F.concat(F.lit("pypi:"), x)))))


def is_common_dependency(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "^(npm|pypi):", "")).isin(COMMON_DEPENDENCIES)


def derived(edges: DataFrame, log: DataFrame, as_of: Column, link_registrar: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges ``(case_id, type, value, role, confidence)`` and relationships
    ``(src_type, src_value, predicate, dst_type, dst_value)`` that lookups add to
    the cases of the looked-up observable."""
    # what a case has twice adds nothing: what the lookups add is told apart below
    own = edges.select("case_id", F.col("type").alias("src_type"), F.col("value").alias("src_value"))
    dns, rdap, github = dns_records(log), rdap_facts(log, as_of), github_facts(log, as_of)
    row = lambda df, predicate, kind, values, role, conf: df.select(
        F.col("type").alias("src_type"), F.col("value").alias("src_value"), F.lit(predicate).alias("predicate"), F.lit(kind).alias("dst_type"), F.explode(values).alias("dst_value"), F.lit(role).alias("role"), F.lit(conf).alias("confidence"),
    )
    repos = github.where("type = 'github_repo'")
    parts = [
        row(dns, "resolves-to", "ip", F.slice("a", 1, 5), "links-to", 0.6),
        row(dns, "uses-ns", "nameserver", F.slice("ns", 1, 4), "links-to", 0.4),
        row(repos, "depends-on", "dependency", F.filter("dependencies", lambda d: ~is_common_dependency(d)), "links-to", 0.5),
        row(repos, "owned-by", "github_user", F.array_compact(F.array("owner")), "delivers", 0.9),
    ]
    registrars = row(rdap.withColumn("type", F.lit("domain")), "registered-via", "registrar", F.array_compact(F.array("registrar")), "links-to", 0.3)
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.union(part)
    linked = facts.union(registrars) if link_registrar else facts
    new = linked.join(own, ["src_type", "src_value"]).select("case_id", F.col("dst_type").alias("type"), F.col("dst_value").alias("value"), "role", "confidence")
    new = new.repartition(parts_for(own), "case_id").groupBy("case_id", "type", "value", "role").agg(F.max("confidence").alias("confidence"))
    every = facts.union(registrars)
    malware = results(log, "abusech").select("type", "value", F.explode(F.slice(F.from_json("payload", ABUSE)["threatfox"], 1, 10)).alias("t"))
    family = malware.where("t.malware is not null").select(F.col("type").alias("src_type"), F.col("value").alias("src_value"), F.lit("associated-with").alias("predicate"), F.lit("malware_family").alias("dst_type"), F.col("t.malware").alias("dst_value"))
    return new, every.select("src_type", "src_value", "predicate", "dst_type", "dst_value").union(family).distinct()
