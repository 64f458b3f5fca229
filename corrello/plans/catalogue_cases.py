"""More registered queries: library operators of cases, clusters, lookups and
reports over whole tables, with columns of the driver's tables mapped to theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrello.functions import indicators, text
from corrello.operators import enrichment, graph, incremental, pivots, state
from corrello.operators import evidence as ev
from corrello.plans import clustering, report
from corrello.plans.catalogue import _EDGES, _HOST, _PAIRS, _edges, query
from corrello.store import fresh_path, keep, table

def _as_of():
    return F.lit("1998-09-01").cast("timestamp")


def _str(column: str):
    return F.col(column).cast("string")


# ---------------------------------------------------------------- reports

_KIND = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'domain' WHEN '2' THEN 'telegram' WHEN '3' THEN 'github_repo' WHEN '4' THEN 'github_user' ELSE 'wallet_btc' END"


def _kind():
    first = F.left("o_orderpriority", F.lit(1))
    out = F.lit("wallet_btc")
    for digit, kind in (("4", "github_user"), ("3", "github_repo"), ("2", "telegram"), ("1", "domain")):
        out = F.when(first == digit, kind).otherwise(out)
    return out


@query(
    "lead_rows",
    f"""WITH e AS (SELECT o_orderkey AS case_id, {_KIND} AS type, o_custkey, o_orderpriority AS title, o_orderdate AS published_at FROM orders
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
w AS (SELECT case_id, type, CAST(o_custkey AS VARCHAR) AS value, title, published_at,
  CASE WHEN type = 'domain' AND c_custkey % 200 <= 90 THEN 'registered ' || (c_custkey % 200) || 'd ago via ' || c_mktsegment
       WHEN type = 'telegram' THEN 'Telegram contact handle'
       WHEN type = 'github_repo' AND c_custkey % 150 <= 60 THEN 'repo ' || (c_custkey % 150) || 'd old, ' || c_nationkey || ' stars'
       WHEN type = 'github_user' AND c_custkey % 150 <= 60 THEN 'account ' || (c_custkey % 150) || 'd old'
       WHEN type = 'wallet_btc' THEN 'crypto wallet in a report' END AS why FROM e LEFT JOIN customer ON c_custkey = o_custkey),
o AS (SELECT *, row_number() OVER (PARTITION BY type, value ORDER BY published_at, case_id) AS n FROM w WHERE why IS NOT NULL)
SELECT type, value, why, case_id, title, published_at FROM o WHERE n = 1
ORDER BY CASE type WHEN 'domain' THEN 0 WHEN 'telegram' THEN 1 WHEN 'github_repo' THEN 2 WHEN 'github_user' THEN 3 ELSE 9 END, published_at, type, value LIMIT 20""",
)
def lead_rows(spark, sf_dir):
    """Orders as cases outside clusters, their customers as single-case signals."""
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("title"), F.lit("").alias("url"), F.col("o_orderdate").alias("published_at"))
    edges = orders.select(F.col("o_orderkey").alias("case_id"), _kind().alias("type"), _str("o_custkey").alias("value"))
    clustered = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    age = (F.col("c_custkey") % 200).cast("int")
    rdap = cust.select(_str("c_custkey").alias("value"), age.alias("age_days"), F.col("c_mktsegment").alias("registrar"), (age <= 90).alias("newly_registered"))
    days = (F.col("c_custkey") % 150).cast("int")
    kinds = F.explode(F.array(F.lit("github_repo"), F.lit("github_user"))).alias("type")
    github = cust.select(kinds, _str("c_custkey").alias("value"), days.alias("age_days"), (days <= 60).alias("young"), F.col("c_nationkey").cast("long").alias("stars"))
    return report.leads(cases, edges, clustered, rdap, github, 20).drop("url")


@query("counts_by_column", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents GROUP BY 1")
def counts_by_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return report.counts_by(docs, "lang").toDF("value", "n").union(report.counts_by(docs, "source").toDF("value", "n"))


@query(
    "report_order",
    """WITH s AS (SELECT o_custkey AS component, count(*) AS size, CASE WHEN max(o_totalprice) > 400000 THEN 'strongly_clustered' WHEN max(o_totalprice) > 300000 THEN 'probable' ELSE 'possible' END AS confidence FROM orders GROUP BY 1)
SELECT component, size, confidence FROM s WHERE confidence <> 'possible' ORDER BY CASE confidence WHEN 'strongly_clustered' THEN 0 ELSE 1 END, size DESC, component LIMIT 20""",
)
def report_order(spark, sf_dir):
    top = F.max("o_totalprice")
    level = F.when(top > 400000, "strongly_clustered").when(top > 300000, "probable").otherwise("possible")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.count(F.lit(1)).alias("size"), level.alias("confidence"))
    return clustering.order(clustering.at_least(found, "probable")).limit(20)


@query(
    "cluster_bundles",
    "SELECT quality AS component, doc_id AS case_id, source, lang AS lure_type, md5(left(text, 1500)) AS excerpt FROM documents JOIN labels USING (doc_id)",
)
def cluster_bundles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    cases = docs.select(
        F.col("doc_id").alias("case_id"), "source", none.alias("url"), none.alias("title"), none.cast("timestamp").alias("published_at"),
        F.col("lang").alias("lure_type"), none.alias("stages"), none.alias("lure_text"), F.col("text").alias("body"),
    )
    members = table(spark, sf_dir, "labels").select(F.col("quality").alias("component"), F.col("doc_id").alias("case_id"))
    rows = report.cluster_bundle(cases, members)
    return rows.select("component", "case_id", "source", "lure_type", F.md5("excerpt").alias("excerpt"))


# ---------------------------------------------------------------- lookups

_SEGMENT = {"AUTOMOBILE": "domain", "BUILDING": "ip", "FURNITURE": "url", "HOUSEHOLD": "sha256", "MACHINERY": "github_repo"}
_SEGMENT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENT.items()) + " END"
_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'dns' WHEN 'O' THEN 'rdap' ELSE 'abusech' END"


def _segment():
    out = F.lit(None).cast("string")
    for k, v in _SEGMENT.items():
        out = F.when(F.col("c_mktsegment") == k, v).otherwise(out)
    return out


@query(
    "lookup_queue",
    f"""WITH o AS (SELECT {_SEGMENT_SQL} AS type, CAST(c_custkey AS VARCHAR) AS value, o_orderdate, {_STATUS_SQL} AS provider FROM orders JOIN customer ON o_custkey = c_custkey),
ob AS (SELECT type, value, count(*) AS case_count, max(o_orderdate) AS last_seen FROM o GROUP BY 1, 2),
p(provider, type) AS (VALUES {", ".join(f"('{p}', '{t}')" for p, types in enrichment.PROVIDERS.items() for t in types)}),
fresh AS (SELECT provider, type, value FROM o GROUP BY 1, 2, 3 HAVING max(o_orderdate) >= TIMESTAMP '1997-09-01'),
d AS (SELECT provider, type, value, row_number() OVER (PARTITION BY provider ORDER BY case_count DESC, last_seen DESC, type, value) AS place FROM ob JOIN p USING (type) WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.provider = p.provider AND f.type = ob.type AND f.value = ob.value))
SELECT provider, type, value, CAST(place AS INTEGER) AS place FROM d WHERE place <= 15""",
)
def lookup_queue(spark, sf_dir):
    """Customers as observables, orders as the log of lookups."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(_segment().alias("type"), _str("c_custkey").alias("value"), "o_orderkey", "o_orderdate", "o_orderstatus")
    seen = rows.groupBy("type", "value").agg(F.count(F.lit(1)).alias("case_count"), F.max("o_orderdate").alias("last_seen"))
    provider = F.when(F.col("o_orderstatus") == "F", "dns").when(F.col("o_orderstatus") == "O", "rdap").otherwise("abusech")
    log = rows.select("type", "value", provider.alias("provider"), F.col("o_orderdate").alias("fetched_at"), F.lit(True).alias("ok"), F.lit("").alias("payload"))
    return enrichment.queue(seen, log, _as_of(), 365, 15)


def _lookups(spark, sf_dir):
    """A log of captured payloads: registration and name server facts of each
    customer as a domain, repository facts of each supplier."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("day"))
    cust = table(spark, sf_dir, "customer").join(first, "c_custkey")
    iso = F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    handle = F.struct(F.array(F.lit("registrar")).alias("roles"), F.col("c_mktsegment").alias("handle"))
    other = F.struct(F.array(F.lit("abuse")).alias("roles"), F.lit("nobody").alias("handle"))
    hosts = F.array(F.struct(F.upper(F.concat(F.lit("ns"), _str("c_nationkey"), F.lit(".example.org"))).alias("ldhName")))
    events = F.array(F.struct(F.lit("registration").alias("eventAction"), iso.alias("eventDate")))
    rdap = F.to_json(F.struct(events.alias("events"), F.array(other, handle).alias("entities"), F.array(F.lit("active")).alias("status"), hosts.alias("nameservers")))
    dns = F.to_json(F.struct(F.array(F.concat(F.lit("198.41.0."), _str("c_nationkey"))).alias("a"), F.array(F.concat(F.lit("ns"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.org"))).alias("ns"), F.lit(True).alias("resolves")))
    log = cust.select(F.lit("domain").alias("type"), _str("c_custkey").alias("value"), F.explode(F.array(F.struct(F.lit("rdap").alias("provider"), rdap.alias("payload")), F.struct(F.lit("dns").alias("provider"), dns.alias("payload")))).alias("x"))
    log = log.select("type", "value", "x.provider", F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit(True).alias("ok"), "x.payload")
    repo = F.struct(F.date_format(F.date_sub(F.lit("1998-09-01"), (F.col("s_suppkey") % 120).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("s_nationkey").cast("long").alias("stargazers_count"), F.struct(F.upper(F.concat(F.lit("own"), _str("s_nationkey"))).alias("login")).alias("owner"), F.array(F.lit("npm:react"), F.concat(F.lit("npm:pkg"), _str("s_nationkey"))).alias("dependencies"))
    repos = table(spark, sf_dir, "supplier").select(F.lit("github_repo").alias("type"), F.concat(F.lit("own/repo"), _str("s_suppkey")).alias("value"), F.lit("github").alias("provider"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit(True).alias("ok"), F.to_json(repo).alias("payload"))
    return log.union(repos)


_FIRST = "f AS (SELECT o_custkey, min(o_orderdate) AS day FROM orders GROUP BY 1), c AS (SELECT * FROM customer JOIN f ON o_custkey = c_custkey)"
_AGE = "CAST(floor((epoch(TIMESTAMP '1998-09-01') - epoch(date_trunc('second', day))) / 86400) AS INTEGER)"


@query(
    "rdap_facts",
    f"WITH {_FIRST} SELECT CAST(c_custkey AS VARCHAR) AS value, c_mktsegment AS registrar, {_AGE} AS age_days, {_AGE} <= 90 AS newly_registered, 'ns' || c_nationkey || '.example.org' AS nameservers, 'active' AS status FROM c",
)
def rdap_facts(spark, sf_dir):
    rows = enrichment.rdap_facts(_lookups(spark, sf_dir), _as_of())
    return rows.select("value", "registrar", "age_days", "newly_registered", F.array_join("nameservers", ",").alias("nameservers"), F.array_join("status", ",").alias("status"))


@query(
    "github_facts",
    "SELECT 'github_repo' AS type, 'own/repo' || s_suppkey AS value, 'own' || s_nationkey AS owner, CAST(s_suppkey % 120 AS INTEGER) AS age_days, s_suppkey % 120 <= 60 AS young, CAST(s_nationkey AS BIGINT) AS stars, 'npm:react,npm:pkg' || s_nationkey AS dependencies FROM supplier",
)
def github_facts(spark, sf_dir):
    return enrichment.github_facts(_lookups(spark, sf_dir), _as_of()).withColumn("dependencies", F.array_join("dependencies", ","))


def _lookup_edges(spark, sf_dir):
    """Each order names its customer as a domain, each line its supplier's repository."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("domain").alias("type"), _str("o_custkey").alias("value"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("github_repo").alias("type"), F.concat(F.lit("own/repo"), _str("l_suppkey")).alias("value"))
    return a.union(b)


@query(
    "derived_edges",
    """WITH o AS (SELECT o_orderkey AS case_id, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT l_orderkey AS case_id, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT DISTINCT case_id, 'ip' AS type, '198.41.0.' || c_nationkey AS value, 'links-to' AS role, 0.6::DOUBLE AS confidence FROM o
UNION ALL SELECT DISTINCT case_id, 'nameserver', 'ns' || (c_custkey % 7) || '.example.org', 'links-to', 0.4 FROM o
UNION ALL SELECT DISTINCT case_id, 'dependency', 'npm:pkg' || s_nationkey, 'links-to', 0.5 FROM r
UNION ALL SELECT DISTINCT case_id, 'github_user', 'own' || s_nationkey, 'delivers', 0.9 FROM r""",
)
def derived_edges(spark, sf_dir):
    return enrichment.derived(_lookup_edges(spark, sf_dir), _lookups(spark, sf_dir), _as_of())[0]


@query(
    "derived_relationships",
    f"""WITH {_FIRST}
SELECT 'domain' AS src_type, CAST(c_custkey AS VARCHAR) AS src_value, 'resolves-to' AS predicate, 'ip' AS dst_type, '198.41.0.' || c_nationkey AS dst_value FROM c
UNION ALL SELECT 'domain', CAST(c_custkey AS VARCHAR), 'uses-ns', 'nameserver', 'ns' || (c_custkey % 7) || '.example.org' FROM c
UNION ALL SELECT 'domain', CAST(c_custkey AS VARCHAR), 'registered-via', 'registrar', c_mktsegment FROM c
UNION ALL SELECT 'github_repo', 'own/repo' || s_suppkey, 'depends-on', 'dependency', 'npm:pkg' || s_nationkey FROM supplier
UNION ALL SELECT 'github_repo', 'own/repo' || s_suppkey, 'owned-by', 'github_user', 'own' || s_nationkey FROM supplier""",
)
def derived_relationships(spark, sf_dir):
    return enrichment.derived(_lookup_edges(spark, sf_dir), _lookups(spark, sf_dir), _as_of())[1]


@query(
    "manifest_dependencies",
    """SELECT o_orderkey, 'npm:axios,npm:lib' || (o_custkey % 5) || ',pypi:flask,pypi:tool' || (o_custkey % 3) AS dependencies, 'npm:lib' || (o_custkey % 5) || ',pypi:tool' || (o_custkey % 3) AS rare FROM orders""",
)
def manifest_dependencies(spark, sf_dir):
    npm = F.concat(F.lit('{"dependencies":{"axios":"1","lib'), (F.col("o_custkey") % 5).cast("string"), F.lit('":"^2"},"devDependencies":{"axios":"2"}}'))
    pip = F.concat(F.lit("# tools\nFlask>=2\n-r more.txt\nTool"), (F.col("o_custkey") % 3).cast("string"), F.lit("[x]==1.0\n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", enrichment.dependencies(npm, pip).alias("d"))
    return rows.select("o_orderkey", F.array_join("d", ",").alias("dependencies"), F.array_join(F.filter("d", lambda x: ~enrichment.is_common_dependency(x)), ",").alias("rare"))


# ---------------------------------------------------------------- follow-up queries


def _page_cases(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", indicators.host_of(F.col("url")).alias("host"))
    none = F.array().cast("array<string>")
    ident = _str("page_id")
    return pages.select(
        F.col("page_id").alias("case_id"), F.when(F.col("page_id") % 4 == 0, "rss").otherwise("reddit").alias("source_class"), none.alias("phrases"),
        F.array(F.concat(F.lit("desk"), ident)).alias("telegram"), F.array(F.concat(F.lit("0x"), ident)).alias("wallet_eth"), none.alias("wallet_btc"), none.alias("wallet_trx"),
        F.array(F.when(F.col("page_id") % 5 == 0, F.concat(F.col("host"), F.lit(".gov.au"))).otherwise(F.col("host"))).alias("domain"),
        F.array(F.concat(F.lit("hr@"), F.col("host"))).alias("email"), F.array(F.concat(F.lit("own"), ident)).alias("github_user"), F.array(F.concat(F.lit("Brand"), (F.col("page_id") % 10).cast("string"))).alias("brand"),
    )


_PAGE_QUERIES = f"""h AS (SELECT page_id AS case_id, {_HOST} AS host FROM pages),
q AS (SELECT case_id, host, unnest(list_concat(
  [{{'kind': 'reddit', 'term': '@desk' || case_id, 'priority': 1}}, {{'kind': 'web', 'term': '"@desk' || case_id || '"', 'priority': 1}}, {{'kind': 'web', 'term': '0x' || case_id, 'priority': 2}}],
  CASE WHEN case_id % 4 <> 0 AND case_id % 5 <> 0 THEN [{{'kind': 'reddit', 'term': host, 'priority': 3}}, {{'kind': 'github', 'term': '"' || host || '"', 'priority': 3}}, {{'kind': 'web', 'term': '"' || host || '"', 'priority': 3}}] ELSE [] END,
  CASE WHEN case_id % 4 <> 0 THEN [{{'kind': 'reddit', 'term': 'hr@' || host, 'priority': 2}}, {{'kind': 'web', 'term': '"hr@' || host || '"', 'priority': 2}},
    {{'kind': 'web', 'term': '"github.com/own' || case_id || '"', 'priority': 3}}, {{'kind': 'reddit', 'term': 'github.com/own' || case_id, 'priority': 3}},
    {{'kind': 'reddit', 'term': 'Brand' || (case_id % 10) || ' scam', 'priority': 4}}, {{'kind': 'web', 'term': '"Brand' || (case_id % 10) || '" scam', 'priority': 4}}] ELSE [] END)) AS x FROM h)"""


@query("case_query_rows", f"WITH {_PAGE_QUERIES} SELECT case_id, x.kind AS kind, x.term AS term, CAST(x.priority AS INTEGER) AS priority FROM q")
def case_query_rows(spark, sf_dir):
    return pivots.case_queries(_page_cases(spark, sf_dir), {}).drop("place")


@query(
    "stored_queries",
    f"WITH {_PAGE_QUERIES} SELECT x.term AS term, x.kind AS kind, min(case_id) AS origin_case, CAST(any_value(x.priority) AS INTEGER) AS priority, CASE WHEN x.kind IN ('reddit', 'github') THEN 'pending' ELSE 'manual' END AS status FROM q WHERE x.term <> 'Brand3 scam' GROUP BY x.term, x.kind",
)
def stored_queries(spark, sf_dir):
    """The first case to ask wins; what is stored already is not asked again."""
    known = spark.createDataFrame([("Brand3 scam", "reddit")], "term string, kind string")
    return pivots.store_queries(pivots.case_queries(_page_cases(spark, sf_dir), {}), known, _as_of()).drop("created_at")


def _search_terms(spark, sf_dir):
    status = F.when(F.col("c_nationkey") % 4 == 0, "manual").when(F.col("c_nationkey") % 4 == 1, "done").when(F.col("c_nationkey") % 4 == 2, "failed").otherwise("pending")
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("term"), F.lit("reddit").alias("kind"), status.alias("status"), (F.col("c_nationkey") % 5).alias("priority"),
        (F.col("c_custkey") % 4).cast("int").alias("generation"), F.timestamp_seconds(F.col("c_custkey") % 97).alias("created_at"),
    )


_TERMS = """t AS (SELECT c_name AS term, 'reddit' AS kind, CASE c_nationkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, c_nationkey % 5 AS priority, CAST(c_custkey % 4 AS INTEGER) AS generation, c_custkey % 97 AS made FROM customer)"""


@query("run_queue", f"WITH {_TERMS} SELECT term, status, priority, generation FROM t WHERE status = 'pending' AND generation <= 2 ORDER BY priority, generation, made, term LIMIT 10")
def run_queue(spark, sf_dir):
    return pivots.run_queue(_search_terms(spark, sf_dir)).select("term", "status", "priority", "generation")


@query("query_listing", f"WITH {_TERMS} SELECT term, status, priority FROM t ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'manual' THEN 1 WHEN 'done' THEN 2 ELSE 3 END, priority, made, term LIMIT 50")
def query_listing(spark, sf_dir):
    return pivots.listing(_search_terms(spark, sf_dir)).limit(50).select("term", "status", "priority")


# ---------------------------------------------------------------- graph and evidence


@query(
    "merged_pairs",
    f"""WITH {_EDGES}, p AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, CAST(o_custkey % 10 AS DOUBLE) / 10 AS sim FROM orders)
SELECT a, b, coalesce(n, 0) AS n_evidence, coalesce(sim, 0.0) AS sim FROM p FULL JOIN s USING (a, b)""",
)
def merged_pairs(spark, sf_dir):
    """Shared-observable pairs and similarities of neighbours, merged."""
    sim = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), ((F.col("o_custkey") % 10).cast("double") / 10).alias("sim"))
    both = graph.similar_or_shared_pairs(_edges(spark, sf_dir), 25, similar=sim)
    return both.select("a", "b", F.size("evidence").cast("long").alias("n_evidence"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


@query(
    "case_graph",
    f"""WITH {_EDGES}, p AS (SELECT a, b, count(*) AS n, bool_or(type = 'domain') AS hard, count(DISTINCT type) AS kinds FROM x GROUP BY 1, 2),
s AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, CAST(o_custkey % 10 AS DOUBLE) / 10 AS sim FROM orders)
SELECT a, b, coalesce(n, 0) AS n_evidence, coalesce(sim, 0.0) AS sim FROM p FULL JOIN s USING (a, b) WHERE coalesce(hard, false) OR coalesce(sim, 0) > 0 OR coalesce(kinds, 0) >= 2""",
)
def case_graph(spark, sf_dir):
    sim = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), ((F.col("o_custkey") % 10).cast("double") / 10).alias("sim"))
    found = graph.case_graph(_edges(spark, sf_dir), sim, 1, absolute=25, fraction=0.0)
    return found.select("a", "b", F.size("evidence").cast("long").alias("n_evidence"), "sim")


@query(
    "clusters_of_size",
    "WITH g AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS low, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) SELECT c_custkey AS case_id, low AS component FROM g WHERE n >= 12",
)
def clusters_of_size(spark, sf_dir):
    """Classes below the least size are no clusters."""
    cust = table(spark, sf_dir, "customer")
    first = cust.groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_custkey").alias("b"))
    links = cust.join(first, ["c_nationkey", "c_mktsegment"]).select(F.col("c_custkey").alias("a"), "b")
    return graph.clusters(links, 12)


@query(
    "parent_domains",
    """SELECT 'ip' AS type, CAST(l_partkey AS VARCHAR) AS value, min(CAST(l_suppkey AS VARCHAR)) AS parent FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 2
UNION ALL SELECT 'url', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders""",
)
def parent_domains(spark, sf_dir):
    return ev.parent_domains(_relationships(spark, sf_dir))


def _relationships(spark, sf_dir):
    predicate = F.when(F.col("l_returnflag") == "R", "resolves-to").when(F.col("l_returnflag") == "A", "uses-ns").otherwise("mentions")
    lines = table(spark, sf_dir, "lineitem").select(F.lit("domain").alias("src_type"), _str("l_suppkey").alias("src_value"), predicate.alias("predicate"), F.lit("ip").alias("dst_type"), _str("l_partkey").alias("dst_value"))
    urls = table(spark, sf_dir, "orders").select(F.lit("url").alias("src_type"), _str("o_orderkey").alias("src_value"), F.lit("hosted-on").alias("predicate"), F.lit("domain").alias("dst_type"), _str("o_custkey").alias("dst_value"))
    return lines.union(urls)


def _clustered(spark, sf_dir):
    """Customers as clusters of their orders; suppliers as observables of the
    orders' lines, of a type by the line's flag."""
    orders = table(spark, sf_dir, "orders")
    members = orders.select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("case_id"))
    cases = orders.select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("src:"), F.col("o_orderpriority")).alias("source"), F.col("o_orderstatus").alias("author"), F.col("o_orderdate").alias("published_at"),
        F.when(F.col("o_orderstatus") != "P", F.lower("o_orderstatus")).alias("lure_type"), F.array(F.concat(F.lit("line "), F.left("o_orderpriority", F.lit(1)))).alias("lure_text"),
    )
    flag = F.when(F.col("l_returnflag") == "R", "domain").when(F.col("l_returnflag") == "A", "ip").otherwise("telegram")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), flag.alias("type"), _str("l_suppkey").alias("value"))
    parents = ev.parent_domains(table(spark, sf_dir, "supplier").select(F.lit("domain").alias("src_type"), _str("s_suppkey").alias("src_value"), F.lit("resolves-to").alias("predicate"), F.lit("ip").alias("dst_type"), _str("s_suppkey").alias("dst_value")))
    none = spark.createDataFrame([], "a long, b long, evidence array<struct<type:string,value:string,weight:double>>, sim double")
    hubs = keep(graph.hubs(edges, 1_000_000), "hubs")
    return members, cases, edges, none, parents, hubs


_SHARED = """e AS (SELECT DISTINCT l_orderkey AS case_id, CASE l_returnflag WHEN 'R' THEN 'domain' WHEN 'A' THEN 'ip' ELSE 'telegram' END AS type, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem),
m AS (SELECT o_custkey AS component, type, value, count(*) AS k FROM e JOIN orders ON o_orderkey = case_id GROUP BY 1, 2, 3)"""
_LEVEL = "CASE type WHEN 'telegram' THEN 'high' WHEN 'domain' THEN 'medium' ELSE 'low' END"


@query("cluster_evidence", f"WITH {_SHARED} SELECT component, type AS feature, value, {_LEVEL} AS specificity, CAST(k AS INTEGER) AS n_cases, value AS grp FROM m WHERE k >= 2")
def cluster_evidence(spark, sf_dir):
    members, _, edges, none, parents, hubs = _clustered(spark, sf_dir)
    found = ev.cluster_evidence(members, edges, none, parents, hubs)
    return found.select("component", "feature", "value", "specificity", F.size("cases").alias("n_cases"), "grp")


def _top_sql(kind: str, most: int) -> str:
    return f"(SELECT string_agg(value, ',' ORDER BY k DESC, value) FROM (SELECT * FROM m2 WHERE m2.component = b.component AND type = '{kind}' AND place <= {most}))"


@query(
    "cluster_summaries",
    f"""WITH {_SHARED}, m2 AS (SELECT *, row_number() OVER (PARTITION BY component, type ORDER BY k DESC, value) AS place FROM m WHERE k >= 2),
b AS (SELECT o_custkey AS component, count(*) AS size, min(o_orderdate) AS first_seen, count(*) > 1 AND count(DISTINCT o_orderstatus) = 1 AS single_reporter FROM orders GROUP BY 1),
g AS (SELECT component, value AS grp, max(CASE type WHEN 'telegram' THEN 3 WHEN 'domain' THEN 2 ELSE 1 END) AS r FROM m WHERE k >= 2 GROUP BY 1, 2),
n AS (SELECT component, count(*) FILTER (r = 3) AS high, count(*) FILTER (r = 2) AS medium, count(*) FILTER (r = 1) AS low FROM g GROUP BY 1),
c AS (SELECT *, CASE WHEN high >= 2 OR (high >= 1 AND medium >= 2) THEN 'strongly_clustered' WHEN high >= 1 OR medium >= 2 THEN 'probable' ELSE 'possible' END AS level, high || ' independent high-specificity, ' || medium || ' medium, ' || low || ' low' AS told FROM n),
y AS (SELECT component, value, k, row_number() OVER (PARTITION BY component ORDER BY k DESC, value) AS place FROM m JOIN supplier ON s_suppkey = CAST(value AS BIGINT) WHERE type = 'domain' AND s_nationkey < 5),
l AS (SELECT o_custkey AS component, lower(o_orderstatus) AS v, count(*) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
w AS (SELECT o_custkey AS component, 'line ' || left(o_orderpriority, 1) AS v, count(*) AS k FROM orders GROUP BY 1, 2)
SELECT b.component, CAST(size AS BIGINT) AS size, first_seen, single_reporter, coalesce({_top_sql("domain", 6)}, '') AS shared_domains, coalesce({_top_sql("telegram", 4)}, '') AS shared_telegram, coalesce({_top_sql("ip", 4)}, '') AS shared_ips,
coalesce((SELECT string_agg(value, ',' ORDER BY place) FROM y WHERE y.component = b.component AND place <= 6), '') AS young_domains,
coalesce((SELECT string_agg(v || '=' || k, ',' ORDER BY k DESC, v) FROM l WHERE l.component = b.component), '') AS lure_types, 'src=' || size AS sources,
(SELECT first(v ORDER BY k DESC, v) FROM w WHERE w.component = b.component) AS common_lure,
CASE WHEN single_reporter AND level <> 'possible' THEN 'possible' ELSE level END AS confidence, CASE WHEN single_reporter AND level <> 'possible' THEN told || '; capped: single reporter' ELSE told END AS confidence_basis
FROM b LEFT JOIN c USING (component)""",
)
def cluster_summaries(spark, sf_dir):
    """Counts, lists, ladder and reporter cap of all clusters."""
    members, cases, edges, none, parents, hubs = _clustered(spark, sf_dir)
    evidence = keep(ev.cluster_evidence(members, edges, none, parents, hubs), "evidence")
    young = table(spark, sf_dir, "supplier").select(_str("s_suppkey").alias("value"), (F.col("s_nationkey") < 5).alias("newly_registered"))
    s = ev.summaries(members, cases, edges, none, evidence, hubs, young)
    counted = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","), F.lit(""))
    lists = ["shared_domains", "shared_telegram", "shared_ips", "young_domains"]
    return s.select(
        "component", "size", "first_seen", "single_reporter", *[F.array_join(c, ",").alias(c) for c in lists], counted("lure_types").alias("lure_types"), counted("sources").alias("sources"),
        "common_lure", "confidence", "confidence_basis",
    )


# ---------------------------------------------------------------- state


@query(
    "acknowledged",
    "SELECT 'CLU-' || c_custkey AS cluster_id, CASE WHEN 'CLU-' || c_custkey = 'CLU-7' AND s IN ('new', 'seen') THEN 'investigating' WHEN is_new AND s = 'new' THEN 'seen' ELSE s END AS status, false AS is_new FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' ELSE 'closed' END AS s, c_nationkey % 2 = 0 AS is_new FROM customer)",
)
def acknowledged(spark, sf_dir):
    """A report acknowledged, then one cluster assessed."""
    status = F.when(F.col("c_nationkey") % 3 == 0, "new").when(F.col("c_nationkey") % 3 == 1, "seen").otherwise("closed")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("CLU-"), _str("c_custkey")).alias("cluster_id"), status.alias("status"), (F.col("c_nationkey") % 2 == 0).alias("is_new"))
    return state.assess(state.mark_seen(rows), "CLU-7", "same").select("cluster_id", "status", "is_new")


# ---------------------------------------------------------------- text

_CRAFTED = """p AS (SELECT page_id AS i, url FROM pages)"""


def _crafted(spark, sf_dir):
    """Every page's address in a sentence with one indicator of each kind."""
    i = _str("page_id")
    text_of = F.concat(
        F.lit("see "), F.col("url"), F.lit(" code github.com/Owner"), i, F.lit("/Tool-"), i, F.lit(" chat t.me/Desk"), i, F.lit(" telegram @Agent_"), i,
        F.lit(" pay 0x"), F.sha1(i), F.lit(" or T"), F.left(F.translate(F.sha2(i, 256), "0", "z"), F.lit(33)), F.lit(" or 1"), F.left(F.translate(F.sha2(F.concat(F.lit("b"), i), 256), "0", "z"), F.lit(33)),
        F.lit(" file "), F.md5(i), F.lit(" "), F.sha2(F.concat(F.lit("f"), i), 256), F.lit(" mail HR@corp"), i, F.lit(".studio shop"), i, F.lit(".solutions, note.py 8.8."), (F.col("page_id") % 256).cast("string"), F.lit(".1 10.0.0.1"),
    )
    return table(spark, sf_dir, "pages").select("page_id", text_of.alias("text"))


@query(
    "page_indicators",
    f"""WITH {_CRAFTED}
SELECT i AS page_id, 'url' AS type, regexp_replace(url, '[.,;:!?''"]+$', '') AS value FROM p UNION ALL SELECT i, 'domain', {_HOST} FROM p UNION ALL SELECT i, 'domain', 'shop' || i || '.solutions' FROM p
UNION ALL SELECT i, 'email', 'hr@corp' || i || '.studio' FROM p UNION ALL SELECT i, 'ip', '8.8.' || (i % 256) || '.1' FROM p
UNION ALL SELECT i, 'telegram', 'desk' || i FROM p UNION ALL SELECT i, 'telegram', 'agent_' || i FROM p
UNION ALL SELECT i, 'github_repo', 'owner' || i || '/tool-' || i FROM p UNION ALL SELECT i, 'github_user', 'owner' || i FROM p
UNION ALL SELECT i, 'wallet_eth', '0x' || sha1(CAST(i AS VARCHAR)) FROM p UNION ALL SELECT i, 'wallet_trx', 'T' || left(replace(sha256(CAST(i AS VARCHAR)), '0', 'z'), 33) FROM p
UNION ALL SELECT i, 'wallet_btc', '1' || left(replace(sha256('b' || i), '0', 'z'), 33) FROM p
UNION ALL SELECT i, 'md5', md5(CAST(i AS VARCHAR)) FROM p UNION ALL SELECT i, 'sha256', sha256('f' || i) FROM p""",
)
def page_indicators(spark, sf_dir):
    return indicators.observables(_crafted(spark, sf_dir), "page_id")


_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(
    "text_forms",
    rf"""WITH d AS (SELECT doc_id, source, text, instr(lower(text), 'tion') AS hit FROM documents)
SELECT doc_id, md5(regexp_replace(source || chr(10) || chr(10) || text, '^\s+|\s+$', '', 'g')) AS case_text, source AS source_class,
md5(CASE WHEN length(text) > 300 THEN left(text, 300) || chr(10) || '…[truncated]' ELSE text END) AS cut,
CASE WHEN hit > 0 THEN {_SQUEEZE.format("substring(text, greatest(hit - 80, 1), hit - greatest(hit - 80, 1) + 84)")} END AS around, md5({_SQUEEZE.format("lower(text)")}) AS title_key FROM d""",
)
def text_forms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = F.col("text")
    return docs.select(
        "doc_id", F.md5(text.case_text(F.col("source"), t)).alias("case_text"), text.source_class(F.concat("source", F.lit(":"), "lang")).alias("source_class"),
        F.md5(text.truncate(t, 300)).alias("cut"), text.snippet(t, F.lit("tion")).alias("around"), F.md5(text.title_key(t)).alias("title_key"),
    )


@query(
    "parsed_times",
    "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS iso, event_id AS digits, CAST(NULL AS BIGINT) AS other FROM events",
)
def parsed_times(spark, sf_dir):
    """ISO text, epoch seconds and other text to times."""
    ev_rows = table(spark, sf_dir, "events")
    made = lambda c: F.unix_timestamp(text.timestamp(c))
    return ev_rows.select("event_id", made(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), made(_str("event_id")).alias("digits"), made(F.col("event_type")).alias("other"))


@query(
    "refang_documents",
    r"""SELECT doc_id, md5(replace(replace(replace(replace(text, 'http', 'hxxp'), '.', '[.]') || ' hr[at]corp(.)io a dot b', 'hxxp', 'http'), '[.]', '.').replace('hr[at]corp(.)io a dot b', 'hr@corp.io a.b')) AS live,
md5(replace(replace(replace(text, 'http://', 'hxxp://'), 'https://', 'hxxps://'), '.', '[.]')) AS safe FROM documents""",
)
def refang_documents(spark, sf_dir):
    """Whole texts made unclickable, with a tail, and brought back."""
    dead = F.concat(F.replace(F.replace("text", F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]")), F.lit(" hr[at]corp(.)io a dot b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.refang(dead)).alias("live"), F.md5(text.defang(F.col("text"))).alias("safe"))


@query(
    "dns_facts",
    f"WITH {_FIRST} SELECT CAST(c_custkey AS VARCHAR) AS value, '198.41.0.' || c_nationkey AS a, 'ns' || (c_custkey % 7) || '.example.org' AS ns, true AS resolves, 'mx1.example.org,mx' || (c_custkey % 3 + 2) || '.example.org' AS mail FROM c",
)
def dns_facts(spark, sf_dir):
    """Captured name server answers, and the hosts of mail records."""
    rows = enrichment.dns_records(_lookups(spark, sf_dir))
    records = F.array(F.concat(F.lit("20 MX"), (F.col("value").cast("long") % 3 + 2).cast("string"), F.lit(".example.org.")), F.lit("10 mx1.example.org."))
    return rows.select("value", F.array_join("a", ",").alias("a"), F.array_join("ns", ",").alias("ns"), "resolves", F.array_join(enrichment.mail_hosts(records), ",").alias("mail"))


@query(
    "cluster_identity",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS case_id, format('CLU-{:04d}', o_custkey) AS cluster_id, o_custkey % 3 AS kind,
  CAST((o_custkey + CASE WHEN month(o_orderdate) <= 3 THEN 2 ELSE 0 END) // 2 AS VARCHAR) AS component FROM orders),
old AS (SELECT cluster_id, min(kind) AS kind, count(*) AS cluster_size FROM o GROUP BY 1), new AS (SELECT component, count(*) AS size FROM o GROUP BY 1),
f AS (SELECT component, list({'c': cluster_id, 's': shared, 'n': cluster_size} ORDER BY shared DESC, cluster_id) AS offers
  FROM (SELECT component, cluster_id, count(*) AS shared FROM o GROUP BY 1, 2) JOIN old USING (cluster_id) GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS place FROM new JOIN f USING (component)),
r AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS cluster_id
  UNION ALL SELECT place, CASE WHEN hit THEN list_append(taken, best.c) ELSE taken END, component, CASE WHEN hit THEN best.c END
  FROM (SELECT *, coalesce(b.best.s >= greatest(1, b.best.n // 2), false) AS hit
    FROM (SELECT k.place, r.taken, k.component, list_filter(k.offers, lambda x: NOT list_contains(r.taken, x.c))[1] AS best FROM r JOIN k ON k.place = r.place + 1) b)),
g AS (SELECT r.component, r.cluster_id, k.size, k.place FROM r JOIN k USING (place)),
h AS (SELECT component, size, coalesce(cluster_id, format('CLU-{:04d}', (SELECT max(CAST(split_part(cluster_id, '-', 2) AS BIGINT)) FROM old) + row_number() OVER (PARTITION BY cluster_id IS NULL ORDER BY place))) AS cluster_id FROM g),
same AS (SELECT o.cluster_id, o.component, count(*) AS shared FROM o GROUP BY 1, 2)
SELECT cluster_id, CASE WHEN h.size IS NULL THEN 'closed' WHEN old.kind IS NULL OR old.kind = 2 THEN 'new' WHEN old.kind = 1 THEN 'seen' ELSE 'new' END AS status,
  h.size IS NOT NULL AND coalesce(NOT (same.shared = h.size AND h.size = old.cluster_size), true) AS is_new, CAST(coalesce(h.size, old.cluster_size) AS INTEGER) AS size
FROM old FULL JOIN h USING (cluster_id) LEFT JOIN same USING (cluster_id, component)""",
)
def cluster_identity(spark, sf_dir):
    """Customers' orders as the clusters of yesterday, pairs of customers as today's."""
    orders = table(spark, sf_dir, "orders")
    moved = F.when(F.month("o_orderdate") <= 3, 2).otherwise(0)
    cluster = F.format_string("CLU-%04d", "o_custkey").alias("cluster_id")
    members = orders.select(F.col("o_orderkey").alias("case_id"), F.floor((F.col("o_custkey") + moved) / 2).alias("component"))
    old = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("size"))
    status = F.when(F.col("o_custkey") % 3 == 0, "new").when(F.col("o_custkey") % 3 == 1, "seen").otherwise("closed")
    old = old.select(cluster, status.alias("status"), F.lit(False).alias("is_new"), _as_of().alias("created_at"), _as_of().alias("updated_at"), "size")
    found, _ = state.persist_identity(members, orders.select(F.col("o_orderkey").alias("case_id"), cluster), old, _as_of())
    return found.select("cluster_id", "status", "is_new", "size")


def _in_batches(rows, key, times=3):
    """All rows in batches by an id: most of them, then two small ones."""
    part = F.col(key) % 20
    return [rows.where(part < 18), rows.where(part == 18), rows.where((part == 19) | (part == 0))][:times]


@query(
    "incremental_observables",
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'domain' ELSE 'ip' END AS type, CAST(l_partkey AS VARCHAR) AS value, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(DISTINCT l_orderkey) AS case_count "
    "FROM lineitem GROUP BY 1, 2",
)
def incremental_observables(spark, sf_dir):
    """Sightings kept up over batches, one of which brings known edges again."""
    flag = F.when(F.col("l_returnflag") == "R", "domain").otherwise("ip")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), flag.alias("type"), _str("l_partkey").alias("value"), F.col("l_shipdate").cast("timestamp").alias("seen_at"))
    tables = incremental.EdgeTables(spark, fresh_path(spark, "inc-tables"), 32, "bigint")
    for batch in _in_batches(edges, "case_id"):
        tables.apply(batch)
    return tables.observables()


@query(
    "incremental_classes",
    """WITH RECURSIVE s AS (SELECT o_orderkey AS a, min(o_orderkey) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS b, min(o_orderkey) OVER (PARTITION BY o_custkey % 400, year(o_orderdate)) AS c FROM orders),
n AS (SELECT a, b FROM s UNION SELECT b, a FROM s UNION SELECT a, c FROM s UNION SELECT c, a FROM s),
r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM n
  UNION (SELECT DISTINCT ON (u.node) u.node, v.root FROM recurring.r u JOIN n ON n.a = u.node JOIN r v ON v.node = n.b WHERE v.root < u.root ORDER BY u.node, v.root))
SELECT node, root AS component FROM r""",
)
def incremental_classes(spark, sf_dir):
    """Components kept up over batches of links: orders of one customer and day, and of
    a group of customers and year."""
    orders = table(spark, sf_dir, "orders")
    day = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.min("o_orderkey").alias("b"))
    year = orders.groupBy((F.col("o_custkey") % 400).alias("g"), F.year("o_orderdate").alias("y")).agg(F.min("o_orderkey").alias("b"))
    own = orders.select(F.col("o_orderkey").alias("a"), "o_custkey", F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 400).alias("g"), F.year("o_orderdate").alias("y"))
    links = keep(own.join(day, ["o_custkey", "d"]).select("a", "b").union(own.join(year, ["g", "y"]).select("a", "b")), "inc-orders")
    classes = incremental.Classes(spark, fresh_path(spark, "inc-classes"), 32, "bigint")
    for batch in _in_batches(links, "a"):
        classes.link(batch)
    return classes.components()


@query(
    "clusters_end_to_end",
    f"""WITH RECURSIVE {_PAIRS},
raw AS (SELECT DISTINCT doc_id AS c, CASE l_linenumber WHEN 1 THEN 'domain' WHEN 2 THEN 'email' WHEN 3 THEN 'ip' ELSE 'nameserver' END AS type,
  CAST(l_partkey % CASE l_linenumber WHEN 1 THEN 900 WHEN 2 THEN 1200 WHEN 3 THEN 300 ELSE 200 END AS VARCHAR) AS value FROM documents JOIN lineitem ON l_orderkey = doc_id),
fit AS (SELECT type, value FROM raw GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 6), hub AS (SELECT type, value FROM raw GROUP BY 1, 2 HAVING count(*) > 6),
sh AS (SELECT a.c AS a, b.c AS b, list_distinct(list(type)) AS kinds FROM raw a JOIN raw b USING (type, value) JOIN fit USING (type, value) WHERE a.c < b.c GROUP BY 1, 2),
gr AS (SELECT a, b, coalesce(kinds, []) AS kinds, coalesce(round(j, 3), 0) AS sim FROM sh FULL JOIN p USING (a, b)),
held AS (SELECT *, list_has_any(kinds, ['domain', 'email']) AS hard, list_has_any(kinds, ['ip', 'nameserver']) AS weak FROM gr WHERE sim > 0 OR list_has_any(kinds, ['domain', 'email']) OR list_has_all(kinds, ['ip', 'nameserver'])),
n2 AS (SELECT a, b FROM held UNION SELECT b, a FROM held),
r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM n2
  UNION (SELECT DISTINCT ON (u.node) u.node, v.root FROM recurring.r u JOIN n2 ON n2.a = u.node JOIN r v ON v.node = n2.b WHERE v.root < u.root ORDER BY u.node, v.root)),
m AS (SELECT node AS c, root AS component FROM r),
cnt AS (SELECT component, count_if(hard) AS hard_pairs, count_if(sim > 0) AS sim_pairs, count_if(weak) AS weak_pairs, max(sim) AS top FROM held JOIN m ON m.c = held.a GROUP BY 1),
ev AS (SELECT component, CASE type WHEN 'email' THEN 3 WHEN 'domain' THEN 2 ELSE 1 END AS r, CASE type WHEN 'ip' THEN 'site' || CAST(value AS INTEGER) % 50 ELSE value END AS grp
  FROM raw JOIN m USING (c) WHERE (type, value) NOT IN (SELECT (type, value) FROM hub) GROUP BY component, type, value HAVING count(*) >= 2
  UNION ALL SELECT component, 2, 'wording' FROM cnt WHERE sim_pairs > 0),
best AS (SELECT component, grp, max(r) AS r FROM ev GROUP BY 1, 2),
lad AS (SELECT component, count_if(r = 3) AS high, count_if(r = 2) AS medium, count_if(r = 1) AS low FROM best GROUP BY 1),
sz AS (SELECT component, count(*) AS size, count(DISTINCT source) = 1 AND count(*) > 1 AS single FROM m JOIN documents ON doc_id = c GROUP BY 1),
z AS (SELECT *, CASE WHEN high >= 2 OR (high >= 1 AND medium >= 2) THEN 'strongly_clustered' WHEN high >= 1 OR medium >= 2 THEN 'probable' ELSE 'possible' END AS lvl FROM lad)
SELECT component, size, CASE WHEN single THEN 'possible' ELSE lvl END AS confidence,
  high || ' independent high-specificity, ' || medium || ' medium, ' || low || ' low' || CASE WHEN single AND lvl <> 'possible' THEN '; capped: single reporter' ELSE '' END AS confidence_basis,
  hard_pairs, sim_pairs, weak_pairs, CASE WHEN sim_pairs > 0 THEN sim_pairs || ' similar pair(s), max jaccard ' || printf('%.2f', top + 0.0001) END AS wording, (SELECT count(*) FROM ev WHERE ev.component = z.component) AS n_evidence
FROM z JOIN sz USING (component) JOIN cnt USING (component)""",
)
def clusters_end_to_end(spark, sf_dir):
    """Documents as cases, the lines of the order with their number as what they refer
    to: hubs, wording, parents and groups counted by classes all take part."""
    docs, lines = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lineitem")
    cases = docs.select(F.col("doc_id").alias("case_id"), "source", F.col("source").alias("author"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("lure_type"), F.array("text").alias("lure_text"))
    by_line = [("domain", 900), ("email", 1200), ("ip", 300), ("nameserver", 200)]
    which = F.least("l_linenumber", F.lit(4)).cast("int")
    kind, top = (F.element_at(F.lit([x[i] for x in by_line]), which) for i in (0, 1))
    edges = lines.join(docs.select("doc_id"), F.col("l_orderkey") == F.col("doc_id")).select(F.col("doc_id").alias("case_id"), kind.alias("type"), (F.col("l_partkey") % top).cast("string").alias("value"))
    hosts = edges.where("type = 'ip'").select("value").distinct()
    relations = hosts.select(F.lit("domain").alias("src_type"), F.concat(F.lit("site"), F.col("value").cast("int") % 50).alias("src_value"), F.lit("resolves-to").alias("predicate"), F.lit("ip").alias("dst_type"), F.col("value").alias("dst_value"))
    config = {"text_similarity_threshold": 0.3, "hub_absolute": 6, "hub_fraction": 0.0}
    got = clustering.build_clusters(cases, edges, relations, config=config, dense=2)
    worded = F.try_element_at(F.filter("evidence", lambda e: e["feature"] == "wording_similarity"), F.lit(1))["value"]
    counts = [F.col(f"edge_counts.{c}").alias(c) for c in ("hard_pairs", "sim_pairs", "weak_pairs")]
    return got.summaries.select("component", "size", "confidence", "confidence_basis", *counts, worded.alias("wording"), F.size("evidence").cast("long").alias("n_evidence"))
