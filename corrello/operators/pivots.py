"""Follow-up queries of a case, their store, and the run queue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrello.functions.text import STOPWORDS, let, words
from corrello.operators.state import first_wins

# ---- Fixed values.
ARTICLE_SOURCES = ["rss", "github"]
NO_PIVOT = r"\.(gov|gov\.au|gov\.uk|edu|mil|int)$"
PRIORITY = {"telegram": 1, "phrase": 2, "email": 2, "wallet": 2, "domain": 3, "github_user": 3, "brand": 4}
# ---- end of fixed values


def windows(phrase: Column, keywords: Iterable[str], generic: Iterable[str] = (), shortest: int = 4, longest: int = 7, most: int = 3) -> Column:
    """Word windows worth searching: no stop word at an end, a lure keyword, at
    least three content words, not generic.  Of the longest length that gives any,
    the first three."""
    kws, dull = [k.lower() for k in keywords], [g.lower() for g in generic]
    stop = lambda x: x.isin(STOPWORDS)

    def of_length(w: Column, n: int) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n))
        good = F.filter(
            cuts,
            lambda c: (F.size(c) == n) & ~stop(F.element_at(c, 1)) & ~stop(F.element_at(c, -1)) & F.exists(c, lambda t: t.isin(kws)) & (F.size(F.filter(c, lambda t: ~stop(t))) >= 3),
        )
        return F.filter(F.transform(good, lambda c: F.array_join(c, " ")), lambda s: ~s.isin(dull) if dull else F.lit(True))

    def found(w: Column) -> Column:
        by_length = F.filter(F.array(*[of_length(w, n) for n in range(longest, shortest - 1, -1)]), lambda x: F.size(x) > 0)
        return F.slice(F.coalesce(F.get(by_length, F.lit(0)), F.array().cast("array<string>")), 1, most)

    return let(words(phrase), found)


def _filled(template: str, field: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{" + field + "}"), value)


def case_queries(cases: DataFrame, profile: dict) -> DataFrame:
    """``(case_id, place, kind, term, priority)``: what to search for each case.

    cases: case_id, source_class, phrases array, and one array per observable
    type (telegram, wallet_*, domain, email, github_user, brand).  Articles cite,
    so only their wording, handles and wallets are searched."""
    templates = profile.get("pivot_templates") or {}
    found = F.array_distinct(F.flatten(F.transform(F.slice("phrases", 1, 3), lambda p: windows(p, profile.get("lure_keywords") or [], profile.get("generic_phrases") or []))))
    article = F.col("source_class").isin(ARTICLE_SOURCES)

    def each(values: Column, most: int, made: list[tuple[str, str, str]], priority: int, leads: bool = True) -> Column:
        values = F.slice(values, 1, most)
        some = values if leads else F.when(article, F.array().cast("array<string>")).otherwise(values)
        query = lambda v: F.array(*[F.struct(F.lit(kind).alias("kind"), _filled(t, field, v).alias("term"), F.lit(priority).alias("priority")) for kind, t, field in made])
        return F.flatten(F.transform(F.coalesce(some, F.array().cast("array<string>")), query))

    web = lambda key, usual, field: [("web", t, field) for t in templates.get(key) or [usual]]
    quoted = '"{phrase}"'
    parts = [
        each(found, 2, [("reddit", quoted, "phrase"), ("github", quoted, "phrase"), *web("phrase_web", quoted, "phrase")], PRIORITY["phrase"]),
        each(F.col("telegram"), 3, [("reddit", "@{handle}", "handle"), *web("handle_web", '"@{handle}"', "handle")], PRIORITY["telegram"]),
        *[each(F.col(t), 2, [("web", "{w}", "w")], PRIORITY["wallet"]) for t in ("wallet_eth", "wallet_btc", "wallet_trx")],
        each(F.filter("domain", lambda d: ~d.rlike(NO_PIVOT)), 2, [("reddit", "{d}", "d"), ("github", '"{d}"', "d"), ("web", '"{d}"', "d")], PRIORITY["domain"], False),
        each(F.col("email"), 1, [("reddit", "{e}", "e"), ("web", '"{e}"', "e")], PRIORITY["email"], False),
        each(F.col("github_user"), 2, [("web", '"github.com/{u}"', "u"), ("reddit", "github.com/{u}", "u")], PRIORITY["github_user"], False),
        each(F.col("brand"), 2, [("reddit", t, "brand") for t in templates.get("brand_reddit") or ["{brand} scam"]] + web("brand_web", '"{brand}" scam', "brand"), PRIORITY["brand"], False),
    ]
    rows = cases.select("case_id", F.posexplode(F.concat(*parts)).alias("place", "q")).select("case_id", "place", "q.*").where(F.length("term") <= 200)
    return first_wins(rows.withColumn("_k", F.lower("term")), ["case_id", "kind", "_k"], ["place"]).drop("_k")


def store_queries(queries: DataFrame, stored: DataFrame | None, as_of: Column) -> DataFrame:
    """New search terms: unseen (term, kind), the first case wins; Reddit and
    GitHub queries are pending, web ones are run by hand."""
    first = first_wins(queries, ["term", "kind"], ["case_id", "place"])
    fresh = first if stored is None else first.join(stored.select("term", "kind"), ["term", "kind"], "left_anti")
    return fresh.select("term", "kind", F.col("case_id").alias("origin_case"), "priority", F.when(F.col("kind").isin("reddit", "github"), "pending").otherwise("manual").alias("status"), as_of.alias("created_at"))


def run_queue(search_terms: DataFrame, limit: int = 10, max_generation: int = 2) -> DataFrame:
    """Pending queries to run next: by priority, generation, age."""
    due = search_terms.where((F.col("status") == "pending") & (F.col("generation") <= max_generation))
    return due.orderBy("priority", "generation", "created_at", "term", "kind").limit(limit)


def listing(search_terms: DataFrame) -> DataFrame:
    """All queries: pending, manual, done, then the rest; by priority inside."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "manual", 1).when(F.col("status") == "done", 2).otherwise(3)
    return search_terms.orderBy(rank, "priority", "created_at", "term", "kind")
