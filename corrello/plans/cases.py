"""Raw items to cases, observables, relationships and follow-up queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrello.functions import scoring
from corrello.functions.indicators import TYPES, host_of, with_indicators
from corrello.functions.text import case_text, once, snippet, source_class, strip
from corrello.operators.dedup import fold_keys, fold_repeats
from corrello.operators.pivots import case_queries
from corrello.store import keep

# ---- Fixed values: role of a case's edge and predicate of its relationship.
ROLES = {
    "url": ("links-to", "links-to"), "domain": ("links-to", "links-to"), "ip": ("links-to", "resolves-to"), "email": ("contact", "contacted-via"),
    "telegram": ("contact", "uses-telegram"), "github_repo": ("delivers", "delivers"), "github_user": ("delivers", "operated-by"),
    "wallet_btc": ("pays-to", "pays-to"), "wallet_eth": ("pays-to", "pays-to"), "wallet_trx": ("pays-to", "pays-to"),
    "md5": ("hash", "has-hash"), "sha1": ("hash", "has-hash"), "sha256": ("hash", "has-hash"),
}
TRUSTED = ["urlhaus", "manual"]
# ---- end of fixed values


def _lookup(column: Column, table: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in table.items():
        out = F.when(column == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def scored(items: DataFrame, profile: dict, trusted: list[str] = TRUSTED) -> DataFrame:
    """Add text, source_class and relevance."""
    rows = items.withColumns({"text": case_text(F.col("title"), F.col("body")), "source_class": source_class(F.col("source"))})
    venues = profile.get("source_context") or {}
    context = {}
    for cls in ("topic", "harm", "campaign"):
        weights = {k: float(v[cls]) for k, v in venues.items() if cls in v}
        exact = _lookup(F.col("source"), weights, "double")
        named = F.col("source").isin(list(venues)) if venues else F.lit(False)
        context[cls] = F.coalesce(exact, F.when(~named, _lookup(F.col("source_class"), weights, "double")), F.lit(0.0))
    score = scoring.relevance(F.col("text"), F.col("title"), profile, context)
    return once(rows, {"relevance": F.when(F.col("source_class").isin(trusted), F.greatest(score, F.lit(0.9))).otherwise(score)})


def gate(rows: DataFrame, threshold: float, per_source: dict[str, float] | None = None) -> DataFrame:
    """Rows at or above their source's threshold, which beats the general one."""
    bar = F.coalesce(_lookup(F.col("source_class"), per_source or {}, "double"), F.lit(threshold))
    return rows.where(F.col("relevance") >= bar)


@dataclass
class CaseTables:
    cases: DataFrame
    repeats: DataFrame
    edges: DataFrame
    relationships: DataFrame
    queries: DataFrame
    anchors: DataFrame | None = None


def with_notes(cases: DataFrame, repeats: DataFrame) -> DataFrame:
    """Add notes: where else a case was posted."""
    notes = repeats.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("note")), "\n").alias("notes"))
    return cases.join(notes, "case_id", "left")


def build_cases(items: DataFrame, profile: dict, threshold: float = 0.5, trusted: list[str] = TRUSTED, anchors: DataFrame | None = None) -> CaseTables:
    """Everything derived from raw items.  Tables are pure functions of the items
    and the profile, so processing again is calling this again.  For a batch of new
    items ``anchors`` are those of the batches before (``CaseTables.anchors``): an item may
    then repeat a case of an earlier batch."""
    kept = keep(gate(scored(items, profile, trusted), threshold, profile.get("threshold_by_source")), "gated")
    folds = fold_repeats(kept, anchors)
    told = kept.join(folds, "id")
    repeats = told.where("dup_of is not null").select("id", F.col("dup_of").alias("case_id"), F.format_string("Also posted: %s (%s)", F.coalesce("url", "source_ref"), "source").alias("note"))
    repeats = keep(repeats, "repeats")
    keywords = profile.get("lure_keywords") or []
    phrases = scoring.lure_phrases(F.col("text"), keywords)
    first = kept.join(repeats.select("id"), "id", "left_anti").withColumnRenamed("id", "case_id")
    first = first.withColumns({"lure_text": phrases, "lure_type": scoring.lure_type(F.col("text"), profile.get("lure_types") or {}), "stages": scoring.stages(F.col("text"), profile.get("stages") or {})})
    first = first.withColumn("brand_map", scoring.brands(profile)(F.col("text")))
    first = first.withColumnRenamed("url", "item_url")  # url is an indicator's name as well
    own = host_of(F.col("item_url"))
    parts = F.split(own, r"\.")
    near = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    ignore = F.concat(F.array(*[F.lit(d.lower()) for d in profile.get("ignore_domains") or []]).cast("array<string>"), F.array_compact(F.array(F.nullif(own, F.lit("")), near)))
    title, body = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("body", F.lit("")))
    shown = F.when((title != "") & body.startswith(F.substring(title, 1, 50)), body).otherwise(F.col("text"))
    wide = first.withColumns({"_ioc": shown, "_ignore": ignore})
    wide = keep(with_indicators(wide, "_ioc", F.col("_ignore"), profile.get("tlds")).drop("_ioc", "_ignore"), "cases")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(ROLES[t][0]).alias("role"), F.col(t).alias("values")) for t in TYPES]))
    found = wide.select("case_id", "text", each.alias("x")).select("case_id", "text", "x.type", "x.role", F.explode("x.values").alias("value"))
    edges = found.select("case_id", "type", "value", "role", F.lit(1.0).alias("confidence"), snippet(F.col("text"), F.col("value")).alias("context"))
    brand = wide.select("case_id", "text", F.explode("brand_map").alias("value", "confidence")).select("case_id", F.lit("brand").alias("type"), "value", F.lit("impersonates").alias("role"), "confidence", snippet(F.col("text"), F.col("value")).alias("context"))
    none = F.lit(None).cast("string").alias("context")
    script = wide.select("case_id", F.explode(F.slice("lure_text", 1, 6)).alias("value")).where(scoring.is_script(F.col("value"), keywords))
    script = script.select("case_id", F.lit("phrase").alias("type"), "value", F.lit("phrase").alias("role"), F.lit(0.8).alias("confidence"), none)
    lure = wide.where("lure_type is not null").select("case_id", F.lit("lure_type").alias("type"), F.col("lure_type").alias("value"), F.lit("classified").alias("role"), F.lit(0.7).alias("confidence"), none)
    edges = edges.union(brand).union(script).union(lure)
    predicate = _lookup(F.col("type"), {t: p for t, (_, p) in ROLES.items()} | {"brand": "impersonates"}, "string")
    of_case = edges.where(F.col("type").isin([*TYPES, "brand"])).select(F.lit("case").alias("src_type"), F.col("case_id").alias("src_value"), predicate.alias("predicate"), F.col("type").alias("dst_type"), F.col("value").alias("dst_value"))
    hosted = wide.select(F.explode("url").alias("u"), "domain").where(F.array_contains("domain", host_of(F.col("u"))))
    hosted = hosted.select(F.lit("url").alias("src_type"), F.col("u").alias("src_value"), F.lit("hosted-on").alias("predicate"), F.lit("domain").alias("dst_type"), host_of(F.col("u")).alias("dst_value"))
    again = repeats.select(F.lit("raw_item").alias("src_type"), F.col("id").alias("src_value"), F.lit("duplicate-of").alias("predicate"), F.lit("case").alias("dst_type"), F.col("case_id").alias("dst_value"))
    relationships = of_case.union(hosted).union(again).distinct()
    named = wide.withColumn("brand", F.array_sort(F.map_keys("brand_map"))).withColumn("phrases", F.col("lure_text"))
    for t in ("telegram", "wallet_eth", "wallet_btc", "wallet_trx", "domain", "email", "github_user"):
        named = named.withColumn(t, F.array_sort(t))
    cases = with_notes(wide.drop("brand_map", *TYPES).withColumnRenamed("item_url", "url"), repeats)
    standing = fold_keys(kept).join(repeats.select("id"), "id", "left_anti").where("t is not null or b is not null")
    return CaseTables(cases, repeats, edges, relationships, case_queries(named, profile), standing)
