"""State as append-only logs and pure rewrites: upserts, ids, cluster identity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corrello.store import forget, keep


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, the first of each key."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(old.select(*keys), keys, "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key; of rows at one time the greatest."""
    rest = [c for c in log.columns if c not in keys and c != at]
    return log.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_r")).select(*keys, "_r.*").select(log.columns)


def observable_table(edges: DataFrame) -> DataFrame:
    """(type, value) with first and last sighting and distinct cases."""
    return edges.groupBy("type", "value").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count_distinct("case_id").alias("case_count"))


def display_ids(rows: DataFrame, prefix: str, order: list[str], width: int = 4, name: str = "display_id", start: int = 0) -> DataFrame:
    """Add numbered ids such as CASE-0001, in ``order`` (which must be total).

    Numbers are dense without a single-partition window: rows are sorted by
    range, partitions counted, and each adds the counts before it."""
    ranked = rows.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranked = keep(ranked, "ids")
    counts = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("low")).orderBy("_p").collect()
    before, total = [], start
    for row in counts:
        before.append((row["_p"], total, row["low"]))
        total += row["n"]
    if not before:
        return rows.withColumn(name, F.lit(None).cast("string"))
    table = rows.sparkSession.createDataFrame(before, "_p int, _before long, _low long")
    number = F.col("_before") + F.col("_m") - F.col("_low") + 1
    return ranked.join(F.broadcast(table), "_p").withColumn(name, F.format_string(f"{prefix}-%0{width}d", number)).drop("_p", "_m", "_before", "_low")


def source_runs(log: DataFrame) -> DataFrame:
    """Per source: last run, its status, items in total."""
    return log.groupBy("name").agg(F.max("run_at").alias("last_run"), F.max_by("status", "run_at").alias("last_status"), F.sum("items").alias("items_total"))


def match_clusters(components: Iterable[tuple[str, int]], overlaps: Iterable[tuple[str, str, int]], sizes: dict[str, int]) -> tuple[dict[str, str], list[str]]:
    """Old identities for new components, greedy and exclusive.

    components: (component, size); overlaps: (component, cluster, shared cases).
    Larger components choose first (ties: smaller key); each takes the unclaimed
    cluster it shares most with (ties: smaller id) if that is at least half of
    the cluster, rounded down, and at least one case.  Returns component ->
    cluster, and the clusters nobody claimed."""
    offers: dict[str, list[tuple[int, str]]] = {}
    for component, cluster, shared in overlaps:
        offers.setdefault(component, []).append((-shared, cluster))
    taken: dict[str, str] = {}
    claimed: set[str] = set()
    for component, _ in sorted(components, key=lambda c: (-c[1], c[0])):
        free = [o for o in sorted(offers.get(component, [])) if o[1] not in claimed]
        if free and -free[0][0] >= max(1, sizes[free[0][1]] // 2):
            taken[component] = free[0][1]
            claimed.add(free[0][1])
    return taken, sorted(set(sizes) - claimed)


def claims(overlaps: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(component, cluster_id, shared)``: what ``match_clusters`` finds, in rounds.

    overlaps: (component, size, cluster_id, cluster_size, shared), one row per pair with
    shared cases.  Deferred acceptance: every component turns to the best cluster it
    still may have (most shared cases, then the smaller id); a cluster is held by the
    best-placed of those (larger size, then the smaller key) that share enough with it,
    and is lost to all placed behind.  Holders only get better, so a cluster that is lost
    stays lost; when no component has to turn elsewhere, every one has what it would have
    got in its turn.  A component whose best free cluster shares too little gets none, and
    does not keep it from others."""
    place = F.struct((-F.col("size")).alias("s"), "component")
    enough = F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("cluster_size") / 2))
    offers = keep(overlaps.select("component", "cluster_id", "shared", place.alias("place"), enough.alias("enough")), "id-offers")
    for _ in range(most_rounds):
        wish = F.min_by(F.struct("cluster_id", "shared", "place", "enough"), F.struct((-F.col("shared")).alias("s"), "cluster_id"))
        wishes = keep(offers.groupBy("component").agg(wish.alias("w")).select("component", "w.*"), "id-wishes")
        holders = wishes.where("enough").groupBy("cluster_id").agg(F.min("place").alias("holder"))
        lost = wishes.join(holders, "cluster_id").where("holder < place")
        if lost.isEmpty():
            return wishes.where("enough").select("component", "cluster_id", "shared")
        left = offers.join(holders, "cluster_id", "left").where("holder is null or place <= holder").drop("holder")
        after = keep(left.select(offers.columns), "id-offers")
        forget(offers)
        forget(wishes)
        offers = after
    raise RuntimeError(f"identities did not settle in {most_rounds} rounds")


def persist_identity(members: DataFrame, old_members: DataFrame, old_clusters: DataFrame, as_of: Column, prefix: str = "CLU") -> tuple[DataFrame, DataFrame]:
    """New ``(clusters, cluster_cases)`` from components and the last state.

    clusters: cluster_id, status, is_new, created_at, updated_at, size.  A claimed
    cluster keeps its id and is new again only if its membership changed (a closed
    one reopens); an unclaimed one closes.  Components without one get new ids, larger
    ones first.  Nothing but the greatest number in use comes to the driver."""
    members = keep(members.select("case_id", F.col("component").cast("string").alias("component")), "id-members")
    old_members = keep(old_members.select("case_id", "cluster_id"), "id-old")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    olds = old_members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    both = members.join(old_members, "case_id").groupBy("component", "cluster_id").agg(F.count(F.lit(1)).alias("shared"))
    taken = keep(claims(both.join(sizes, "component").join(olds, "cluster_id")), "id-taken")
    number = F.max(F.try_element_at(F.split("cluster_id", "-"), F.lit(-1)).cast("long"))
    last = old_clusters.agg(F.coalesce(number, F.lit(0))).first()[0]
    kept = sizes.join(taken, "component").join(olds, "cluster_id").select("component", "cluster_id", "size", (~((F.col("shared") == F.col("size")) & (F.col("size") == F.col("cluster_size")))).alias("changed"))
    fresh = sizes.join(taken.select("component"), "component", "left_anti").withColumn("changed", F.lit(True))
    fresh = display_ids(fresh, prefix, [F.desc("size"), "component"], name="cluster_id", start=last)
    named = keep(kept.unionByName(fresh.select(kept.columns)).withColumn("size", F.col("size").cast("int")), "id-named")
    calls = [c for c in ("lineage", "note") if c in old_clusters.columns]  # an analyst's, kept as they are
    merged = old_clusters.select("cluster_id", F.col("status").alias("s"), F.col("is_new").alias("w"), F.col("created_at").alias("c"), F.col("updated_at").alias("u"), F.col("size").alias("z"), *calls).join(named, "cluster_id", "full")
    gone = F.col("component").isNull()
    clusters = merged.select(
        "cluster_id",
        F.when(gone, "closed").when(F.col("s").isNull() | (F.col("s") == "closed"), "new").otherwise(F.col("s")).alias("status"),
        F.when(gone, False).otherwise(F.col("changed") | F.coalesce("w", F.lit(False))).alias("is_new"),
        F.coalesce("c", as_of).alias("created_at"),
        F.when(gone & (F.col("s") == "closed"), F.col("u")).otherwise(as_of).alias("updated_at"),
        F.coalesce("size", "z").alias("size"),
        *calls,
    )
    return clusters, members.join(named.select("component", "cluster_id"), "component").select("cluster_id", "case_id")


def mark_seen(clusters: DataFrame) -> DataFrame:
    """Acknowledge: nothing is new, new ones count as seen."""
    fresh = F.col("is_new")
    return clusters.withColumns({"status": F.when(fresh & (F.col("status") == "new"), "seen").otherwise(F.col("status")), "is_new": F.lit(False)})


def assess(clusters: DataFrame, cluster_id: str, lineage: str, note: str | None = None) -> DataFrame:
    """An analyst's call on lineage, with a note, stored with the cluster.  It sets
    open clusters to investigating and never touches the confidence."""
    if lineage not in ("same", "different", "unknown"):
        raise ValueError("lineage must be same, different or unknown")
    if clusters.where(F.col("cluster_id") == cluster_id).isEmpty():
        raise KeyError(cluster_id)
    own = F.col("cluster_id") == cluster_id
    before = lambda c: F.col(c) if c in clusters.columns else F.lit(None).cast("string")
    return clusters.withColumns(
        {
            "status": F.when(own & F.col("status").isin("new", "seen"), "investigating").otherwise(F.col("status")),
            "lineage": F.when(own, F.lit(lineage)).otherwise(before("lineage")),
            "note": F.when(own, F.lit(note).cast("string")).otherwise(before("note")),
        }
    )
