"""Repeat posts of one author folded into the first.

A post repeats an earlier one that is no repeat itself if both are by the same
named author, at most seven days apart, and have the same title, or the same
body of more than 200 characters.  The rule depends on order (fetched_at, id),
so it is a fold.  Only posts with an equal title or body can match, found by
their keys, and only within seven days: what hangs together by keys is cut where two
posts that follow each other in time are further apart.  These sessions are the unit
of parallelism.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corrello.functions.text import squeeze, title_key
from corrello.operators.components import connected_components
from corrello.store import keep

NOBODY = ["", "[deleted]", "automoderator", "unknown"]
WEEK = 7 * 86_400
BODY = 200


def keyed(items: DataFrame) -> DataFrame:
    """Add author_key, title_key and body_key (null where they cannot match)."""
    body = squeeze(F.coalesce("body", F.lit("")))
    author = F.lower(F.coalesce("author", F.lit("")))
    return items.withColumns(
        {
            "author_key": F.when(~author.isin(NOBODY), author),
            "title_key": F.nullif(title_key(F.col("title")), F.lit("")),
            "body_key": F.when(F.length(body) > BODY, F.sha2(body, 256)),
        }
    )


def repeat_pairs(items: DataFrame) -> DataFrame:
    """``(id, earlier)``: every earlier post that would make ``id`` a repeat,
    whether or not that post is one itself.  An equi-join on author, key and week: each
    post meets those of its own week and of the weeks beside it."""
    rows = keyed(items).where("author_key is not null and published_at is not null")
    keys = F.explode(F.array_compact(F.array(F.concat(F.lit("t"), "title_key"), F.concat(F.lit("b"), "body_key"))))
    each = rows.select("id", "author_key", "fetched_at", F.unix_timestamp("published_at").alias("at"), keys.alias("key"))
    week = F.floor(F.col("at") / WEEK)
    a = each.withColumn("week", week).alias("a")
    b = each.withColumn("week", F.explode(F.sequence(week - 1, week + 1))).alias("b")
    later = F.struct("a.fetched_at", "a.id") > F.struct("b.fetched_at", "b.id")
    near = F.abs(F.col("a.at") - F.col("b.at")) <= WEEK
    same = (F.col("a.author_key") == F.col("b.author_key")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.week") == F.col("b.week"))
    return a.join(b, same & later & near).select(F.col("a.id").alias("id"), F.col("b.id").alias("earlier")).distinct()


def sessions(rows: DataFrame, group: str, at: str) -> DataFrame:
    """Add ``session`` to rows of groups: it changes where two rows of a group that follow
    each other in ``at`` (seconds, not null) are more than seven days apart.

    Rows of one week are never cut, so only first and last times of weeks are put in order."""
    week = F.floor(F.col(at) / WEEK).alias("_week")
    weeks = rows.groupBy(group, week).agg(F.min(at).alias("low"), F.max(at).alias("high"))
    order = W.partitionBy(group).orderBy("_week")
    cut = F.coalesce(F.col("low") - F.lag("high").over(order) > WEEK, F.lit(False)).cast("int")
    weeks = weeks.withColumn("_cut", cut).select(group, "_week", F.sum("_cut").over(order).alias("session"))
    return rows.withColumn("_week", week).join(weeks, [group, "_week"]).drop("_week")


class Fold:
    """The order-dependent rule for one author: ``add`` returns the anchor that a
    post repeats, or None, in which case the post becomes an anchor itself."""

    def __init__(self) -> None:
        self.anchors: dict[str, list[tuple[float, int, str]]] = {}
        self.count = 0

    def add(self, ident: str, at: float, keys: list[str], stays: bool = False) -> str | None:
        """``stays``: the post was judged before and is an anchor."""
        near = [] if stays else [x for k in keys for x in self.anchors.get(k, ()) if abs(x[0] - at) <= WEEK]
        if near:
            return min(near, key=lambda x: x[1])[2]
        for k in keys:
            self.anchors.setdefault(k, []).append((at, self.count, ident))
        self.count += 1
        return None


def fold_keys(items: DataFrame) -> DataFrame:
    """``(id, fetched_at, at, t, b)``: what the fold knows of a post, t and b being what it
    has in common with its author's posts of one title or body."""
    rows = keyed(items).withColumn("at", F.unix_timestamp(F.coalesce("published_at", "fetched_at")).cast("double"))
    key = lambda kind: F.when(F.col("author_key").isNotNull(), F.concat("author_key", F.lit(f"\0{kind[0]}"), kind))
    return rows.select("id", "fetched_at", "at", key("title_key").alias("t"), key("body_key").alias("b"))


def fold_repeats(items: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``(id, dup_of)`` for every item; dup_of is null for posts that stay.

    Items without a named author, and those that share no key with another of
    their author, never enter the fold.  A missing date is taken as fetched_at.
    The unit of the fold is a session of a group: posts of an author that hang together
    by equal titles or bodies, with no more than seven days between one and the next, so an
    author of very many posts is many units.  A session streams through one task in the
    order of the fold, with memory for its anchors.  A post without any date repeats none.
    ``anchors``: the keys (``fold_keys``) of posts that earlier folds left standing; they
    come before all items, and of them only those are read on that share a key with one."""
    each = keep(fold_keys(items).withColumn("old", F.lit(False)), "fold-keys")
    if anchors is not None:
        keys = keep(each.select(F.explode(F.array_compact(F.array("t", "b"))).alias("key")).distinct(), "fold-new")
        old = anchors.join(keys.toDF("t"), "t", "left_semi").unionByName(anchors.join(keys.toDF("b"), "b", "left_semi")).dropDuplicates(["id"])
        each = keep(each.unionByName(old.select("id", "fetched_at", "at", "t", "b").withColumn("old", F.lit(True))), "fold-both")
    seen = each.select(F.explode(F.array_compact(F.array("t", "b"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = keep(seen.select("key", F.xxhash64("key").alias("g")), "fold-shared")
    told = each.join(seen.select(F.col("key").alias("t"), F.col("g").alias("tg")), "t", "left").join(seen.select(F.col("key").alias("b"), F.col("g").alias("bg")), "b", "left")
    told = keep(told.withColumn("group", F.coalesce("tg", "bg")), "fold-told")
    ties = told.where("tg is not null and bg is not null").select(F.col("tg").alias("a"), F.col("bg").alias("b")).distinct()
    if not ties.isEmpty():
        named = connected_components(ties).select(F.col("node").alias("group"), "component")
        told = told.join(named, "group", "left").withColumn("group", F.coalesce("component", "group"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, fold = None, Fold()
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                if (row.group, row.session) != unit:
                    unit, fold = (row.group, row.session), Fold()
                found.append(fold.add(row.id, row.at, [k for k in (row.t, row.b) if isinstance(k, str)], row.old))
            told = pd.DataFrame({"id": pdf["id"], "dup_of": pd.Series(found, dtype=object)})
            yield told[~pdf["old"].astype(bool)]

    kind = items.schema["id"].dataType.simpleString()
    inside = F.col("group").isNotNull() & F.col("at").isNotNull()
    units = sessions(told.where(inside).select("group", "fetched_at", "id", "at", "t", "b", "old"), "group", "at").select("group", "session", "old", "fetched_at", "id", "at", "t", "b")
    dealt = units.repartition("group", "session").sortWithinPartitions("group", "session", F.desc("old"), "fetched_at", "id")
    folded = dealt.mapInPandas(run, f"id {kind}, dup_of {kind}")
    return folded.union(told.where(~inside & ~F.col("old")).select("id", F.lit(None).cast(kind).alias("dup_of")))
