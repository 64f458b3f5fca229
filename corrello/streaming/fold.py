"""Repeat posts folded while they arrive, in any order.

``fold_repeats`` judges posts in the order of (fetched_at, id); a file that comes
late may turn an anchor into a repeat and set its repeats free again.  So the
stream is grouped by author, and the state of an author maps each title and body to
the posts that have it.  New posts are judged anew together with what hangs
together with them by equal titles or bodies, and every judgement that is new or
has changed is given out; of an id the last one counts.  Posts without a named
author, and those with neither title nor body, are given out at once.

Without ``lateness`` all posts are kept, and the last judgements equal those of
``fold_repeats`` over all rows, whatever the order of the files.  With it (posts come
no later than that after the newest, judged by fetched_at, and are dated no further
than ``reach`` before they are fetched) event-time timers drop what can no longer
matter: repeats once no earlier post can come, anchors when no post within seven days of
theirs can.  Posts that come later than promised are not dropped: they are judged
against what is left.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType

from corrello.operators.dedup import WEEK, Fold, keyed
from corrello.operators.state import latest
from corrello.store import exists

_DAY = 86_400_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Folding(StatefulProcessor):
    """A post is [fetched (microseconds), id, dated (seconds), its keys, what it repeats]."""

    def __init__(self, reach: float | None) -> None:
        self.reach = reach  # days that a post may be dated before it is fetched; None: nothing is dropped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posts = handle.getMapState("posts", "key string", "posts string")

    def _of(self, key: str) -> list:
        return json.loads(self.posts.getValue((key,))[0]) if self.posts.containsKey((key,)) else []

    def _put(self, key: str, posts: list) -> None:
        if posts:
            self.posts.updateValue((key,), (json.dumps(posts),))
        elif self.posts.containsKey((key,)):
            self.posts.removeKey((key,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: list[tuple] = []
        fresh: dict = {}
        for pdf in rows:
            for r in pdf.to_dict("records"):
                keys = [k for k in (r["t"], r["b"]) if isinstance(k, str)]
                if keys:
                    fetched = None if pd.isna(r["fetched"]) else int(r["fetched"])
                    fresh[r["id"]] = [fetched, r["id"], None if pd.isna(r["at"]) else float(r["at"]), keys, False]
                else:
                    told.append((r["id"], None))
        # what hangs together with the new posts by equal titles or bodies
        known: dict = dict(fresh)
        open_, seen = {k for p in fresh.values() for k in p[3]}, set()
        while open_:
            k = open_.pop()
            seen.add(k)
            for p in self._of(k):
                known[p[1]] = p  # a post that came before is not new
                open_.update(x for x in p[3] if x not in seen)
        fold = Fold()
        for p in sorted(known.values(), key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
            dup_of = fold.add(p[1], math.nan if p[2] is None else p[2], p[3])
            if dup_of != p[4] or p[4] is False:
                told.append((p[1], dup_of))
                p[4] = dup_of
        for k in seen:
            self._put(k, [p for p in known.values() if k in p[3]])
        if self.reach is not None:
            for day in {math.ceil(self._due(p, True) / _DAY) for p in fresh.values() if p[0] is not None}:
                self.handle.registerTimer(day * _DAY)
        if told:
            yield pd.DataFrame({"id": [t[0] for t in told], "dup_of": pd.Series([t[1] for t in told], dtype=object)})

    def _due(self, post: list, anchor: bool) -> float:
        """The watermark, in milliseconds, beyond which the post no longer matters."""
        settled = (post[0] or 0) / 1000 + 1
        return max(settled, ((post[2] or 0) + WEEK) * 1000 + self.reach * _DAY) if anchor else settled

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for k in [row[0] for row in self.posts.keys()]:
            posts = self._of(k)
            left = [p for p in posts if p[0] is None or self._due(p, p[4] is None) >= now]
            if len(left) < len(posts):
                self._put(k, left)
        return iter([])

    def close(self) -> None:
        pass


def folded_stream(items: DataFrame, lateness: str | None = None, reach: float = 30.0) -> DataFrame:
    """``(id, dup_of)`` of a stream of raw items: judgements as they are made or change.

    ``items`` has id (bigint or string), author, title, body, published_at and
    fetched_at.  Nulls are handled as by ``fold_repeats``; a repeated id counts once.
    Needs the RocksDB state store (``stream_folds`` sets it)."""
    rows = items.withWatermark("fetched_at", lateness) if lateness else items
    rows = keyed(rows)
    key = lambda kind: F.when(F.col("author_key").isNotNull(), F.concat(F.lit(kind[0]), kind))
    rows = rows.select(
        F.unix_micros("fetched_at").alias("fetched"), "id", F.unix_timestamp(F.coalesce("published_at", "fetched_at")).cast("double").alias("at"),
        key("title_key").alias("t"), key("body_key").alias("b"), "author_key",
    )
    alone = F.coalesce("t", "b").isNull()
    rows = rows.withColumn("author", F.when(alone, F.concat(F.lit("\0"), F.col("id").cast("string"))).otherwise(F.col("author_key"))).drop("author_key")
    kind: DataType = items.schema["id"].dataType
    out = f"id {kind.simpleString()}, dup_of {kind.simpleString()}"
    return rows.groupBy("author").transformWithStateInPandas(_Folding(reach if lateness else None), out, "Update", "EventTime" if lateness else "None")


def stream_folds(items: DataFrame, folder: str, checkpoint: str, lateness: str | None = None, reach: float = 30.0) -> StreamingQuery:
    """Fold all of a stream that no earlier run has read; ``current_folds`` reads the result.

    Each micro-batch writes its own folder, so one that is run again after a stop
    replaces what it wrote before."""
    spark = items.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        write = folded_stream(items, lateness, reach).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return write.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)


def current_folds(spark: SparkSession, folder: str, id_type: str = "string") -> DataFrame:
    """``(id, dup_of)``: the last judgement of every id."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"id {id_type}, dup_of {id_type}")
    log = spark.read.schema(f"id {id_type}, dup_of {id_type}, batch long").parquet(folder)
    return latest(log, ["id"], "batch").select("id", "dup_of")
