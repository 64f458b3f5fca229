"""Derived tables that follow their batches: edges with counts, and components.

Both live as Parquet in hash buckets.  A batch reads and rewrites the buckets its
rows fall into, by dynamic partition overwrite, and no others.  What it writes is a
function of the bucket's old rows and the batch as sets, so a batch that is run again,
after a stop at any point, changes nothing more.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrello.operators.components import connected_components
from corrello.store import exists, keep, remove

BUCKETS = 256
#: A bucket is written by so many tasks, so that a value of very many cases is not one task's.
SPLIT = 8


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path) if exists(spark, path) else spark.createDataFrame([], f"{schema}, bucket int")


def _touched(*tables: DataFrame) -> list[int]:
    """The buckets of some rows: at most as many as there are."""
    return sorted({r["bucket"] for t in tables for r in t.select("bucket").distinct().collect()})


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` and split, dealt by bucket and split; grouping by these and more shuffles nothing again."""
    return rows.withColumn("split", F.pmod(F.xxhash64(*by), F.lit(SPLIT))).repartition("bucket", "split")


def _replace(dealt: DataFrame, path: str) -> None:
    """Replace the buckets that have rows in ``dealt``, which may be read from them: the
    old files go when all new ones are written."""
    dealt.drop("split").sortWithinPartitions("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _rewrite(rows: DataFrame, path: str, touched: list[int], *by: str) -> None:
    """Replace the touched buckets by ``rows`` (with bucket, written elsewhere before)."""
    _replace(_dealt(rows, *by), path)
    for gone in set(touched) - set(_touched(rows)):
        remove(rows.sparkSession, f"{path}/bucket={gone}")


class EdgeTables:
    """Edges of cases to observables, and the observables with their sightings and cases.

    The same as ``state.observable_table`` over the edges of all batches: one row per
    (type, value) with first and last sighting and the number of different cases."""

    _EDGES = "case_id {0}, type string, value string, first_seen timestamp, last_seen timestamp"
    _SEEN = "type string, value string, first_seen timestamp, last_seen timestamp, case_count long"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, case_type: str = "string") -> None:
        self.spark, self.folder, self.buckets, self.kind = spark, folder.rstrip("/"), buckets, self._EDGES.format(case_type)

    def edges(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/edges", self.kind)

    def observables(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/observables", self._SEEN).drop("bucket")

    def apply(self, added: DataFrame, withdrawn: DataFrame | None = None) -> list[int]:
        """Take in edges (case_id, type, value, seen_at) and drop those of ``withdrawn``
        cases (case_id); returns the buckets that were rewritten.

        Edges that are there already, repeated ones too, count once; a null seen_at sets no
        sighting; edges without a case, type or value are left out."""
        key = ["case_id", "type", "value"]
        new = added.where("case_id is not null and type is not null and value is not null").select(*key, F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"))
        new = keep(new.withColumn("bucket", _bucket(self.buckets, "type", "value")), "inc-new")
        gone = None
        if withdrawn is not None:
            gone = keep(withdrawn.select("case_id").distinct(), "inc-gone")
            new = new.join(gone, "case_id", "left_anti")
        touched = _touched(new, *([self.edges().join(gone, "case_id", "left_semi")] if gone is not None else []))
        if not touched:
            return []
        old = self.edges().where(F.col("bucket").isin(touched))
        if gone is not None:
            old = old.join(gone, "case_id", "left_anti")
        both = old.unionByName(new)
        emptied = set(touched) - set(_touched(both)) if gone is not None else set()
        sightings = F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
        # dealt once: the edges are told apart and written where they then lie
        _replace(_dealt(both, "case_id").groupBy("bucket", "split", *key).agg(*sightings), f"{self.folder}/edges")
        for name in ("edges", "observables"):
            for bucket in emptied:
                remove(self.spark, f"{self.folder}/{name}/bucket={bucket}")
        now = self.edges().where(F.col("bucket").isin(touched))
        seen = now.groupBy("bucket", "type", "value").agg(*sightings, F.count(F.lit(1)).alias("case_count"))
        _replace(_dealt(seen, "type", "value"), f"{self.folder}/observables")
        return touched


class Classes:
    """Connected components of links that arrive in batches; equal to
    ``connected_components`` over all links (the least node names a component).

    A node gets a label once and keeps it; a small table tells each label's component.
    A batch contracts the classes its links touch to single nodes, finds the components
    of these, and rewrites the labels whose component has changed.  Links are only
    added; where one is withdrawn, build anew."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, node_type: str = "string") -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.kinds = {"members": f"node {node_type}, label {node_type}", "labels": f"label {node_type}, component {node_type}"}

    def _table(self, name: str) -> DataFrame:
        return _read(self.spark, f"{self.folder}/{name}", self.kinds[name])

    def components(self) -> DataFrame:
        """``(node, component)``."""
        return self._table("members").drop("bucket").join(self._table("labels").drop("bucket"), "label").select("node", "component")

    def link(self, links: DataFrame, src: str = "a", dst: str = "b") -> list[int]:
        """Take in links; returns the buckets of labels that were rewritten.  Links with a
        null end are left out; repeated and reversed ones and loops are harmless."""
        pairs = keep(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct(), "inc-links")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("bucket", _bucket(self.buckets, "node"))
        ends = keep(ends, "inc-ends")
        known = self._table("members").where(F.col("bucket").isin(_touched(ends))).join(ends.select("node"), "node", "left_semi")
        known = known.drop("bucket").join(self._table("labels").drop("bucket"), "label").select("node", "component")
        named = keep(ends.join(known, "node", "left").withColumn("is_new", F.col("component").isNull()).withColumn("class", F.coalesce("component", "node")), "inc-named")
        name = named.select("node", "class")
        met = pairs.join(name.toDF("a", "ca"), "a").join(name.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = keep(connected_components(met).select(F.col("node").alias("class"), F.col("component").alias("root")), "inc-found")
        moved = keep(found.where("class <> root"), "inc-moved")
        labels = self._table("labels")
        changed = labels.join(moved.withColumnRenamed("class", "component"), "component").select("label", F.col("root").alias("component"), "bucket")
        fresh = named.where("is_new").join(found, "class").select(F.col("root").alias("label"), F.col("root").alias("component")).distinct()
        fresh = fresh.withColumn("bucket", _bucket(self.buckets, "label")).join(labels.select("label"), "label", "left_anti")
        more = keep(changed.unionByName(fresh), "inc-labels")
        touched = _touched(more)
        if touched:
            rest = labels.where(F.col("bucket").isin(touched)).join(more.select("label"), "label", "left_anti")
            _rewrite(keep(rest.unionByName(more), "inc-rewritten"), f"{self.folder}/labels", touched, "label")
        joined = named.where("is_new").join(found, "class").select("node", F.col("root").alias("label"), "bucket")
        joined.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/members")
        return touched
