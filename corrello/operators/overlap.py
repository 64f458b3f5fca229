"""Runs of words that texts of one table share with texts of another, usually small one.

Windows of words are hashed where the text is; only those whose hash the other side
has go on, which is told by a broadcast of its hashes while there are at most ``MOST``
of them, and by a join on hashes beyond.  Only texts with such a window are split again
and have it written out; the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrello.functions.text import let, once
from corrello.store import keep

#: Hashes that are broadcast at most.
MOST = 4_000_000


def plain_words(text: Column) -> Column:
    """Lower-case words, white space and punctuation between them removed."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\p{P}]+", " ")), " ")


def _worded(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    rows = once(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), {"w": plain_words(F.col("_text"))})
    return rows.where(F.size("w") >= size).select("id", "w")


def _mixed(hashes: Column, size: int) -> Column:
    """A hash of every run of ``size`` hashes, by runs of twice the length at a time."""

    def longer(runs: Column, length: int) -> Column:
        if length == size:
            return runs
        by = min(length, size - length)
        n = F.greatest(F.size(runs) - by, F.lit(0))
        pairs = F.zip_with(F.slice(runs, F.lit(1), n), F.slice(runs, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))
        return let(pairs, lambda v: longer(v, length + by))

    return let(hashes, lambda v: longer(v, 1))


def _hashed(rows: DataFrame, size: int) -> DataFrame:
    """``(id, at, h)`` of every window; each word is hashed once."""
    hashed = once(rows, {"runs": _mixed(F.transform("w", lambda w: F.xxhash64(w)), size)})
    return hashed.select("id", F.posexplode("runs").alias("at", "h"))


def shared_windows(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "text", size: int = 8, most: int = MOST) -> DataFrame:
    """``(left_id, right_id, shared)``: how many different windows of ``size`` words a text
    on the left has in common with one on the right.

    Null texts and those of fewer words take no part; rows of one id are one text."""
    small = _worded(right, right_id, text_col, size)
    known = keep(_hashed(small, size).select("h").distinct(), "overlap-known")
    texts = _worded(left, left_id, text_col, size)
    found = _hashed(texts, size).join(F.broadcast(known) if known.count() <= most else known, "h", "left_semi")
    found = keep(found.groupBy("id").agg(F.collect_set("at").alias("at")), "overlap-found")
    hit = found.select(F.col("id").alias(left_id))
    texts = _worded(left.select(left_id, text_col).join(F.broadcast(hit) if found.count() <= most else hit, left_id, "left_semi"), left_id, text_col, size)
    written = lambda at: F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, size), " "))))
    inside = F.filter("at", lambda i: i + size <= F.size("w"))  # rows of one id may differ in length
    own = texts.join(found, "id").select("id", written(inside).alias("s")).distinct()
    other = small.select(F.col("id").alias("other"), written(F.sequence(F.lit(0), F.size("w") - size)).alias("s")).distinct()
    return own.join(other, "s").groupBy(F.col("id").alias(left_id), F.col("other").alias(right_id)).agg(F.count(F.lit(1)).alias("shared"))
