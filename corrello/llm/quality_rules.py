"""Quality rules in DataFrame functions only.

Every document gets base counts over its words and a hashed n-gram
log-likelihood ratio: unigrams and bigrams of word / punctuation tokens fall
into ``BUCKETS`` hash buckets; one multinomial over the buckets is estimated on
trusted target documents, another on the raw corpus (all documents).  The score
is the mean of log p_target - log p_raw over the document's n-grams, and a
document is kept when it passes the base rules and the score is at least
``THRESHOLD``.  Thresholding is deterministic; nothing is sampled from the corpus.

The target is every document labelled good outside the evaluation fold: their ids
follow the corpus, so texts are dealt by id to meet them.  After that each task
adds up its documents' buckets, at most BUCKETS rows per task whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrello.store import keep, table

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 16_384
THRESHOLD = -0.15
SMOOTH = 1.0
WINDOW = 8


def _pairs(items: Column, step: int, f) -> Column:
    """f over elements ``step`` apart; empty when there are not enough."""
    n = F.greatest(F.size(items) - step, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(1 + step), n), f)


def _base_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to
    ``rows``, whose other columns are this module's own.

    Null text counts as empty.  Words are runs without ASCII white space;
    repeated 8-word windows are found by a 64-bit hash of the window.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    first = rows.withColumn("_words", F.array_remove(F.split(text, SPACE), "")).withColumn("_lines", lines)
    mix = lambda a, b: F.xxhash64(a, b)
    hashed = first.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn("_w2", _pairs(F.col("_w1"), 1, mix)).withColumn("_w4", _pairs(F.col("_w2"), 2, mix))
    # No 8-word window is there twice unless a 4-word window is.
    again = F.size(F.array_distinct("_w4")) < F.size("_w4")
    hashed = hashed.withColumn("_w8", F.when(again, _pairs(F.col("_w4"), 4, mix)))
    twice = F.size(F.array_distinct("_w8")) < F.size("_w8")
    spots = hashed.withColumn("_at", F.when(twice, F.sort_array(F.transform("_w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    spots = spots.withColumn("_same", _pairs(F.col("_at"), 1, lambda a, b: a["h"] == b["h"]))
    both = F.filter("_at", lambda x, i: F.coalesce(F.get("_same", i - 1), F.lit(False)) | F.coalesce(F.get("_same", i), F.lit(False)))
    spots = spots.withColumn("_pos", F.sort_array(F.transform(both, lambda x: x["i"])))
    steps = _pairs(F.col("_pos"), 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)
    return spots.select(
        *rows.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _tokens(text: Column) -> Column:
    """Lower-cased runs of word characters and runs of other visible ones."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+|[^\w\s]+)"), 1)


def _bucket(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def _with_buckets(rows: DataFrame, text_col: str) -> DataFrame:
    """Add _buckets: the bucket numbers of a text's unigrams, then of its bigrams."""
    hashes = rows.withColumn("_tok", F.transform(_tokens(F.col(text_col)), lambda t: F.xxhash64(t)))
    uni = F.transform("_tok", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return hashes.withColumn("_buckets", F.concat(uni, _pairs(F.col("_tok"), 1, lambda a, b: _bucket(a, b)))).drop("_tok")


def _ngram_rows(rows: DataFrame, text_col: str, *others: Column) -> DataFrame:
    """One row per n-gram: its bucket, and ``others``.

    A generator evaluates its argument once per mention, so tokens are a column
    of their own first; every token then leaves beside its successor, and both
    hashes are computed in generated code."""
    tok = rows.select(*others, _tokens(F.col(text_col)).alias("_tok"))
    after = F.slice("_tok", F.lit(2), F.greatest(F.size("_tok") - 1, F.lit(0)))
    names = tok.columns[:-1]
    each = tok.select(*names, F.explode(F.arrays_zip(F.col("_tok").alias("a"), after.alias("b"))).alias("_z"))
    bigram = F.when(F.col("_z.b").isNotNull(), _bucket(F.xxhash64("_z.a"), F.xxhash64("_z.b")))
    both = each.select(*names, F.explode(F.array(_bucket(F.col("_z.a")), bigram)).alias("bucket"))
    return both.where("bucket is not null")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled quality 1, outside the evaluation fold (crc32 mod 5 = 0)."""
    good = labels.where("quality = 1 and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return good.select("doc_id").distinct()


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log p_target - log p_raw of each bucket; zeros if no trusted text exists.

    ``trusted`` follows the corpus and is never broadcast; only its narrow rows
    are held for the join.  The result has BUCKETS numbers, whatever the corpus size.
    """
    own = trusted.select(F.col("doc_id").alias("_trusted"), F.lit(0).alias("_at")).hint("shuffle_hash")
    # Rows without an id meet nothing; a second key spreads them over the tasks.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_spread", spread)
    marked = texts.join(own, (F.col("doc_id") == F.col("_trusted")) & (F.col("_spread") == F.col("_at")), "left")
    rows = _ngram_rows(marked, "text", F.col("_trusted").isNotNull().cast("long").alias("t"))
    counts = {r["bucket"]: (r["t"], r["n"]) for r in rows.groupBy("bucket").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    total_t, total_n = (sum(v[i] for v in counts.values()) for i in (0, 1))
    if not total_t:
        return [0.0] * BUCKETS
    from math import log

    def weight(b: int) -> float:
        t, n = counts.get(b, (0, 0))
        return round(log((t + SMOOTH) / (total_t + SMOOTH * BUCKETS)) - log((n + SMOOTH) / (total_n + SMOOTH * BUCKETS)), 6)

    return [weight(b) for b in range(BUCKETS)]


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, llr, base_failed and kept, one row per input row.

    base_failed: fewer than 20 words, or more than 30 % of the words lie in
    8-word windows found twice.  llr of a text without n-grams is 0; such texts
    fail the base rules.  Input columns of the added names are replaced; all
    others come back as they were, whatever their names, as rows travel in a struct.
    """
    weights = F.split(F.lit(",".join(map(str, bucket_weights(docs, trusted_ids(labels))))), ",").cast("array<double>")
    others = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in others)).alias("_row"), docs["text"].cast("string").alias("_text"))
    rows = _with_buckets(_base_counts(rows, "_text"), "_text")
    summed = F.aggregate("_buckets", F.lit(0.0), lambda s, b: s + F.get(weights, b))
    llr = F.when(F.size("_buckets") > 0, summed / F.size("_buckets")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = rows.withColumn("llr", llr).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
    return scored.select("_row.*", *ADDED)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("text")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.  Rows are carried
    whole beside their text, so no column of theirs is taken for a count."""
    carried = docs.select("doc_id", "text", F.struct(*docs.columns).alias("carried"))
    scored = score_quality(carried, table(spark, sf_dir, "labels"))
    # The scored rows are written before they are filtered: a filter over them is
    # pushed below the projections that share subexpressions, and each reference
    # is then written out and computed again.
    return keep(scored.drop("text"), "quality").where("kept").select("carried.*")
