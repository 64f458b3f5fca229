"""Ranked full-text search: inverted index, BM25, boolean queries, snippets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrello.functions.text import let, once

K1, B = 1.2, 0.75
_PART = re.compile(r'"([^"]*)"|(\()|(\))|(\S+?)(?=[()\s"]|$)')


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stem(word: Column) -> Column:
    """Light suffix stripping (plural, -ing, -ed, -ly) on words that stay long enough."""
    w = F.regexp_replace(word, r"^(.{3,}?)(?:sses)$", "$1ss")
    w = F.regexp_replace(w, r"^(.{2,}[^s])ies$", "$1i")
    w = F.regexp_replace(w, r"^(.{2,}[^su])s$", "$1")
    return F.regexp_replace(w, r"^(.*[aeiouy].*?)(?:ing|ed|ly)$", "$1")


def inverted_index(df: DataFrame, id_col: str, columns: list[str], stemmed: bool = False) -> DataFrame:
    """``(id, term, tf, positions, length)`` over all columns together."""
    tokens = F.concat(*[terms(F.col(c)) for c in columns])
    rows = once(df.select(F.col(id_col).alias("id"), *columns), {"_tokens": tokens})
    each = rows.select("id", F.size("_tokens").alias("length"), F.posexplode_outer("_tokens").alias("pos", "term")).where("pos is not null")
    if stemmed:
        each = each.withColumn("term", stem(F.col("term")))
    return each.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, floored at a small positive value."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def bm25(index: DataFrame, query_terms: list[str], documents: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` of documents with any of the terms.

    ``documents`` (id, length) is needed where blank texts count for the mean."""
    lengths = documents if documents is not None else index.select("id", "length").distinct()
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    hit = index.where(F.col("term").isin(query_terms))
    often = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = F.col("tf")
    part = idf(F.lit(float(stats["n"])), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(stats["mean"] or 1.0))))
    return hit.join(often, "term").groupBy("id").agg(F.sum(part).alias("score"))


def parse_query(text: str) -> tuple:
    """Terms, "phrases", AND, OR, NOT and parentheses; juxtaposition is AND."""
    tokens: list[tuple[str, str]] = []
    for phrase, opens, closes, word in _PART.findall(text):
        if opens or closes:
            tokens.append(("(" if opens else ")", ""))
        elif word in ("AND", "OR", "NOT"):
            tokens.append((word, ""))
        else:
            got = re.findall(r"[^\W_]+", (phrase or word).lower())
            if got:
                tokens.append(("TERM", " ".join(got)))
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def either() -> tuple:
        nonlocal at
        left = every()
        while peek() == "OR":
            at += 1
            left = ("or", left, every())
        return left

    def every() -> tuple:
        nonlocal at
        left = one()
        while peek() in ("AND", "NOT", "TERM", "("):
            kind = peek()
            at += kind in ("AND", "NOT")
            left = ("not" if kind == "NOT" else "and", left, one())
        return left

    def one() -> tuple:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = either()
            at += peek() == ")"
            return inner
        if peek() != "TERM":
            raise ValueError(f"a term is missing in {text!r}")
        at += 1
        return ("term", tokens[at - 1][1])

    if not tokens:
        raise ValueError("the query is empty")
    found = either()
    if at != len(tokens):
        raise ValueError(f"cannot read {text!r} beyond its {at}th part")
    return found


def query_terms(tree: tuple) -> list[str]:
    if tree[0] == "term":
        return tree[1].split()
    return list(dict.fromkeys(t for x in tree[1:] for t in query_terms(x)))


def _matches(tokens: Column, tree: tuple) -> Column:
    if tree[0] == "term":
        padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        return padded.contains(f" {tree[1]} ")
    left, right = (_matches(tokens, x) for x in tree[1:])
    return left & ~right if tree[0] == "not" else reduce(lambda a, b: a & b if tree[0] == "and" else a | b, (left, right))


def search(df: DataFrame, id_col: str, columns: list[str], query: str, limit: int = 20) -> DataFrame:
    """The best ``limit`` documents that match: ``(id, score, snippet)``, best
    first, ties to the smaller id.  Phrases do not cross columns."""
    tree = parse_query(query)
    tokens = F.concat(*[x for c in columns for x in (terms(F.col(c)), F.array(F.lit("\x01")))])
    fits = df.where(_matches(tokens, tree)).select(F.col(id_col).alias("id"))
    index = inverted_index(df, id_col, columns)
    best = bm25(index, query_terms(tree)).join(fits, "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)
    wanted = query_terms(tree)
    shown = best.join(df.select(F.col(id_col).alias("id"), F.concat_ws(" ", *columns).alias("_text")), "id")
    return shown.select("id", "score", snippet(F.col("_text"), wanted).alias("snippet")).orderBy(F.desc("score"), "id")


def snippet(text: Column, wanted: list[str], width: int = 12) -> Column:
    """Twelve words around the first found term, found terms in brackets."""
    parts = F.array_remove(F.split(text, r"(?U)\s+"), "")
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")

    def shown(p: Column) -> Column:
        at = F.coalesce(F.array_min(F.transform(F.filter(F.transform(p, lambda w, i: F.struct(i.alias("i"), plain(w).alias("w"))), lambda x: x["w"].isin(wanted)), lambda x: x["i"])), F.lit(0))
        start = F.greatest(at - width // 3, F.lit(0)) + 1
        return F.array_join(F.transform(F.slice(p, start, width), lambda w: F.when(plain(w).isin(wanted), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")

    return let(parts, shown)
