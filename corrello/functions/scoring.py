"""Relevance, lure phrases, classification and brands, driven by a profile."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from corrello.functions.text import let, normalise, sentences, with_hyphens_spread, words

# ---- Fixed values.
#: Captures of a brand cue that are no brand.
NOT_BRANDS = (
    "the this that a an my our your their his her its linkedin indeed reddit google telegram whatsapp email gmail home "
    "monday tuesday wednesday thursday friday saturday sunday i me hr recruiter someone company startup remote us usa uk eu"
).split()
BRAND_CONTEXT = "impersonat|posing|pretend|claim|fake|scam|from|at"
# ---- end of fixed values


def _quote(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def term_weight(text: Column, terms: dict[str, float]) -> Column:
    """Summed weight of the terms found: words that begin with a term of more
    than three letters, or that equal a shorter one.  ``text`` is lower-case."""
    return _sum([F.when(text.rlike(rf"(?U)\b{_quote(t.lower())}" + r"\b" * (len(t) <= 3)), float(w)).otherwise(0.0) for t, w in terms.items()])


def relevance(text: Column, title: Column, profile: dict, context: dict[str, Column] | None = None) -> Column:
    """0 to 1: topic and harm terms must meet, or a campaign be named.  Terms in
    the title count again; ``context`` adds a venue's weight per class."""
    classes = ("topic", "harm", "campaign")

    def weights(low: Column) -> Column:
        return F.struct(*[(term_weight(low["b"], profile.get(f"{c}_terms") or {}) + term_weight(low["t"], profile.get(f"{c}_terms") or {}) + (context or {}).get(c, F.lit(0.0))).alias(c) for c in classes])

    def score(w: Column) -> Column:
        rise = lambda x, scale: 1 - F.exp(-x / scale)
        topic, harm, campaign = (w[c] for c in classes)
        both = F.sqrt(rise(topic, 2.0) * rise(harm, 2.0))
        both = F.when((harm < 1.5) & (campaign == 0), both * harm / 1.5).otherwise(both)
        return F.bround(F.least(F.greatest(both, 0.9 * rise(campaign, 1.5)), F.lit(1.0)), 3)

    low = F.struct(with_hyphens_spread(text).alias("b"), with_hyphens_spread(title).alias("t"))
    return let(let(low, weights), score)


def matched_terms(text: Column, terms: Iterable[str]) -> Column:
    """The terms found, in profile order."""
    low = with_hyphens_spread(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"(?U)\b{_quote(t.lower())}" + r"\b" * (len(t) <= 3)), F.lit(t)) for t in terms]))


def lure_phrases(text: Column, keywords: Iterable[str], most: int = 12) -> Column:
    """Quoted strings, then sentences with lure keywords, by descending score;
    ties keep the text's order."""
    kws = [k.lower() for k in keywords]
    text = F.coalesce(text, F.lit(""))
    hits = lambda p, test: _sum([F.when(test(p, k), 1.0).otherwise(0.0) for k in kws])
    part = lambda p, k: p.contains(k)
    whole = lambda p, k: p.rlike(rf"(?U)\b{_quote(k)}\b")
    # candidates as structs: a quote's rank is kept apart, words and hits are counted once
    quotes = F.transform(F.regexp_extract_all(text, F.lit(r"""["“]([^"”]{20,240})["”]"""), F.lit(1)), normalise)
    quotes = F.array_distinct(F.filter(quotes, lambda q: F.size(words(q)).between(4, 40)))

    def ranked(quoted: Column) -> Column:
        said = F.array_except(F.array_distinct(F.transform(sentences(text), normalise)), quoted)
        counted = F.transform(said, lambda s, i: F.struct(hits(s, whole).alias("h"), F.size(words(s)).alias("n"), i.alias("i"), s.alias("p")))
        fit = F.filter(counted, lambda x: (x["n"] >= 5) & (x["h"] > 0))
        density = lambda x: x["h"] + x["h"] / F.greatest(F.lit(5), x["n"]) * 20
        scored = F.transform(fit, lambda x: F.struct((-density(x)).alias("s"), (x["i"] + 1_000_000).alias("i"), x["p"].alias("p")))
        first = F.transform(quoted, lambda q, i: F.struct((-(10.0 + hits(q, part))).alias("s"), i.alias("i"), q.alias("p")))
        return F.transform(F.slice(F.sort_array(F.concat(first, scored)), 1, most), lambda x: x["p"])

    return let(quotes, ranked)


def lure_scores(text: Column, types: dict[str, dict]) -> Column:
    """Array of (type, score) that reach their type's least score, best first,
    ties in profile order.  Keywords match anywhere in a word."""
    low = with_hyphens_spread(text)
    each = []
    for i, (name, spec) in enumerate(types.items()):
        score = _sum([F.when(low.contains(k), float(w)).otherwise(0.0) for k, w in (spec.get("keywords") or {}).items()])
        each.append(F.when(score >= float(spec.get("min_score", 1.5)), F.struct((-F.bround(score, 2)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("type"))))
    if not each:
        return F.array().cast("array<struct<type:string,score:double>>")
    return F.transform(F.sort_array(F.array_compact(F.array(*each))), lambda x: F.struct(x["type"].alias("type"), (-x["s"]).alias("score")))


def lure_type(text: Column, types: dict[str, dict]) -> Column:
    return F.get(lure_scores(text, types), F.lit(0))["type"]


def stages(text: Column, rules: dict[str, list[str]]) -> Column:
    """Every stage with a cue in the text, in profile order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    each = [F.when(reduce(lambda a, b: a | b, [low.contains(c.lower()) for c in cues], F.lit(False)), F.lit(name)) for name, cues in rules.items()]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def is_script(phrase: Column, keywords: Iterable[str]) -> Column:
    """Six words or more, at least two lure keywords as whole words."""
    padded = F.concat(F.lit(" "), phrase, F.lit(" "))
    hits = _sum([F.when(padded.contains(f" {k.lower()} "), 1.0).otherwise(0.0) for k in keywords])
    return (F.size(words(phrase)) >= 6) & (hits >= 2)


class BrandFinder:
    """Brands of one text with a confidence: listed brands near a cue 0.9, names
    that a cue pattern captures 0.5."""

    def __init__(self, brands: Iterable[str], cues: Iterable[str] = (), exclusions: Iterable[str] = (), context: str | None = None, window: int = 120) -> None:
        self.window = window
        self.context = re.compile(context or BRAND_CONTEXT, re.I)
        self.listed = {b: re.compile(rf"(?<![\w-]){re.escape(b)}(?![\w-])") for b in brands}
        self.spelling = {b.lower(): b for b in reversed(list(self.listed))}
        self.cues = [re.compile(c) for c in cues]
        self.blank = [re.compile(re.escape(x), re.I) for x in exclusions]

    def __call__(self, text: str | None) -> dict[str, float]:
        text = text or ""
        for phrase in self.blank:
            text = phrase.sub(lambda m: " " * len(m[0]), text)
        found: dict[str, float] = {}
        for brand, pattern in self.listed.items():
            spans = (m.span() for m in pattern.finditer(text))
            if any(self.context.search(text[max(0, s - self.window) : e + self.window]) for s, e in spans):
                found[brand] = 0.9
        for pattern in self.cues:
            for m in pattern.finditer(text):
                name = m[1].strip(" .,;:")
                if len(name) >= 3 and name.lower() not in NOT_BRANDS:
                    brand = self.spelling.get(name.lower(), name)
                    found[brand] = max(found.get(brand, 0.0), 0.5 if brand == name else 0.9)
        return found


def brands(profile: dict):
    """A pandas UDF: text to map of brand to confidence (look-behind windows
    around each match have no array form)."""
    args = (profile.get("brands") or [], profile.get("brand_cue_patterns") or [], profile.get("brand_exclusions") or [], profile.get("brand_context_regex"))

    @F.pandas_udf(MapType(StringType(), DoubleType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = BrandFinder(*args)
        for texts in batches:
            yield texts.map(finder)

    return find
