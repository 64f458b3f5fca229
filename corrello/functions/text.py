"""Text normalisation as column expressions.

Regular expressions carry (?U) so that word and space classes are Unicode's.
Null in, null out, unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: closed lists and patterns that results depend on.
STOPWORDS = (
    "a an the and or but if then so of to in on at for from by with about as into like through after over "
    "between out against during without before under around among is are was were be been being have has had "
    "do does did will would shall should can could may might must i you he she it we they me him her us them "
    "my your his its our their this that these those there here what which who whom whose when where why how "
    "all any both each few more most other some such no nor not only own same than too very just also"
).split()
TRUNCATED = "\n…[truncated]"
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu"]
#: Dead spelling and live form, applied in this order.
REFANG = (
    (r"(?iU)\bhxxps\b", "https"),
    (r"(?iU)\bhxxp\b", "http"),
    (r"(?i)\[(?:\.|dot)\]|\((?:\.|dot)\)|\{(?:\.|dot)\}", "."),
    (r"(?iU)\s+\[?dot\]?\s+", "."),
    (r"\[:\]", ":"),
    (r"\[://\]", "://"),
    (r":\\/\\/", "://"),
    (r"\[/\]", "/"),
    (r"(?i)\[(?:@|at)\]|\((?:@|at)\)", "@"),
    (r"(?iU)\s+\[?at\]?\s+(?=[\w-]+\.[a-z]{2,})", "@"),
)
# ---- end of fixed values


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.  An expression that a lambda
    refers to is computed again for each element; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with costly columns that are computed once per row.  A filter over a
    projected column is pushed below it with a second copy of its expression;
    below a generator, which this is (one row in, one out), it is not."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def words(text: Column) -> Column:
    """Words between Unicode white space; empty array for blank text."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def squeeze(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.array_join(words(text), " ")


def case_text(title: Column, body: Column) -> Column:
    """Title, blank line, body; nulls are empty; outer white space goes."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))
    return strip(joined)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def source_class(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


#: What a text must hold for the refang step of the same place to apply.
_REFANG_NEEDS = (
    lambda v: F.lower(v).contains("hxxps"),
    lambda v: F.lower(v).contains("hxxp"),
    lambda v: v.contains("[") | v.contains("(") | v.contains("{"),
    lambda v: F.lower(v).contains("dot"),
    lambda v: v.contains("[:]"),
    lambda v: v.contains("[://]"),
    lambda v: v.contains(":\\/\\/"),
    lambda v: v.contains("[/]"),
    lambda v: v.contains("[") | v.contains("("),
    lambda v: v.contains(".") & F.lower(v).contains("at"),
)


def refang(text: Column) -> Column:
    """Bring indicators that were made unclickable back to their live form.  Each
    step is taken only where a plain search finds what it cannot do without."""

    def apply(at: int, value: Column) -> Column:
        if at == len(REFANG):
            return value
        pattern, live = REFANG[at]
        guard = _REFANG_NEEDS[at](value)
        return let(F.when(guard, F.regexp_replace(value, pattern, live)).otherwise(value), lambda v: apply(at + 1, v))

    return apply(0, text)


def defang(value: Column) -> Column:
    """Make an indicator unclickable."""
    for live, dead in (("http://", "hxxp://"), ("https://", "hxxps://"), (".", "[.]")):
        value = F.replace(value, F.lit(live), F.lit(dead))
    return value


def normalise(text: Column) -> Column:
    """Lower case without URLs and punctuation, single spaces."""
    # nothing without a slash is an address
    text = F.when(text.contains("/"), F.regexp_replace(text, r"(?U)https?://\S+|\S+\.\S+/\S*", " ")).otherwise(text)
    text = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    text = F.regexp_replace(text, r"(?U)[^\w\s'$@#.-]", " ")
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" .-"))


def sentences(text: Column) -> Column:
    """Sentences of 3 to 60 words, in order."""
    parts = F.split(F.coalesce(text, F.lit("")), r"""(?U)(?<=[.!?])\s+|\n{2,}|\r?\n(?=[A-Z"'“])""")
    trimmed = F.transform(parts, strip)
    return F.filter(trimmed, lambda s: F.size(words(s)).between(3, 60))


def with_hyphens_spread(text: Column) -> Column:
    """Lower case; a text with hyphens is followed by a copy with spaces instead."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("-"), F.concat(low, F.lit(" "), F.replace(low, F.lit("-"), F.lit(" ")))).otherwise(low)


def title_key(title: Column) -> Column:
    return squeeze(F.lower(F.coalesce(title, F.lit(""))))


def snippet(text: Column, needle: Column, width: int = 80) -> Column:
    """Text around the first case-insensitive find of ``needle``; null if absent."""
    at = F.instr(F.lower(text), F.lower(needle))
    first = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, squeeze(F.substring(text, first, at - first + F.length(needle) + width)))


def truncate(text: Column, limit: int = 20_000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def first_line(text: Column, limit: int = 140) -> Column:
    return F.substring(F.get(F.split(text, "\n"), F.lit(0)), 1, limit)


def item_id(source: Column, ref: Column) -> Column:
    """Stable id of an item: 32 hex digits of SHA-256 over source and reference."""
    return F.substring(F.sha2(F.concat_ws("|", source, ref), 256), 1, 32)


def registrable(host: Column) -> Column:
    """Likely registrable domain: two labels, three below co.uk and its like."""

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        country = (n >= 3) & F.get(parts, n - 2).isin(SECOND_LEVEL) & (F.length(F.get(parts, n - 1)) == 2)
        take = F.when(country, F.lit(3)).otherwise(F.least(n, F.lit(2)))
        return F.array_join(F.slice(parts, n - take + 1, take), ".")

    return let(F.split(host, r"\."), cut)


def timestamp(value: Column) -> Column:
    """Epoch seconds or ISO text to a timestamp (zone-less is UTC); else null."""
    digits = F.when(value.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(value.try_cast("double")))
    return F.coalesce(digits, F.try_to_timestamp(value))


def age_days(since: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(since)) / 86_400).cast("int")


def _content_words(text: Column, drop: list[str] | None) -> Column:
    """Words of normalised text (which has single spaces only) without stop words."""
    kept = F.array_remove(F.split(normalise(F.coalesce(text, F.lit(""))), " "), "")
    drop = STOPWORDS if drop is None else drop
    return F.filter(kept, lambda w: ~w.isin(drop)) if drop else kept


def shingles(text: Column, k: int = 2, drop: list[str] | None = None) -> Column:
    """Distinct k-word shingles of normalised text without stop words; a shorter
    text is one shingle, a blank one has none."""

    def made(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return let(_content_words(text, drop), made)


def shingle_hashes(text: Column, k: int = 2, drop: list[str] | None = None) -> Column:
    """The shingles of ``shingles`` as distinct 64-bit hashes, without building
    their strings; a shorter text is one shingle, a blank one has none."""
    def made(h: Column) -> Column:
        n = F.size(h)
        many = h
        for i in range(1, k):  # h[j], h[j + 1], ... are mixed one after the other
            left = F.slice(many, F.lit(1), F.greatest(n - i, F.lit(0)))
            many = F.zip_with(left, F.slice(h, F.lit(1 + i), F.greatest(n - i, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        few = F.transform(F.array(F.xxhash64(h)), lambda x: x)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, few).otherwise(F.array_distinct(many))

    return let(F.transform(_content_words(text, drop), lambda w: F.xxhash64(w)), made)
