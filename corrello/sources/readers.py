"""Readers: captured payload files of each source to the raw-item table.

Each reader declares its schema and returns the columns of ``RAW_ITEM``.
Fetching over the network is outside the engine; these parse what was captured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrello.functions.html import html_to_text
from corrello.functions.text import first_line, item_id, strip, timestamp, truncate

RAW_ITEM = "id string, source string, source_ref string, url string, author string, title string, body string, published_at timestamp, fetched_at timestamp, generation int"
# ---- Fixed values: formats of the sources.
ABUSE_COLUMNS = "id string, dateadded string, url string, url_status string, last_online string, threat string, tags string, urlhaus_link string, reporter string"
REDDIT = "id string, subreddit string, author string, title string, selftext string, url string, permalink string, created_utc string"
TOOT = "uri string, url string, created_at string, content string, account struct<acct:string>"
REPOSITORY = (
    "full_name string, description string, html_url string, created_at string, homepage string, topics array<string>, owner struct<login:string>, readme string"
)
REMOVED = ["[removed]", "[deleted]", "[ Removed by moderator ]", "[ Removed by Reddit ]"]
# ---- end of fixed values


def raw_items(df: DataFrame, fetched_at: Column, generation: int = 0) -> DataFrame:
    """Bring (source, source_ref, url, author, title, body, published_at) to RAW_ITEM."""
    return df.select(
        item_id(F.col("source"), F.col("source_ref")).alias("id"), "source", "source_ref", "url", "author",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), "published_at",
        fetched_at.cast("timestamp").alias("fetched_at"), F.lit(generation).alias("generation"),
    )


def since(df: DataFrame, start: Column | None) -> DataFrame:
    """Items without a date are kept."""
    return df if start is None else df.where(F.col("published_at").isNull() | (F.col("published_at") >= start))


def abuse_feed(spark: SparkSession, path: str, tag_filters: list[str] | None = None) -> DataFrame:
    """CSV feed of malicious URLs: nine columns, # comments; rows of fewer are dropped."""
    rows = spark.read.schema(ABUSE_COLUMNS + ", _bad string").option("comment", "#").option("columnNameOfCorruptRecord", "_bad").csv(path)
    rows = rows.where("_bad is null and reporter is not null")
    hay = F.lower(F.concat_ws(" ", "threat", "tags"))
    if tag_filters:
        rows = rows.where(reduce(lambda a, b: a | b, [hay.contains(f.lower()) for f in tag_filters]))
    body = F.format_string("URL: %s\nStatus: %s\nThreat: %s\nTags: %s\nReporter: %s\nReference: %s", "url", "url_status", "threat", "tags", "reporter", "urlhaus_link")
    return rows.select(
        F.lit("urlhaus").alias("source"), F.col("id").alias("source_ref"), F.col("urlhaus_link").alias("url"), F.col("reporter").alias("author"),
        F.format_string("URLhaus %s: %s [%s]", "id", "threat", "tags").alias("title"), body.alias("body"), timestamp(F.col("dateadded")).alias("published_at"),
    )


def _feed_time(text: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(text, r"^\w{3},\s*", ""), r"\s(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(trimmed, F.lit("d MMM yyyy HH:mm:ss Z")), timestamp(text))


def feed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """RSS 2.0 or Atom entries; both row tags are read, a file has one of them."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, author string, description string, pubDate string, `content:encoded` string").load(path)
    rss = rss.select("title", "link", F.coalesce("guid", "link", "title").alias("ref"), "author", F.coalesce("`content:encoded`", "description").alias("html"), _feed_time(F.col("pubDate")).alias("published_at"))
    atom_schema = "title string, id string, author struct<name:string>, content string, summary string, published string, updated string, link array<struct<_href:string>>"
    atom = spark.read.format("xml").option("rowTag", "entry").schema(atom_schema).load(path)
    link = F.get(F.col("link"), F.lit(0))["_href"]
    atom = atom.select("title", link.alias("link"), F.coalesce("id", link, "title").alias("ref"), F.col("author.name").alias("author"), F.coalesce("content", "summary").alias("html"), F.coalesce(_feed_time(F.col("published")), _feed_time(F.col("updated"))).alias("published_at"))
    rows = rss.union(atom).where("ref is not null")
    return rows.select(F.lit(f"rss:{name}").alias("source"), F.col("ref").alias("source_ref"), F.col("link").alias("url"), "author", "title", truncate(html_to_text(F.coalesce("html", F.lit("")))).alias("body"), "published_at")


def toots(spark: SparkSession, path: str) -> DataFrame:
    """Mastodon statuses, one JSON array or lines; one row per uri."""
    rows = spark.read.schema(TOOT).option("multiLine", True).json(path)
    rows = rows.withColumn("ref", F.coalesce("uri", "url")).where("ref is not null").dropDuplicates(["ref"]).withColumn("text", html_to_text(F.coalesce("content", F.lit(""))))
    return rows.select(F.lit("mastodon").alias("source"), F.col("ref").alias("source_ref"), F.coalesce("url", "ref").alias("url"), F.col("account.acct").alias("author"), first_line(F.col("text")).alias("title"), truncate(F.col("text")).alias("body"), timestamp(F.col("created_at")).alias("published_at"))


def reddit_posts(posts: DataFrame) -> DataFrame:
    """Archived posts: removed bodies are empty, outbound links stay in the body."""
    body = F.when(F.col("selftext").isin(REMOVED), "").otherwise(F.coalesce("selftext", F.lit("")))
    outbound = (F.coalesce("url", F.lit("")) != "") & ~F.col("url").contains("reddit.com") & ~F.col("url").contains("redd.it")
    rows = posts.dropDuplicates(["id"]).withColumn("body", body).where((F.coalesce("title", F.lit("")) != "") | (F.col("body") != ""))
    full = F.when(outbound, strip(F.concat("body", F.lit("\n\nLink: "), "url"))).otherwise(F.col("body"))
    return rows.select(
        F.concat(F.lit("reddit:"), F.coalesce("subreddit", F.lit("unknown"))).alias("source"), F.col("id").alias("source_ref"),
        F.when(F.coalesce("permalink", F.lit("")) != "", F.concat(F.lit("https://www.reddit.com"), "permalink")).otherwise(F.coalesce("url", F.lit(""))).alias("url"),
        "author", "title", truncate(full).alias("body"), timestamp(F.col("created_utc")).alias("published_at"),
    )


def reddit_archive(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages ``{"data": [...]}``, firehose and searches alike."""
    pages = spark.read.schema(f"data array<struct<{REDDIT.replace(' string', ':string')}>>").option("multiLine", True).json(path)
    return reddit_posts(pages.select(F.explode("data").alias("p")).select("p.*"))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """Captured repository searches ``{"items": [...]}``; ``readme`` is base64."""
    import re

    nested = re.sub(r"(\w+) (string|array<string>|struct<[^>]*>)(, |$)", r"\1:\2\3", REPOSITORY)
    pages = spark.read.schema(f"items array<struct<{nested}>>").option("multiLine", True).json(path)
    rows = pages.select(F.explode("items").alias("r")).select("r.*").withColumn("ref", F.lower("full_name")).dropDuplicates(["ref"])
    about = F.coalesce("description", F.lit(""))
    line = lambda c, shown: F.when(F.coalesce(c, F.lit("")) != "", shown).otherwise("")
    body = F.concat(
        about, F.lit("\n\nRepository: https://github.com/"), "full_name", F.lit("\nOwner: "), "owner.login", F.lit("\n"),
        line("homepage", F.concat(F.lit("Homepage: "), "homepage", F.lit("\n"))),
        F.when(F.size("topics") > 0, F.concat(F.lit("Topics: "), F.array_join("topics", ", "), F.lit("\n"))).otherwise(""),
        line("readme", F.concat(F.lit("\n--- README ---\n"), F.decode(F.unbase64("readme"), "utf-8"))),
    )
    title = F.when(about != "", F.concat("full_name", F.lit(": "), F.substring(about, 1, 120))).otherwise(F.col("full_name"))
    return rows.select(F.lit("github").alias("source"), F.col("ref").alias("source_ref"), F.col("html_url").alias("url"), F.col("owner.login").alias("author"), title.alias("title"), truncate(body, 30_000).alias("body"), timestamp(F.col("created_at")).alias("published_at"))


def pasted(rows: DataFrame) -> DataFrame:
    """Texts handed in: (text, title, url, author, published_at)."""
    ref = F.coalesce("url", F.concat(F.lit("text:"), F.substring(F.sha2("text", 256), 1, 16)))
    return rows.select(F.lit("manual").alias("source"), ref.alias("source_ref"), "url", "author", F.coalesce("title", first_line(strip(F.col("text")))).alias("title"), truncate(F.col("text"), 40_000).alias("body"), F.col("published_at").cast("timestamp").alias("published_at"))


def web_pages(pages: DataFrame, note: str | None = None) -> DataFrame:
    """Fetched pages (url, html): title is the first line that isn't blank."""
    rows = pages.withColumn("text", html_to_text(F.coalesce("html", F.lit(""))))
    body = F.concat(F.lit(f"Analyst note: {note}\n\n"), F.col("text")) if note else F.col("text")
    title = F.coalesce(F.nullif(first_line(F.col("text")), F.lit("")), F.col("url"))
    return rows.select(F.lit("manual").alias("source"), F.col("url").alias("source_ref"), "url", F.lit(None).cast("string").alias("author"), title.alias("title"), truncate(body, 40_000).alias("body"), F.lit(None).cast("timestamp").alias("published_at"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files; .html and .htm are read as pages; the stem is the title."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    name = F.element_at(F.split("path", "/"), -1)
    text = F.when(F.lower("path").rlike(r"\.html?$"), html_to_text(F.col("value"))).otherwise(F.col("value"))
    none = F.lit(None).cast("string")
    return pasted(rows.select(text.alias("text"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.concat(F.lit("file:"), name).alias("url"), none.alias("author"), none.alias("published_at")))


#: Cheap sources first, rate-limited ones last.
REGISTRY = {"urlhaus": abuse_feed, "rss": feed, "mastodon": toots, "reddit": reddit_archive, "github": repositories}


def collect(spark: SparkSession, config: dict, fetched_at: Column, only: list[str] | None = None, start: Column | None = None, generation: int = 0) -> DataFrame:
    """All enabled sources of ``config`` ({name: {"path": ..., ...options}}); what a
    follow-up query brought is of a later generation."""
    parts = []
    for name, reader in REGISTRY.items():
        own = dict(config.get(name) or {})
        if (only and name not in only) or not own.pop("enabled", True) or "path" not in own:
            continue
        parts.append(since(reader(spark, own.pop("path"), **own), start))
    if not parts:
        return spark.createDataFrame([], RAW_ITEM)
    return raw_items(reduce(lambda a, b: a.unionByName(b), parts), fetched_at, generation).dropDuplicates(["id"])


def profile(path: str) -> dict:
    """A YAML profile as a dictionary."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
