"""Landed feeds: RSS and Atom documents, one file each, as a stream of entries.

Fetching is another program's work; what it lands is read here with Spark's own XML functions. A document that is neither
shape, or that is broken, is a reject with its reason, and so is an entry without a link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_id

RSS = "channel struct<title string, item array<struct<title string, link string, guid string, pubDate string, description string>>>, broken string"
ATOM = "title string, entry array<struct<title string, link array<struct<_href string, _rel string>>, id string, published string, updated string, summary string, content string>>, broken string"
#: The zone names of mail dates and their offsets.
ZONES = {"UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_files(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of (feed, value): each landed file's path and whole text, ``files`` a trigger."""
    rows = spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("feed"), "value")


def utc_date(text: Column) -> Column:
    """A time stamp of a mail date (``Tue, 03 Jun 2003 09:39:21 +0200``, names of zones too) or an ISO one; null if it is neither.

    A date without a zone is in UTC, which has to be the session's zone.
    """
    mail = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    zone = F.regexp_extract(mail, r"\s([A-Za-z]{1,3})$", 1)
    mail = F.when(zone != "", F.concat(F.regexp_replace(mail, r"[A-Za-z]{1,3}$", ""), F.try_element_at(zones, F.upper(zone)))).otherwise(mail)
    mail = F.regexp_replace(mail, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})(?= [+-])", "$1:00")
    return F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")), F.trim(text).try_cast("timestamp"))


def entries(feeds: DataFrame) -> DataFrame:
    """(feed, format, id, link, title, summary, published, reason) of documents (feed, value); reason is null for an entry that is good.

    An entry's link is RSS's link, or of Atom's the first ``alternate`` one or one without a relation; published is in
    UTC, null where no date can be read. Its id is that of an article with the link as its url. Entries may repeat from
    fetch to fetch: deduplicate by id. An empty feed gives no rows, a document that is no feed one.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    shape = F.when(F.col("value").rlike(r"(?s)<(?:\w+:)?feed[\s>]"), "atom").when(F.col("value").rlike(r"(?s)<rss[\s>]"), "rss")
    read = feeds.select("feed", "value", shape.alias("format"))
    read = read.withColumns({"rss": F.when(F.col("format") == "rss", F.from_xml("value", RSS, options)), "atom": F.when(F.col("format") == "atom", F.from_xml("value", ATOM, options))})
    rss = F.transform("rss.channel.item", lambda x: F.struct(x["link"].alias("link"), x["title"].alias("title"), x["description"].alias("summary"), x["pubDate"].alias("date")))

    def atom_entry(x: Column) -> Column:
        href = F.filter(x["link"], lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(F.get(href, F.lit(0))["_href"].alias("link"), x["title"].alias("title"), F.coalesce(x["summary"], x["content"]).alias("summary"), F.coalesce(x["published"], x["updated"]).alias("date"))

    found = F.coalesce(rss, F.transform("atom.entry", atom_entry))
    broken = F.col("format").isNull() | F.coalesce("rss.broken", "atom.broken").isNotNull()
    nothing = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in ("link", "title", "summary", "date")]))
    rows = read.select("feed", "format", broken.alias("broken"), F.explode(F.when(broken, nothing).otherwise(found)).alias("e"))
    link = F.nullif(F.trim("e.link"), F.lit(""))
    reason = F.when(F.col("broken"), "not a feed").when(link.isNull(), "no link")
    return rows.select(
        "feed", "format", article_id(link).alias("id"), link.alias("link"), F.trim("e.title").alias("title"), F.trim("e.summary").alias("summary"),
        utc_date(F.col("e.date")).alias("published"), reason.alias("reason"),
    )
