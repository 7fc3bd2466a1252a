import datetime

from pyspark.sql import functions as F

from parlance.streaming import feeds, jobs

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title>
<item><title> A &amp; B </title><link> https://x.com/a?b=1&amp;c=2 </link><pubDate>Tue, 03 Jun 2003 09:39:21 +0200</pubDate><description><![CDATA[<b>bold</b>]]></description></item>
<item><title>no link</title><pubDate>3 Jun 2003 09:39 GMT</pubDate></item>
<item><link>https://x.com/b</link><pubDate>yesterday</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title>One</title><link rel="self" href="https://y.org/self"/><link href="https://y.org/1"/><updated>2024-02-03T04:05:06-05:00</updated></entry>
<entry><title>Two</title><link rel="alternate" href="https://y.org/2"/><published>2024-02-03T04:05:06Z</published><summary>s</summary></entry></feed>"""


def test_shapes_and_rejects(spark):
    docs = [("rss", RSS), ("atom", ATOM), ("html", "<html><p>x</p></html>"), ("cut", RSS[:300]), ("none", None), ("empty", "<rss><channel><title>e</title></channel></rss>")]
    rows = feeds.entries(spark.createDataFrame(docs, "feed string, value string")).collect()
    got = sorted((r["feed"], r["reason"] or "", r["link"] or "", r["title"] or "", r["published"]) for r in rows)
    utc = datetime.datetime
    assert got == [
        ("atom", "", "https://y.org/1", "One", utc(2024, 2, 3, 9, 5, 6)), ("atom", "", "https://y.org/2", "Two", utc(2024, 2, 3, 4, 5, 6)),
        ("cut", "not a feed", "", "", None), ("html", "not a feed", "", "", None), ("none", "not a feed", "", "", None),
        ("rss", "", "https://x.com/a?b=1&c=2", "A & B", utc(2003, 6, 3, 7, 39, 21)), ("rss", "", "https://x.com/b", "", None), ("rss", "no link", "", "no link", utc(2003, 6, 3, 9, 39)),
    ]
    assert {r["link"]: r["summary"] for r in rows if r["link"]}["https://x.com/a?b=1&c=2"] == "<b>bold</b>"


def test_dates(spark):
    cases = {"Mon, 1 Jan 2024 00:00:00 EST": (2024, 1, 1, 5), "01 Jan 2024 10:00:00": (2024, 1, 1, 10), "Monday, 01 Jan 2024 10:00 z": (2024, 1, 1, 10), "2024-01-01": (2024, 1, 1, 0), "1 Jan 2024 10:00:00 QQQ": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", feeds.utc_date(F.col("d")).alias("t")).collect()
    assert {r["d"]: r["t"] for r in rows} == {k: v and datetime.datetime(*v) for k, v in cases.items()}


def test_stream_takes_each_file_once_and_a_restart_returns_all(spark, tmp_path):
    for k in range(5):
        (tmp_path / "in" / str(k % 2)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(k % 2) / f"f{k}.xml").write_text(RSS.replace("x.com", f"x{k}.com"))
    run = lambda: jobs.run_to_table(feeds.entries(feeds.feed_files(spark, str(tmp_path / "in"), files=2)), str(tmp_path / "out"), str(tmp_path / "check"))
    first = run()
    assert first.count() == 15 and first.where("reason IS NULL").select("link").distinct().count() == 10
    assert first.select("feed").distinct().count() == 5
    (tmp_path / "in" / "9.xml").write_text(ATOM)
    assert run().count() == 17
    assert run().count() == 17  # nothing new: what was there is still the result
