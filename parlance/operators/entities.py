"""Lists, series and search over entities; identity is the canonical id, names of aliases lead to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.text import normalize_name, sequence_ratio
from .rollups import between

def readings() -> list:
    """The aggregates of every reading: mentions and mean scores."""
    return [F.count("*").alias("mentions"), F.avg("power").alias("avg_power"), F.avg("moral").alias("avg_moral")]


def summary(mentions: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Mentions and mean scores by ``keys``."""
    return mentions.groupBy(*keys).agg(*readings()).where(F.col("mentions") >= least)


def top(rows: DataFrame, limit: int, by: str = "mentions", tie: str = "entity_id") -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(limit)


def canonical(entities: DataFrame) -> DataFrame:
    return entities.where("canonical_id IS NULL").select(F.col("id").alias("entity_id"), "name", "entity_type")


def trending(mentions: DataFrame, entities: DataFrame, limit: int = 20, start: str | None = None, end: str | None = None, country: str | None = None, source_id: int | None = None) -> DataFrame:
    """Most mentioned entities of a scope with mean scores; a single source needs three mentions."""
    rows = between(mentions, start, end)
    if country is not None:
        rows = rows.where(F.lower("country") == country.lower())
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    best = top(summary(rows, "entity_id", least=1 if source_id is None else 3), limit)
    return best.join(canonical(entities), "entity_id")


def trending_with_global(mentions: DataFrame, entities: DataFrame, limit: int = 20, country: str | None = None, source_id: int | None = None, least: int = 3) -> DataFrame:
    """A scope's trending entities, and its readings of the overall top ones that are not among them."""
    own = trending(mentions, entities, limit, country=country, source_id=source_id)
    overall = top(summary(mentions, "entity_id"), limit).select("entity_id")
    scope = mentions.where(F.lower("country") == country.lower()) if country is not None else mentions
    scope = scope.where(F.col("source_id") == source_id) if source_id is not None else scope
    more = summary(scope.join(overall, "entity_id", "left_semi"), "entity_id", least=least)
    more = more.join(own.select("entity_id"), "entity_id", "left_anti").join(canonical(entities), "entity_id")
    return own.withColumn("from_global", F.lit(False)).unionByName(more.withColumn("from_global", F.lit(True)))


def listing(mentions: DataFrame, entities: DataFrame, limit: int = 50, entity_type: str | None = None, search: str | None = None) -> DataFrame:
    """Canonical entities with their group's mentions (zero kept) and alias names; optional type and substring."""
    counts = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    aliases = entities.where("canonical_id IS NOT NULL").groupBy(F.col("canonical_id").alias("entity_id"))
    aliases = aliases.agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    rows = canonical(entities).join(counts, "entity_id", "left").join(aliases, "entity_id", "left")
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    if search is not None:
        hit = F.lower("name").contains(search.lower()) | F.coalesce(F.exists("aliases", lambda a: F.lower(a).contains(search.lower())), F.lit(False))
        rows = rows.where(hit)
    rows = rows.withColumns({"mentions": F.coalesce("mentions", F.lit(0)), "n_aliases": F.coalesce(F.size("aliases"), F.lit(0))})
    return top(rows, limit)


def detail(mentions: DataFrame, entity_id: int, limit: int = 10) -> DataFrame:
    """One entity's top sources, with its overall figures beside each."""
    rows = mentions.where(F.col("entity_id") == entity_id)
    by_source = summary(rows, "source_id", "source")
    everyone = Window.partitionBy(F.lit(0))
    total = F.sum("mentions").over(everyone)
    by_source = by_source.withColumns({"total_mentions": total, "sources": F.count("*").over(everyone)})
    return top(by_source, limit, tie="source_id")


def series(mentions: DataFrame, entity_id: int) -> DataFrame:
    """An entity's single readings by date, with their sources."""
    return mentions.where(F.col("entity_id") == entity_id).select("mention_id", "publish_date", "source", "power", "moral")


def daily(mentions: DataFrame, entity_ids: list[int] | None = None, start: str | None = None, end: str | None = None, raw: bool = False) -> DataFrame:
    """Daily means and counts, of all entities or some; ``raw`` keeps aliases apart."""
    key = "raw_id" if raw else "entity_id"
    rows = mentions if entity_ids is None else mentions.where(F.col(key).isin(entity_ids))
    return summary(between(rows, start, end), key, "publish_date")


def history(mentions: DataFrame, entity_id: int, as_of: str, days: int) -> DataFrame:
    """Daily means of the last ``days`` days up to ``as_of``, and a row without a date over all of them, whose means are of mentions, not of days."""
    last = F.lit(as_of).cast("date")
    rows = mentions.where((F.col("entity_id") == entity_id) & (F.col("publish_date") > F.date_sub(last, days)) & (F.col("publish_date") <= last))
    return rows.rollup("publish_date").agg(F.avg("power").alias("avg_power"), F.avg("moral").alias("avg_moral"), F.count("*").alias("mentions"), F.grouping("publish_date").cast("boolean").alias("overall"))


def grouped_daily(mentions: DataFrame, entity_id: int, group: str = "country", least: int = 3, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily means by country or source with enough mentions a day, and each group's unweighted mean of days."""
    days = summary(between(mentions.where(F.col("entity_id") == entity_id), start, end), group, "publish_date", least=least)
    per = Window.partitionBy(group)
    return days.withColumns({"group_mentions": F.sum("mentions").over(per), "mean_of_days_power": F.avg("avg_power").over(per), "mean_of_days_moral": F.avg("avg_moral").over(per)})


def shrunk_means(rows: DataFrame, value: str = "moral", keys: tuple[str, ...] = ("entity_id", "source_id"), within: str = "entity_id", prior: float = 10.0) -> DataFrame:
    """Means by ``keys`` pulled to the mean of ``within`` as if ``prior`` readings had it (empirical Bayes)."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    per = Window.partitionBy(within)
    overall = F.sum("total").over(per) / F.sum("n").over(per)
    return sums.withColumn("overall", overall).select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), ((F.col("total") + prior * F.col("overall")) / (F.col("n") + prior)).alias("shrunk"))


def country_top_shrunk(mentions: DataFrame, country: str, limit: int = 10, least: int = 5, start: str | None = None, end: str | None = None, prior: float = 10.0) -> DataFrame:
    """A country's top entities by source and day, each cell shrunk to its entity's mean."""
    rows = between(mentions.where(F.col("country") == country), start, end)
    best = top(summary(rows, "entity_id", least=least), limit).select("entity_id")
    return shrunk_means(rows.join(best, "entity_id", "left_semi"), keys=("entity_id", "source_id", "publish_date"), prior=prior)


def source_top_daily(mentions: DataFrame, source: str, limit: int = 10, least: int = 3, start: str | None = None, end: str | None = None) -> DataFrame:
    """A source's top entities by day, unshrunk."""
    rows = between(mentions.where(F.col("source") == source), start, end)
    best = top(summary(rows, "entity_id", least=least), limit).select("entity_id")
    return summary(rows.join(best, "entity_id", "left_semi"), "entity_id", "publish_date")


def available_countries(mentions: DataFrame, entity_id: int, dimension: str = "moral", least: int = 5) -> DataFrame:
    rows = mentions.where((F.col("entity_id") == entity_id) & F.col(dimension).isNotNull())
    return rows.groupBy("country").agg(F.count("*").alias("mentions")).where(F.col("mentions") >= least)


def counts_by_name(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions by name over raw ids; names without mentions count zero."""
    rows = entities.join(mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k")), "id", "left")
    return rows.groupBy("name").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("mentions"))


def search(mentions: DataFrame, entities: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Tiered search: prefix, then word start, then anywhere; an alias that matches returns its canonical entity."""
    q, name = query.lower(), F.lower("name")
    tier = F.when(name.startswith(q), 1).when(name.contains(" " + q), 2).when(name.contains(q), 3)
    hits = entities.withColumn("tier", tier).where("tier IS NOT NULL").groupBy(F.coalesce("canonical_id", "id").alias("entity_id")).agg(F.min("tier").alias("tier"))
    counts = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    rows = hits.join(canonical(entities), "entity_id").join(counts, "entity_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    return rows.orderBy("tier", F.desc("mentions"), "name", "entity_id").limit(limit)


def search_box(mentions: DataFrame, entities: DataFrame, query: str, limit: int = 15, short: int = 3, popular: int = 1000) -> DataFrame:
    """``search``, in which queries of at most ``short`` characters look at the ``popular`` most mentioned entities (by id on a tie) and their aliases alone."""
    if len(query) <= short:
        counts = mentions.groupBy("entity_id").agg(F.count("*").alias("k"))
        top = canonical(entities).join(counts, "entity_id", "left").orderBy(F.desc(F.coalesce("k", F.lit(0))), "entity_id").limit(popular).select(F.col("entity_id").alias("top_id"))
        entities = entities.join(top, F.coalesce("canonical_id", "id") == F.col("top_id"), "left_semi")
    return search(mentions, entities, query, limit)


def merge_exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """For every entity the canonical one of its merge key, the normalised name in lower case: the most mentioned of the group, by id on a tie."""
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("mentions"))
    key = F.lower(normalize_name("name", "entity_type")).alias("merge_key")
    rows = entities.join(counts, "id", "left").select("id", key, F.coalesce("mentions", F.lit(0)).alias("mentions"))
    # the winner by aggregation: a hot key then meets its members in a join that can be split
    winner = rows.groupBy("merge_key").agg(F.max_by("id", F.struct("mentions", -F.col("id"))).alias("merged_into"), F.count("*").alias("members"), F.sum("mentions").alias("group_mentions"))
    return rows.join(winner, "merge_key").select("id", "merge_key", "mentions", "merged_into", "members", "group_mentions")


def fuzzy_review(names: DataFrame, least: float = 0.85, prefix: int = 2) -> DataFrame:
    """(a, b, ratio): different names, in lower case, with the same first letters and a ``sequence_ratio`` of ``least`` or more; for review.

    Names whose lengths alone rule that out never meet, as lengths are part of the join's key; those with too few
    letters in common (counted in 32 bins, which can only add to them) go before texts are compared.
    """
    keys = names.select(F.lower("name").alias("name")).where("name <> ''").distinct()
    letters = F.split("name", "")
    bins = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.size(F.filter(letters, lambda c: (c != "") & (F.ascii(c) % 32 == i))))
    keys = keys.select("name", F.substring("name", 1, prefix).alias("block"), F.length("name").alias("n"), bins.alias("bins"))
    shortest = F.ceil(F.col("n") * (least / (2 - least)) - 1e-9).cast("int")
    longer = keys.withColumn("other", F.explode(F.sequence(shortest, "n"))).alias("l")
    pairs = longer.join(keys.alias("s"), (F.col("l.block") == F.col("s.block")) & (F.col("l.other") == F.col("s.n")))
    pairs = pairs.where((F.col("s.n") < F.col("l.n")) | (F.col("s.name") < F.col("l.name")))
    common = F.aggregate(F.zip_with("l.bins", "s.bins", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    near = pairs.where(2 * common >= least * (F.col("l.n") + F.col("s.n")) - 1e-9)
    near = near.select(F.least("l.name", "s.name").alias("a"), F.greatest("l.name", "s.name").alias("b"))
    return near.withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= least)


def duplicate_groups(mentions: DataFrame, entities: DataFrame, least: int = 1) -> DataFrame:
    """Names with several types: their types, and ids from the most mentioned on."""
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k"))
    rows = entities.join(counts, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    groups = rows.groupBy("name").agg(
        F.countDistinct("entity_type").alias("types"), F.sum("k").alias("mentions"), F.count("*").alias("members"), F.max_by("id", F.struct("k", -F.col("id"))).alias("first_id"),
    )
    return groups.where((F.col("types") > 1) & (F.col("mentions") >= least))


def prune_candidates(mentions: DataFrame, entities: DataFrame, samples: DataFrame, as_of: str, least_age: int = 7, most_threshold: int = 12) -> DataFrame:
    """Canonical entities that are no merge target, not preserved, seen long enough and mentioned too little.

    Each entity's threshold is a seventh of the sampled days (``samples``: day) since it was first seen, rounded up
    and at most ``most_threshold``. One that was never seen counts from the first sampled day. ``entities`` may have
    ``metadata``, a JSON text whose ``preserve`` keeps a row where it is true.
    """
    seen = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("mentions"), F.min("publish_date").alias("first_seen"))
    targets = entities.where("canonical_id IS NOT NULL").select(F.col("canonical_id").alias("id")).distinct()
    rows = entities.where("canonical_id IS NULL").join(targets, "id", "left_anti").join(seen, "id", "left")
    if "metadata" in entities.columns:
        rows = rows.where(F.coalesce(F.get_json_object("metadata", "$.preserve"), F.lit("")) != "true")
    days = samples.select("day").where("day IS NOT NULL").distinct()
    rows = rows.crossJoin(F.broadcast(days.agg(F.min("day").alias("first_day"))))  # one row
    rows = rows.withColumn("since", F.coalesce("first_seen", "first_day"))
    ages = days_since(rows.select("since").where("since IS NOT NULL").distinct(), days)
    rows = rows.join(ages, "since", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    threshold = F.least(F.ceil(F.coalesce("sample_days", F.lit(0)) / 7), F.lit(most_threshold))
    old = F.datediff(F.lit(as_of).cast("date"), "since") >= least_age
    return rows.where((F.col("mentions") <= threshold) & F.coalesce(old, F.lit(True))).select("id", "name", "mentions", threshold.cast("int").alias("threshold"))


def days_since(dates: DataFrame, days: DataFrame) -> DataFrame:
    """(since, sample_days): distinct sampled days from each distinct date on, by one running count over the calendar of both."""
    both = days.select(F.col("day").alias("since"), F.lit(1).alias("n")).unionByName(dates.select("since", F.lit(0).alias("n")))
    run = both.groupBy("since").agg(F.max("n").alias("n"), (F.min("n") == 0).alias("asked"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("since"))
    return run.select("since", F.sum("n").over(order).alias("sample_days"), "asked").where("asked").drop("asked")


def shortlist(documents: DataFrame, names: DataFrame, limit: int = 30) -> DataFrame:
    """Known names found in each text, most mentioned first: ``names`` (name, mentions) joins by words, then by substring.

    A name's first word is the join key, so no text meets all names. Words go without their text: it joins once, by id and
    size, to the names that may be in it; as rows may share both, a name found must have its key among the text's own words.
    """
    words = lambda text: F.split(text, r"[^\p{L}\p{N}]+")
    size = F.octet_length("text").alias("size")
    keys = documents.select("doc_id", size, F.explode(F.array_distinct(words(F.lower("text")))).alias("key")).where("key <> ''")
    keyed = names.select(F.lower("name").alias("name"), "mentions", words(F.lower("name"))[0].alias("key"))
    maybe = keys.join(keyed, "key")
    texts = documents.select(F.col("doc_id").alias("id"), size.alias("own_size"), F.lower("text").alias("text"))
    met = maybe.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("own_size")))
    hits = met.where(F.contains("text", "name")).where(F.array_contains(words(F.col("text")), F.col("key"))).select("doc_id", "name", "mentions").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "name")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rounded(rows: DataFrame) -> DataFrame:
    """All floating columns to 6 places."""
    return rows.select(*[r6(f"`{c}`").alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in rows.dtypes])


def prune_stats(candidates: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """By type of the canonical entities: how many there are, how many ``prune_candidates`` names, their share and both kinds' mean mentions."""
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k"))
    rows = entities.where("canonical_id IS NULL").select("id", "entity_type").join(counts, "id", "left").join(candidates.select("id", F.lit(True).alias("goes")), "id", "left")
    goes, k = F.col("goes").isNotNull(), F.coalesce("k", F.lit(0)).cast("double")
    return rows.groupBy("entity_type").agg(
        F.count("*").alias("entities"), F.count_if(goes).alias("prunable"), (F.count_if(goes) * 100.0 / F.count("*")).alias("prunable_pct"),
        F.avg(F.when(goes, k)).alias("avg_prunable"), F.avg(F.when(~goes, k)).alias("avg_kept"),
    )
