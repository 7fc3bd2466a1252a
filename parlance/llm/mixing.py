"""Mixing sources to target weights by entropy balancing.

Each source's words shall come to its target. Of all document rates that do so, entropy balancing takes those
closest to one in relative entropy; they are exponential in the document's size u (in units of its source's
mean): rate = exp(l * u), at most ``most``. The multipliers l solve the convex dual, source by source, by
Newton steps; each step is one aggregation over (source, size) counts, so it does not depend on how many
documents share a source. Rates are then rounded to copies: a document's fraction against a hash of its id and
text, shifted for each source as far as the target allows. Where the next document is too long for what is
missing, shorter ones behind it fill that in further passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, split_words

WEIGHTS = (3, 1, 2)
STEPS, AT_ONCE = 100, 4
#: Sources up to which their tables are broadcast.
FEW = 20_000
TOLERANCE = 1e-7
#: Rates are summed in units of 1 / UNIT.
UNIT = 1 << 24
#: Parts in which each round of the search for the rounding shift divides what is left.
PARTS = 8192
#: Passes of the rounding: first all documents, then those of at most such a part of the missing words; a source
#: that misses at most CLOSE of its target needs no more passes.
PASSES, CLOSE = (0, 16, 1), 0.001


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows of ``sizes`` (source, source_size, ...) with target added: ``share`` of all words by weight, none above ``most`` times its size.

    Weights repeat over the sources in order of code points, null last. What a source cannot take is shared
    anew by weight: the fixed point is min(most * size, level * weight) with one level for all, found from
    running sums in order of size over weight. Needs share <= most. One row for each source goes through it.
    """
    everywhere = Window.partitionBy(F.lit(0))
    order = everywhere.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_level = everywhere.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everywhere) - F.col("filled")) / F.col("open"))
    # the first source that the level does not fill gives the level of all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("final", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everywhere)["level"])
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))).select(*sizes.columns, "target")


def _multipliers(counts: DataFrame, most: float, hint) -> DataFrame:
    """(key, l) from (key, size, n, mean, target): Newton on the dual, kept inside a shrinking bracket.

    Sums are of whole numbers (rates in units of 1 / UNIT), so they do not depend on the order of rows and reruns agree.
    """
    rows = counts.where("size > 0")
    ceiling = F.log(F.lit(most))
    # at l = ln(most) * mean even a document of one word is at its most; at -60 * mean it is next to nothing
    # and that is the answer where the target is all that a source can give
    full = F.max("target") >= most * F.sum(F.col("n") * F.col("size"))
    top = ceiling * F.max("mean")
    state = rows.groupBy("key").agg(F.when(full, top).otherwise(0.0).alias("l"), (-60.0 * F.max("mean")).alias("lo"), top.alias("hi"), full.alias("done"))

    def newton(state: DataFrame) -> DataFrame:
        power = F.col("l") * F.col("size") / F.col("mean")
        rate = F.floor(F.least(F.lit(most), F.exp(F.least(F.lit(50.0), power))) * UNIT).cast("decimal(12,0)")
        size = F.col("size").cast("decimal(11,0)")
        words = F.col("n").cast("decimal(14,0)") * size
        sums = rows.join(hint(state), "key").groupBy("key", "l", "lo", "hi", "done").agg(
            F.max("target").alias("goal"),
            (F.sum(words * rate).cast("double") / UNIT).alias("got"),
            (F.sum(F.when(power < ceiling, words * rate * size)).cast("double") / UNIT / F.max("mean")).alias("slope"),
        )
        sums = sums.withColumn("gap", F.col("got") - F.col("goal"))
        lo, hi = F.when(F.col("gap") < 0, F.col("l")).otherwise(F.col("lo")), F.when(F.col("gap") >= 0, F.col("l")).otherwise(F.col("hi"))
        near = F.col("done") | (F.abs("gap") <= TOLERANCE * F.col("goal"))
        sums = sums.select("key", "l", lo.alias("lo"), hi.alias("hi"), near.alias("near"), (F.col("l") - F.try_divide("gap", "slope")).alias("newton"))
        step = F.when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        closed = F.col("hi") - F.col("lo") <= 1e-9 * F.greatest(F.lit(1.0), F.abs("l"))
        return sums.select("key", F.when(F.col("near"), F.col("l")).otherwise(step).alias("l"), "lo", "hi", (F.col("near") | closed).alias("done"))

    for _ in range(STEPS // AT_ONCE):
        for _ in range(AT_ONCE):
            state = newton(state)
        state = materialize(state, "dual")
        if state.where("not done").isEmpty():
            return state.select("key", "l")
    raise RuntimeError("the dual of some source did not converge")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Rows with size, source_size, target, copies and taken added; every row of ``docs`` (doc_id, text, source, ...) stays.

    size counts words of the whole text, none for null. A null source is a source of its own. A source without
    words has target 0 and takes nothing. Rows alike in doc_id and text in a source are rounded alike, so where one
    is repeated very often its source comes as near its target as that group allows. Columns of ``docs`` that have
    one of the new names, in any case, are replaced; all others pass, whatever they are called. Without rows there is no result row.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    sized = own.select(
        F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.size(split_words(F.col("text"))).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("key"), _draw().alias("draw"),
    )
    compact = materialize(sized.select("key", F.col("row.source").alias("source"), "size", "draw"), "sizes")
    counts = compact.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    sources = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    goals = targets(sources, weights, share, float(most))
    goals = materialize(goals.withColumn("mean", F.col("source_size") / F.col("documents")), "goals")
    # tables of one row for each source: broadcast where they are short
    hint = F.broadcast if goals.count() <= FEW else (lambda df: df)
    duals = _multipliers(counts.select("key", "size", "n").join(hint(goals.select("key", "target", "mean")), "key"), float(most), hint)
    per_source = materialize(goals.join(duals, "key", "left").withColumn("l", F.coalesce("l", F.lit(0.0))), "rates")
    events = compact.where("size > 0").join(hint(per_source.select("key", "l", "mean")), "key")
    events = events.select("key", "size", F.explode(F.array(*_moments(most))).alias("at"))
    # besides, one of no words before all others, so that every source always has a row
    start = per_source.select("key", F.lit(0).cast("long").alias("size"), F.lit(-_span(most)).cast("long").alias("at"))
    events = materialize(events.unionByName(start), "events")
    rule = per_source.select("key", F.struct("target", F.lit(0).cast("long").alias("got"), F.array().cast("array<struct<below:bigint,shift:bigint>>").alias("cuts")).alias("r"))
    rule = materialize(_widen(events, rule, PASSES[0], most, hint), "cuts")
    if not rule.where(F.col("r.target") - F.col("r.got") > CLOSE * F.col("r.target")).isEmpty():
        for part in PASSES[1:]:
            rule = _widen(events, rule, part, most, hint)
        rule = materialize(rule, "cuts")
    placed = sized.join(hint(per_source.select("key", "source_size", "target", "mean", "l").join(rule.select("key", "r.cuts"), "key", "left")), "key")
    copies = sum((F.when(_taken(e, F.col("cuts")), 1).otherwise(0) for e in _moments(most)), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(1)).cast("long")
    # in two steps: beside row.* its fields' names would hide the columns that copies are made of
    out = placed.select("row", "size", "source_size", "target", copies.alias("copies"))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: Columns that the mix adds.
NEW = ("size", "source_size", "target", "copies", "taken")
SCALE = 1 << 36


def _draw():
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(SCALE))


def _moments(most: int) -> list:
    """The shifts, in units of 1 / SCALE, beyond which a document has its first, second, ... copy."""
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("l") * F.col("size") / F.col("mean"))))
    return [F.lit(k * SCALE) - F.floor(rate * SCALE).cast("long") - F.col("draw") for k in range(1, most + 1)]


def _taken(at, cuts):
    """Whether a copy whose moment is ``at`` is within one of its source's ``cuts``."""
    return F.coalesce(F.exists(cuts, lambda c: (F.col("size") <= c["below"]) & (at < c["shift"])), F.lit(False))


def _span(most: int) -> int:
    """All moments are above -span and below span."""
    return (most + 2) * SCALE


def _widen(events: DataFrame, rule: DataFrame, part: int, most: int, hint) -> DataFrame:
    """``rule`` (key, r: target, got, cuts) with one more cut, which lets in what words are missing.

    In the first pass (``part`` 0) all documents count; in others those not yet taken of at most a ``part``-th of
    what is missing. They go in order of their moments as long as the target is not passed; at the last pass to the
    nearest. Each round of the search sums words by part of the interval left, so no source is gathered.
    """
    missing = F.col("r.target") - F.col("r.got")
    below = F.when(missing > CLOSE * F.col("r.target"), F.floor(missing / part).cast("long")).otherwise(F.lit(0)) if part else F.lit((1 << 63) - 1)
    state = rule.select("key", F.struct("r.target", "r.cuts", below.alias("below"), F.lit(-_span(most)).cast("long").alias("lo"), F.col("r.got").alias("base")).alias("s"))
    by_part = Window.partitionBy("key").orderBy("part")
    width = 2 * _span(most)

    def inside(state: DataFrame, width: int) -> DataFrame:
        rows = events.join(hint(state), "key").where((F.col("at") >= F.col("s.lo")) & (F.col("at") < F.col("s.lo") + width) & (F.col("size") <= F.col("s.below")))
        return rows.where(~_taken(F.col("at"), F.col("s.cuts")) | (F.col("size") == 0)) if part else rows

    while width > 1:
        step = -(-width // PARTS)
        sums = inside(state, width).groupBy("key", F.floor((F.col("at") - F.col("s.lo")) / step).alias("part")).agg(F.sum("size").alias("words"), F.first("s").alias("s"))
        run = sums.withColumn("after", F.col("s.base") + F.sum("words").over(by_part))
        # the part in which the words reach the target, or else the last
        short = F.col("after") < F.col("s.target")
        chosen = run.groupBy("key").agg(F.min_by(F.struct("s", "part", (F.col("after") - F.col("words")).alias("before")), F.struct(short, F.when(short, -F.col("part")).otherwise(F.col("part")))).alias("c"))
        state = chosen.select("key", F.struct("c.s.target", "c.s.cuts", "c.s.below", (F.col("c.s.lo") + F.col("c.part").cast("long") * step).alias("lo"), F.col("c.before").alias("base")).alias("s"))
        width = step
    # the documents at the last moment itself: with them if that does not pass the target, or at the last pass if it is nearer
    edge = inside(state, 1).groupBy("key").agg(F.sum("size").alias("words"), F.first("s").alias("s"))
    after, base, target = F.col("s.base") + F.col("words"), F.col("s.base"), F.col("s.target")
    more = after <= target if part != PASSES[-1] else F.abs(after - target) < F.abs(base - target)
    cut = F.struct(F.col("s.below").alias("below"), F.when(more, F.col("s.lo") + 1).otherwise(F.col("s.lo")).alias("shift"))
    return edge.select("key", F.struct(target.alias("target"), F.when(more, after).otherwise(base).alias("got"), F.array_append("s.cuts", cut).alias("cuts")).alias("r"))
