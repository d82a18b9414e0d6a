"""Recurring precursor patterns: the tables behind a dashboard."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazlens.functions.text import bound
from hazlens.operators.heads import COMMON, LONGEST
from hazlens.staging import staged


@dataclass(frozen=True)
class Filters:
    """A composable choice of rows: equal values by column, a time range, and rules of which one must apply."""

    equal: dict[str, list] = field(default_factory=dict)
    since: str | None = None
    until: str | None = None
    rules: tuple[str, ...] = ()
    ts: str = "event_ts"

    def apply(self, df: DataFrame) -> DataFrame:
        for name, values in self.equal.items():
            df = df.where(F.col(name).isin(*values))
        if self.since:
            df = df.where(F.col(self.ts) >= F.lit(self.since).cast("timestamp"))
        if self.until:
            df = df.where(F.col(self.ts) < F.lit(self.until).cast("timestamp"))
        if self.rules:
            df = df.where(F.arrays_overlap("rules", F.array(*map(F.lit, self.rules))))
        return df

    def cell(self, **key) -> Filters:
        """These filters and one cell of an aggregate: the way from a count to its reports."""
        return Filters({**self.equal, **{k: [v] for k, v in key.items()}}, self.since, self.until, self.rules, self.ts)


def by_dimension(rows: DataFrame, dimensions: list[str], precursor: Column) -> DataFrame:
    """Reports and precursors by dimension."""
    return rows.groupBy(*dimensions).agg(F.count("*").alias("n"), F.count_if(precursor).alias("precursors"))


def recurring(rows: DataFrame, dimensions: list[str], least: int) -> DataFrame:
    """Combinations that occur ``least`` times or more."""
    return rows.groupBy(*dimensions).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def trend(rows: DataFrame, ts: str, unit: str, by: list[str] | None = None) -> DataFrame:
    """Counts by calendar unit."""
    return rows.groupBy(F.date_trunc(unit, ts).alias("bucket"), *(by or [])).agg(F.count("*").alias("n"))


def daily_filled(rows: DataFrame, ts: str, by: str) -> DataFrame:
    """Counts by day and group, with 0 for the days between a group's first and last without any."""
    daily = rows.groupBy(by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    span = daily.groupBy(by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(by, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily, [by, "day"], "left").select(by, "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def moving_average(series: DataFrame, by: str, at: str, value: str, back: int) -> DataFrame:
    """The mean over a row and the ``back`` before it in its series."""
    frame = Window.partitionBy(by).orderBy(at).rowsBetween(-back, 0)
    return series.withColumn("moving_average", F.avg(value).over(frame))


def period_change(series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The change against the row before, and its ratio."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(at))
    return series.withColumn("change", F.col(value) - before).withColumn("ratio", F.try_divide(F.col(value), before))


def density(rows: DataFrame, by: list[str], precursor: Column, min_n: int = 1) -> DataFrame:
    """Precursors among all reports of a group, ranked; groups under ``min_n`` are left out, ties go by the group's key."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(precursor).alias("precursors")).where(F.col("n") >= min_n)
    groups = groups.withColumn("density", F.col("precursors") / F.col("n"))
    return placed(groups, [F.desc("density"), *map(F.col, by)])


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place in a total order. Each range of the order is numbered by itself and moved by the sizes
    of those before it, so no task sees all rows. The ranges are written, so that both uses of them agree."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    # as many rows as there are ranges
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__at", inside).join(F.broadcast(shift), "__part").withColumn("place", (F.col("__at") + F.col("__shift")).cast("int")).drop("__part", "__at", "__shift")


def changed(series: DataFrame, at: str, value: str) -> DataFrame:
    """``series``, one row a value of ``at``, with the change of ``value`` against the row before; of any length, as no task sees all of it."""
    rows = staged(placed(series, [F.col(at)]), "placed")
    before = rows.select((F.col("place") + 1).alias("place"), F.col(value).alias("__before"))
    return rows.join(before, "place", "left").withColumn("change", F.col(value) - F.col("__before")).drop("place", "__before")


#: Days of a segment: what one task sums of a series, however long it is.
SEGMENT_DAYS = 64


def change_points(series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """(by, n, change_at, mean_before, mean_after, statistic): where the mean of each series changes most.

    ``series`` has one row a group and day. The sum of deviations from the mean so far (CUSUM) is largest at the last
    day before a change; ``statistic`` is that, over the standard deviation and the root of the length: by
    chance it is over 1.36 in one series of twenty. Days are summed within segments, and segments moved by the sums of
    those before them. Null values take no part; of equal sums the first day counts; a series
    of one value, or of equal values, has no change.
    """
    rows = series.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(by, F.col(at).alias("__at"), F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__seg", F.floor(F.unix_date(F.col("__at").cast("date")) / SEGMENT_DAYS))
    parts = staged(rows.groupBy(by, "__seg").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"), F.sum(F.col("__v") * F.col("__v")).alias("__q")), "segments")
    before = Window.partitionBy(by).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(F.col(by).alias("__by"), F.col("__seg").alias("__sg"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"))
    whole = parts.groupBy(F.col(by).alias("__of")).agg(F.sum("__n").alias("n"), F.sum("__s").alias("__sum"), F.sum("__q").alias("__sq"))
    inside = Window.partitionBy(by, "__seg").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"__k": F.count("*").over(inside), "__c": F.sum("__v").over(inside)})
    summed = summed.join(shift, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__seg") == F.col("__sg"))).join(whole, F.col(by).eqNullSafe(F.col("__of")))
    k, c = F.col("__k") + F.col("__n0"), F.col("__c") + F.col("__s0")
    mean, apart = F.col("__sum") / F.col("n"), F.abs(c - k * F.col("__sum") / F.col("n"))
    spread = F.sqrt(F.greatest(F.col("__sq") / F.col("n") - mean * mean, F.lit(0.0)))
    # the last day has nothing behind it
    scored = summed.where(k < F.col("n")).select(by, "n", F.col("__at").alias("change_at"), (c / k).alias("mean_before"), ((F.col("__sum") - c) / (F.col("n") - k)).alias("mean_after"), F.try_divide(apart, spread * F.sqrt("n")).alias("statistic"), F.round(apart, 9).alias("__a"))
    found = scored.where("statistic > 1e-9").groupBy(by, "n").agg(F.min_by(F.struct("change_at", "mean_before", "mean_after", "statistic"), F.struct(-F.col("__a"), "change_at")).alias("r"))
    return found.select(by, "n", "r.*")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ranks are limited before rows are exchanged."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def drilldown(rows: DataFrame, levels: list[str], aggregates: list[Column], how: str = "rollup") -> DataFrame:
    """Totals by levels (rollup) or by every combination of them (cube), with the level in ``level``."""
    grouped = rows.rollup(*levels) if how == "rollup" else rows.cube(*levels)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *aggregates)


def cooccurring(tagged: DataFrame, rules: str = "rules") -> DataFrame:
    """How many reports each pair of rules shares. Pairs are made within a report's own few rules."""
    pairs = F.flatten(F.transform(rules, lambda a: F.transform(F.filter(rules, lambda b: b > a), lambda b: F.struct(a.alias("rule_a"), b.alias("rule_b")))))
    return tagged.select(F.explode(pairs).alias("p")).groupBy("p.rule_a", "p.rule_b").agg(F.count("*").alias("n"))


def transitions(rows: DataFrame, by: str, at: list[str], state: str) -> DataFrame:
    """How often a state follows another within a group; the first of ``at`` is a time, and all of it is distinct in a group.

    Days are followed by themselves and then joined by their first and last state, so a group with
    a third of all rows is worked on a day a task.
    """
    order = F.struct(*at)
    dated = rows.where(F.col(state).isNotNull()).withColumn("__day", F.to_date(at[0]))
    after = F.lead(state).over(Window.partitionBy(by, "__day").orderBy(*at))
    inside = dated.select(F.col(state).alias("state"), after.alias("next_state"))
    days = dated.groupBy(by, "__day").agg(F.min_by(state, order).alias("first"), F.max_by(state, order).alias("last"))
    between = days.select(F.col("last").alias("state"), F.lead("first").over(Window.partitionBy(by).orderBy("__day")).alias("next_state"))
    steps = inside.unionByName(between).where(F.col("next_state").isNotNull())
    return steps.groupBy("state", "next_state").agg(F.count("*").alias("n"))


def chains(rows: DataFrame, by: str, at: list[str], state: str, steps: list[str], days: int) -> DataFrame:
    """Each row of the last of ``steps`` that ends a chain of them in order within ``days``: its group and ``at``, and ``began``, the latest time such a chain can begin.

    ``at`` is a time and what makes it distinct in a group. A running maximum carries along, for each step,
    the latest beginning of a chain that has come so far. A chain lies in one span of ``days`` and the one before it,
    so a row goes to its own span and, as a mark, to the next: two spans a task at most, however
    many rows a group has. Rows without a time, a group or one of the states take no part.
    """
    span = days * 86_400_000_000
    ts = F.unix_micros(F.col(at[0]).cast("timestamp"))
    keep = rows.where(F.col(state).isin(steps) & F.col(by).isNotNull() & F.col(at[0]).isNotNull()).select(by, *at, F.col(state).alias("__s"), ts.alias("__at"))
    own = keep.withColumns({"__span": F.floor(F.col("__at") / span).cast("long"), "__mark": F.lit(False)})
    # the last step of a chain is looked for in its own span alone
    marks = own.where(F.col("__s").isin(steps[:-1])).withColumns({"__span": F.col("__span") + 1, "__mark": F.lit(True)})
    both = own.unionByName(marks)
    order = Window.partitionBy(by, "__span").orderBy(*at)
    begun = F.when(F.col("__s") == steps[0], F.col("__at"))
    for step in steps[1:]:
        # what had come this far before this row
        both = both.withColumn("__b", begun).withColumn("__so", F.max("__b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        begun = F.when(F.col("__s") == step, F.col("__so"))
    ended = both.withColumn("__began", begun).where(~F.col("__mark") & (F.col("__s") == steps[-1]) & (F.col("__began") >= F.col("__at") - span))
    return ended.select(by, *at, F.timestamp_micros("__began").alias("began"))


def interaction(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """n, expected, lift and g of each combination of the dimensions that occurs, against their independence.

    All margins come from one pass of grouping sets over the counted combinations. ``g`` is the likelihood ratio of
    the combination and the rest, with one degree of freedom. Null is a value of a dimension like any other.
    """
    cells = staged(rows.groupBy(*dimensions).agg(F.count("*").alias("n")), "cells")
    sets = [[F.col(d)] for d in dimensions]
    margins = cells.groupingSets([*sets, []], *dimensions).agg(F.grouping_id(*dimensions).alias("__g"), F.sum("n").alias("m"))
    margins = staged(margins, "margins")
    width = len(dimensions)
    alone = lambda k: (1 << width) - 1 - (1 << (width - 1 - k))
    out = cells
    for k, d in enumerate(dimensions):
        of = margins.where(F.col("__g") == alone(k)).select(F.col(d).alias("__v"), F.col("m").alias(f"__m{k}"))
        out = out.join(of, F.col(d).eqNullSafe(F.col("__v"))).drop("__v")
    total = margins.where(F.col("__g") == (1 << width) - 1).select(F.col("m").alias("__all"))  # one row
    out = out.crossJoin(F.broadcast(total))
    n, whole = F.col("n").cast("double"), F.col("__all").cast("double")
    expected = whole
    for k in range(width):
        expected = expected * (F.col(f"__m{k}") / whole)
    out = out.withColumn("expected", expected)
    e = F.col("expected")
    part = lambda o, x: F.when((o > 0) & (x > 0), o * F.log(o / x)).otherwise(0.0)
    return out.select(*dimensions, "n", "expected", (n / e).alias("lift"), (2 * (part(n, e) + part(whole - n, whole - e))).alias("g"))


def contributors(rows: DataFrame, by: list[str], who: str, approximate: bool = False) -> DataFrame:
    """Distinct contributors by pattern; approximately for very many."""
    count = F.approx_count_distinct(who) if approximate else F.count_distinct(who)
    return rows.groupBy(*by).agg(count.alias("contributors"), F.count("*").alias("n"))


def repeats(rows: DataFrame, by: list[str], ts: str, days: int) -> DataFrame:
    """For each row the rows of its group within ``days`` before it, itself included.

    A row counts what is before it in its own span of ``days``, and, of the span before, what is not
    yet too old. So a row goes to its span and, as a mark only, to the next: two spans a task at
    most, however many rows a group has.
    """
    span = days * 86_400_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / span).cast("long")
    placed_rows = rows.withColumns({"__at": at, "__span": own, "__mark": F.lit(False)})
    marks = placed_rows.where("__at is not null").select(*by, "__at", (F.col("__span") + 1).alias("__span"), F.lit(True).alias("__mark"))
    both = placed_rows.unionByName(marks, allowMissingColumns=True)
    frame = Window.partitionBy(*by, "__span").orderBy("__at").rangeBetween(-span, 0)
    counted = both.withColumn("repeats", F.count("*").over(frame)).where(~F.col("__mark"))
    # a row without a time is counted with its like, as a window would
    return counted.drop("__at", "__span", "__mark")


def frequent(rows: DataFrame, items: str, min_support: float, min_confidence: float):
    """Frequent sets of items and the rules between them."""
    from pyspark.ml.fpm import FPGrowth

    return FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence).fit(rows)


def sequences(rows: DataFrame, sequence: str, min_support: float, longest: int) -> DataFrame:
    """(sequence, freq): what follows what in at least this share of the rows."""
    from pyspark.ml.fpm import PrefixSpan

    return PrefixSpan(sequenceCol=sequence, minSupport=min_support, maxPatternLength=longest).findFrequentSequentialPatterns(rows)


def clusters(rows: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    """``rows`` with cluster_id."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster_id").fit(rows)
    return model.transform(rows)


def term_clusters(rows: DataFrame, key: str, words: Column, least: int = 2, most: float = 0.5) -> DataFrame:
    """(key, cluster_id, weight): every report put under the word that tells it best from the others.

    That is the word with the largest count times log inverse frequency, of the words in at least ``least`` reports and at
    most a share ``most`` of them; ties go to the first word in order. Reports without such a word have a null cluster. A report's
    counts are made within its row, frequent words are met by broadcast, and only rarer ones are exchanged; keys are distinct.
    """
    counts = staged(rows.select(key, _counted(words).alias("__c")), "counts")
    terms = counts.select(key, F.inline("__c"))
    whole = counts.agg(F.count("*").alias("__all"))  # one row
    share = F.col("df") <= F.col("__all") * most
    weights = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole)).where(F.col("df") >= least)
    weights = staged(weights.select(F.col("term").alias("__term"), "df", F.when(share, F.log(F.col("__all") / F.col("df"))).alias("idf")), "weights")
    common = weights.where(F.length("__term") <= LONGEST).orderBy(F.desc("df"), "__term").limit(COMMON)
    rare = weights.join(common.select("__term"), "__term", "left_anti").where("idf is not null")
    met = F.col("term") == F.col("__term")
    here = terms.join(F.broadcast(common), met).where("idf is not null").select(key, "term", "tf", "idf")
    there = terms.join(F.broadcast(common.select("__term")), met, "left_anti").join(rare, met).select(key, "term", "tf", "idf")
    # the rows of a report lie side by side, so that each goes into its best word before anything moves
    weighed = here.unionByName(there).select(key, "term", F.round(F.col("tf") * F.col("idf"), 9).alias("weight"))
    # the first word of those with the largest weight
    best = weighed.groupBy(key).agg(F.min_by(F.struct("term", "weight"), F.struct(-F.col("weight"), "term")).alias("r"))
    return rows.select(key).join(best, key, "left").select(key, F.col("r.term").alias("cluster_id"), F.col("r.weight").alias("weight"))


def _counted(words: Column) -> Column:
    """(term, tf) of each distinct word of a list, in order."""

    def runs(ws: Column) -> Column:
        at = F.transform(ws, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
        first = F.filter(at, lambda x: (x["at"] == 0) | (F.get(ws, x["at"] - 1) != x["term"]))
        ends = lambda xs: F.concat(F.transform(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda x: x["at"]), F.array(F.size(ws)))
        return bound(first, lambda xs: F.zip_with(xs, ends(xs), lambda x, e: F.struct(x["term"].alias("term"), (e - x["at"]).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, bound(F.sort_array(words), runs))


def cluster_summary(clustered: DataFrame, words: str, precursor: Column, terms: int = 5) -> DataFrame:
    """Size, precursor share and most frequent words of each cluster."""
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg(precursor.cast("double")).alias("precursor_share"))
    counts = clustered.select("cluster_id", F.explode(words).alias("word")).groupBy("cluster_id", "word").agg(F.count("*").alias("c"))
    top = top_per_group(counts, ["cluster_id"], [F.desc("c"), F.col("word")], terms)
    listed = top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("terms"))
    return sizes.join(listed, "cluster_id", "left")
