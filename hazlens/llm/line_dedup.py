"""Lines that many sites share, found by the spread of their sites.

Lines travel as hashes, and the tables between the steps are small; texts move
once, to meet the places that go. Equal texts count once, at the
site of the first of them (least doc_id), so that copies of one document alone
never make its lines look like boilerplate.

A line must occur ``min_sites`` times to have as many sites, so lines are counted
first, and only those that occur often enough get a HyperLogLog sketch of their
sites, merged by aggregation. A line clearly under ``min_sites`` goes no further, one
near it is counted exactly. Of a line on enough sites the first occurrence
(least doc_id, then place) stays and all others are removed, those in copies
too; a document with nothing left but removed or blank lines is dropped. Blank
lines are never boilerplate.

Only DataFrame functions are used. What stays of a text is joined from the
stretches between the places that go, so the work is linear in its lines.

Defined results: a null text stays null and has no lines; a null site is one
site of its own; a null doc_id comes last; rows equal in doc_id and text get
equal results; an empty table gives an empty table; other columns stay, and
``n_chars`` (if there) follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazlens.llm import scratch

MIN_SITES = 10
#: Sketches have 2^LG slots, so a relative deviation of about 1.04 / sqrt(2^LG) = 1.6 %.
LG = 12
#: Estimates within this share of the threshold are counted exactly: six deviations.
BAND = 0.1

#: Parts that a line's occurrences are dealt into, by their text.
SALTS = 16

LINE = ["__l1", "__l2"]
TEXT = ["__h1", "__h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows equal in doc_id and text have equal keys, so they get equal results."""
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__h1": F.xxhash64("text"), "__h2": F.xxhash64("text", F.lit(1)), "__site": F.coalesce("source", F.lit("\0"))})


def _hashed(keyed: DataFrame) -> DataFrame:
    """Keys of each document and the hashes of its lines, null for a blank one."""
    line = lambda x: F.when(~x.rlike(r"^\s*$"), F.struct(F.xxhash64(x).alias("__l1"), F.xxhash64(x, F.lit(1)).alias("__l2")))
    return keyed.where("text is not null").select("__id", *TEXT, "__site", F.transform(F.split("text", "\n", -1), line).alias("__lines"))


def _met(lines: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """``lines`` joined with ``some`` lines, each of them SALTS times, so that one line in a third of all texts is spread over tasks."""
    salted = some.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("__salt", F.pmod("__h1", F.lit(SALTS)).cast("int")).join(salted, [*LINE, "__salt"], how).drop("__salt")


def spread_lines(hashed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(__l1, __l2, __first) of the lines on at least ``min_sites`` sites; equal texts count once.

    __first is the occurrence that stays. It lies in the first document of its text, so the other copies aren't asked.
    """
    first = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__site").alias("site"))
    texts = hashed.groupBy(*TEXT).agg(F.min_by(F.struct("__id", "__site", "__lines"), first).alias("t"))
    texts = scratch.written(texts.select(*TEXT, "t.*"), "distinct-texts")
    lines = texts.select(*TEXT, "__id", "__site", F.posexplode("__lines").alias("__at", "l")).where("l is not null").select(*TEXT, "__id", "__site", "__at", "l.*")
    often = lines.groupBy(*LINE).agg(F.count("*").alias("times")).where(F.col("times") >= min_sites).select(*LINE)
    place = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__at").alias("at"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    seen = _met(lines, often, "left_semi").groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(LG))).alias("sites"), F.min(place).alias("__first"))
    seen = scratch.written(seen.where(F.col("sites") >= min_sites * (1 - BAND)), "seen-lines")
    clear = F.col("sites") > min_sites * (1 + BAND)
    near = seen.where(~clear).select(*LINE, "__first")
    exact = _met(lines, near.select(*LINE), "left_semi").select(*LINE, "__site").distinct().groupBy(*LINE).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return seen.where(clear).select(*LINE, "__first").unionByName(near.join(exact.select(*LINE), LINE, "left_semi"))


def _removed(hashed: DataFrame, min_sites: int) -> DataFrame:
    """Document key and the places that go, in order, of each document that loses a line."""
    spread = scratch.written(spread_lines(hashed, min_sites), "boilerplate")
    places = hashed.select("__id", *TEXT, F.posexplode("__lines").alias("__at", "l")).where("l is not null").select("__id", *TEXT, "__at", "l.*")
    first = F.col("__first")
    stays = first["id"].eqNullSafe(F.col("__id")) & (first["h1"] == F.col("__h1")) & (first["h2"] == F.col("__h2")) & (first["at"] == F.col("__at"))
    return _met(places, spread, "inner").where(~stays).groupBy("__id", *TEXT).agg(F.array_sort(F.collect_set("__at")).alias("__gone"))


def _without(text: Column, gone: Column) -> Column:
    """The lines of ``text`` but those at the places ``gone``, which are in order."""
    parts = F.split(text, "\n", -1)
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(parts)))
    between = lambda s: F.transform(F.sequence(F.lit(0), F.size(s["ends"]) - 2), lambda k: F.slice(s["parts"], F.get(s["ends"], k) + 2, F.get(s["ends"], k + 1) - F.get(s["ends"], k) - 1))
    # a variable of the lambda, so that the text is split once
    return F.transform(F.array(F.struct(parts.alias("parts"), ends.alias("ends"))), lambda s: F.array_join(F.flatten(between(s)), "\n"))[0]


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns, with ``text`` freed of boilerplate, and __lines_removed and __dropped added."""
    keyed = _keyed(docs)
    gone = _removed(_hashed(keyed), min_sites).withColumnsRenamed({"__id": "__gid", "__h1": "__g1", "__h2": "__g2"})
    joined = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2")), "left")
    out = joined.withColumns({
        "__new": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__gone"))),
        # size(null) is -1 under some settings, so the null is asked for itself
        "__lines_removed": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long"),
    })
    out = out.withColumn("__dropped", F.col("__gone").isNotNull() & F.col("__new").rlike(r"^\s*$")).withColumn("text", F.col("__new"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns, "__lines_removed", "__dropped")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows that stay, with their columns."""
    return cleaned(docs, min_sites).where("not __dropped").select(*docs.columns)
