"""What each of five filters removes, in every order they can be applied in.

Native expressions give each document a mask of the filters it fails; a groupBy of the
texts supplies the least doc_id of each, for the filter of repeated texts. A part then
has 32 cells at most, and everything about its 120 orders is a sum over them, so no
document is looked at once an order.

Defined results: a null text is empty (no words, so only A fails, and E where another
is empty as well); a null source is the part of the empty string; a document with a null
doc_id fails E never, and is no earlier one for others; repeated rows are counted each,
and rows of one doc_id and text don't fail E for each other; several labels of a
document count as good or toxic if one is; an empty table gives no rows; other columns
are ignored. Texts are equal when their SHA-256 is.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazlens.llm import scratch

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
GAP = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of A to D that a text fails."""
    # the array of one makes the words a variable, so that a text is split once
    sizes = F.transform(F.array(F.array_remove(F.split(text, GAP), "")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda name, fails: F.when(fails, BIT[name]).otherwise(0)
    words = F.transform(F.array(sizes), lambda s: bit("A", s["n"] < 50) + bit("B", 100 * s["d"] < 65 * s["n"]))[0]
    return words + bit("C", 100 * capitals.cast("long") > 5 * F.length(text)) + bit("D", text.rlike("[#$%&*|]"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask of failures, and those of them that are labelled good or toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), failures(text).cast("int").alias("fails"))
    rows = scratch.written(rows, "masks")
    # only texts that two rows hold can fail; written, so that a hot text's rows can be split in the join
    least = scratch.written(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "least")
    judged = rows.join(least, "key", "left").select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("least"), BIT["E"]).otherwise(0)).alias("mask"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = scratch.written(marks.where("good = 1 or toxic = 1"), "marks")
    whole = judged.groupBy("part", "mask").agg(F.count("*").alias("n"))
    marked = judged.join(marks, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return whole.join(marked, ["part", "mask"], "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")))


def _steps() -> Column:
    """Each filter after each set of others: (letter, bit, before, at), with the (filter_order, step) it occurs in."""
    found: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for order in map("".join, itertools.permutations(FILTERS)):
        for k, f in enumerate(order):
            found.setdefault((f, sum(BIT[x] for x in order[:k])), []).append((order, k + 1))
    at = lambda places: F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in places))
    return F.array(*(F.struct(F.lit(BIT[f]).alias("bit"), F.lit(before).alias("before"), at(places).alias("at")) for (f, before), places in found.items()))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    # a part has 32 cells at most
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.select("part", "cells", F.inline(_steps()))

    def total(of, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda done, c: done + F.when(when(c["mask"]), of(c)).otherwise(0))

    n, bit, before = (lambda c: c["n"]), F.col("bit"), F.col("before")
    fails, earlier = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~earlier(m)
    orders = len(list(itertools.permutations(FILTERS)))
    summed = steps.select(
        "part",
        "at",
        total(n, lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        # of the filters that a document fails each is the first in an equal share of the orders
        total(lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )
    return summed.select("part", F.inline("at"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
    WITH words AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents
    ), masks AS (
        SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
               + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
               + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
        FROM words
    ), marks AS (
        SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
    ), cells AS (
        SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
    ), f AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b
    ), orders AS (
        SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs
        FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5
    ), steps AS (
        SELECT filter_order, step::INT AS step, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before
        FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
    ), sums AS (
        SELECT part, filter_order, step, bit,
               sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM cells, steps GROUP BY ALL
    )
    SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM sums
"""
