"""URL rules by a sort-merge range join.

A key is the host's labels in reverse, each followed by a full stop. A rule's key
is then a prefix of the keys of its host and all its subdomains, which is an
interval of the sorted keys; paths aren't in the key but are looked up in the
open rules. URLs are dealt by key range; a rule goes to every range that its
interval meets, so at most its depth of nesting is repeated at a range's edge.
In each range one sweep over the sorted rows keeps a stack of the host rules
whose intervals are open; a URL asks the frames of the stack for the longest
rule whose path its own path starts with.

Ranges are cut at quantiles of a sample of (key, salt), where the salt is a hash
of the row, so even one URL with a third of all rows is spread over ranges. The
sample only balances the work.

A rule is longest by the characters of host and path together, then by its host.
Defined results: a null URL, or one without ``://``, has empty host and path and
no rule; rules with a null or empty host fit nothing; equal rules must agree,
else block wins; an empty table gives an empty table; other columns are ignored; repeated rows and
null page_ids are all judged.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sampled keys a range; ranges of one job are at most MAX_RANGES, which bounds what the driver holds.
SAMPLE_A_RANGE, MAX_RANGES = 40, 4000
DEFAULT_VERDICT = "allow"

#: The rules of the standing query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host in lower case (A to Z only) and path, both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: F.Column) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _range_of(cuts: list[tuple[bytes, int]]):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows["part"] = [bisect_right(cuts, (k.encode(), s)) for k, s in zip(rows["key"], rows["salt"])]
            yield rows

    return work


def _ranges_of_rule(cuts: list[tuple[bytes, int]]):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = -(1 << 63)
        for rows in frames:
            # the interval of a prefix ends where a byte above all of UTF-8 would follow it
            span = [range(bisect_right(cuts, (k.encode(), low)), bisect_left(cuts, (k.encode() + b"\xff", low)) + 1) for k in rows["key"]]
            yield rows.loc[rows.index.repeat([len(s) for s in span])].assign(part=[p for s in span for p in s])

    return work


def _sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one or more ranges, each sorted by (part, key, kind): rules before URLs of an equal key."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    part = None
    for frame in rows:
        out: list[tuple] = []
        for p, key, kind, page, host, path, rule_host, verdict in frame[["part", "key", "kind", "page_id", "host", "path", "rule_host", "verdict"]].itertuples(index=False, name=None):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                frame_rules, sizes = stack[-1][1:]
                if path not in frame_rules or verdict == "block":
                    frame_rules[path] = (rule_host, verdict)
                if len(path) not in sizes:
                    sizes.append(len(path))
                    sizes.sort(reverse=True)
                continue
            best: tuple[int, int, str, str] | None = None
            for _, of_path, sizes in stack:
                for size in sizes:
                    found = of_path.get(path[:size]) if size <= len(path) else None
                    if found:
                        best = max(best or (-1, -1, "", ""), (len(found[0]) + size, len(found[0]), found[0] + path[:size], found[1]))
                        break
            out.append((page, host, path, best[2] if best else None, best[3] if best else None))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    # ids travel as text: in pandas a null among numbers would make them floats
    urls = pages.select(F.col("page_id").cast("string").alias("page_id"), host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    rules = rules.where("host <> '' and path is not null").select(
        F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit(".")).alias("key"), F.col("path"), F.col("host").alias("rule_host"), F.col("verdict")
    )
    ranges = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    total = pages.count()
    want = ranges * SAMPLE_A_RANGE
    sample = urls.select("key", "salt")
    if total > want:
        sample = sample.sample(min(1.0, 1.2 * want / total), seed=7)
    keys = sorted((r["key"].encode(), r["salt"]) for r in sample.limit(2 * want).toLocalIterator())
    cuts = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    dealt = urls.mapInPandas(_range_of(cuts), "page_id string, host string, path string, salt long, key string, part long").select(
        "part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("verdict")
    )
    spans = rules.mapInPandas(_ranges_of_rule(cuts), "key string, path string, rule_host string, verdict string, part long").select(
        "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("page_id"), F.lit("").alias("host"), "path", "rule_host", "verdict"
    )
    rows = dealt.unionByName(spans).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    swept = rows.mapInPandas(_sweep, "page_id string, host string, path string, rule string, verdict string")
    return swept.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
