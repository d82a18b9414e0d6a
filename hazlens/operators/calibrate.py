"""Scores made probabilities: the monotone map that fits the observed rate best.

Scores are counted on a grid first, so that what follows is bounded by the grid and not by
the rows. Neighbours that are out of order are pooled (pool adjacent violators) within ranges
of the grid, each a task; then ranges are merged in groups, in which only blocks at
their edges can still be out of order. Pooling pools gives what pooling all at once gives.

Defined results: rows with a null score or label take no part; the label is 1 or counts as 0; equal
rates are one block; a score under all that were seen gets the first block's rate, one between two
blocks the lower one's; with no rows there is no map, and applied it gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazlens.staging import staged

#: Steps of the grid from 0 to 1: the bound on all that is pooled.
STEPS = 1_000_000
#: Ranges that are merged by one task.
FAN = 16
BLOCKS = "part long, low long, high long, n long, y long"


def _pooled(d: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order, pooled until their rates rise."""
    stack: list[list[int]] = []
    for low, high, n, y in zip(*(d[c].tolist() for c in ("low", "high", "n", "y")), strict=True):
        while stack and stack[-1][3] * n >= y * stack[-1][2]:
            was = stack.pop()
            low, n, y = was[0], n + was[2], y + was[3]
        stack.append([low, high, n, y])
    return pd.DataFrame(stack, columns=["low", "high", "n", "y"])


def _of_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of the grid, in order; batches are pooled as they come."""
    held, part = pd.DataFrame({c: [] for c in ("low", "high", "n", "y")}), 0
    for d in batches:
        if len(d):
            part = d["part"].iloc[0]
            held = _pooled(pd.concat([held, _pooled(d)]).astype("int64"))
    yield held.assign(part=part)[["part", "low", "high", "n", "y"]]


def _merged(d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values("low")
    return _pooled(d).assign(part=d["part"].iloc[0] // FAN)[["part", "low", "high", "n", "y"]]


def fit(rows: DataFrame, label: str, score: str, steps: int = STEPS, ranges: int | None = None) -> DataFrame:
    """(low, high, n, y, value): blocks of the grid of scores in order, with their rows, ones and rate. The least-squares monotone fit."""
    at = F.round(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0)) * steps).cast("long")
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(at.alias("low")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("y"))
    dealt = counts.repartitionByRange(ranges, "low") if ranges else counts.repartitionByRange("low")
    dealt = dealt.sortWithinPartitions("low").select(F.spark_partition_id().cast("long").alias("part"), "low", F.col("low").alias("high"), "n", "y")
    blocks = staged(dealt.mapInPandas(_of_range, BLOCKS), "blocks")
    many = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while many > 1:
        blocks = staged(blocks.groupBy(F.floor(F.col("part") / FAN).alias("__group")).applyInPandas(_merged, BLOCKS), "blocks")
        many = -(-many // FAN)
    return blocks.select((F.col("low") / steps).alias("low"), (F.col("high") / steps).alias("high"), "n", "y", (F.col("y") / F.col("n")).alias("value"))


def applied(score: Column, blocks: DataFrame, steps: int = STEPS) -> Column:
    """The probability for each score. The map is held by every task: it has no more blocks than the grid has steps."""
    found = blocks.select("low", "value").orderBy("low").toPandas()
    low, value = np.round(found["low"].to_numpy() * steps), found["value"].to_numpy()

    @F.pandas_udf("double")
    def probability(s: pd.Series) -> pd.Series:
        if not len(low):
            return pd.Series(np.full(len(s), np.nan)).astype("Float64").mask(s.isna() | True)
        at = np.searchsorted(low, np.round(s.clip(0, 1).to_numpy(float) * steps), side="right") - 1
        return pd.Series(value[np.maximum(at, 0)]).astype("Float64").mask(s.isna().to_numpy())

    return probability(score)
