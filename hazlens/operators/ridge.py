"""Ridge regressions by their moments: one for all rows or one a group, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted(rows: DataFrame, features: list[str], target: str, by: list[str] | None = None, penalty: float = 0.1) -> DataFrame:
    """(by, n, intercept, slope_<feature>): least squares with ``penalty`` on the squared slopes, for each group.

    Minimises the mean squared error + penalty * the sum of squared slopes; the intercept isn't penalised. Rows go into
    means and covariances where they are and aren't exchanged; what a task solves is one small
    system a group, so groups may be many and of any size. Rows with a null or NaN in a feature or the target take no part. With a
    positive penalty a group of one row, or of equal rows, has slopes of zero.
    """
    if penalty <= 0:
        raise ValueError("a ridge needs a positive penalty")
    by, k = by or [], len(features)
    used = [*features, target]
    whole = rows
    for c in used:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    x = {c: F.col(c).cast("double") for c in used}
    moments = whole.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*(F.avg(x[c]) for c in used)).alias("__mean"),
        F.array(*(F.covar_pop(x[a], x[b]) for i, a in enumerate(features) for b in features[i:])).alias("__cov"),
        F.array(*(F.covar_pop(x[a], x[target]) for a in features)).alias("__with"),
    ).where("n > 0")
    names = [f"slope_{f}" for f in features]
    upper = np.triu_indices(k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mean, cov, along = (np.array(batch[c].tolist(), dtype=float).reshape(len(batch), -1) for c in ("__mean", "__cov", "__with"))
            system = np.zeros((len(batch), k, k))
            system[:, upper[0], upper[1]] = cov
            system[:, upper[1], upper[0]] = cov
            system[:, range(k), range(k)] += penalty
            slopes = np.linalg.solve(system, along[:, :, None])[:, :, 0]
            out = batch[[*by, "n"]].copy()
            out["intercept"] = mean[:, k] - (slopes * mean[:, :k]).sum(axis=1)
            out[names] = slopes
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema if f.name in (*by, "n"))
    return moments.mapInPandas(solve, f"{kept}, intercept double, " + ", ".join(f"`{n}` double" for n in names))


def predicted(rows: DataFrame, model: DataFrame, features: list[str], by: list[str] | None = None, out: str = "severity_score") -> DataFrame:
    """``rows`` with the score of their group's regression; null where the group has none or a feature is null."""
    names = ["intercept", *(f"slope_{f}" for f in features)]
    sides = model.select(*(F.col(b).alias(f"__{b}") for b in by or []), *(F.col(n).alias(f"__{n}") for n in names))
    score = F.col("__intercept")
    for f in features:
        score = score + F.col(f"__slope_{f}") * F.col(f)
    if by:
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
        met = rows.join(sides, same, "left")
    else:
        met = rows.join(F.broadcast(sides), F.lit(True), "left")  # one row
    return met.select(*rows.columns, score.alias(out))
