"""Labels from voters of unknown accuracy: a latent class fitted by EM over counts of vote patterns.

Reports are counted by their pattern of votes, of which m voters have no more than 3^m, so a round of
EM costs one aggregation of a small table whatever the number of reports. Each
voter is right with one probability of its own, whichever the class; voters err independently.

Defined results: a report on which all abstain teaches nothing and has a null
probability; accuracies start from the share of votes and are smoothed by one vote right and one wrong,
so that a voter that never errs stays under 1; votes other than 0 and 1 are abstentions; with no
votes at all every accuracy is a half.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazlens.staging import staged

#: Patterns are bounded by 3^voters.
MOST_VOTERS = 12


@dataclass(frozen=True)
class LabelModel:
    """prior: the share of class 1; accuracy and votes of each voter; rounds: how many were run."""

    prior: float
    accuracy: tuple[float, ...]
    votes: tuple[int, ...]
    rounds: int = 0

    def probability(self, *voters: Column) -> Column:
        """Of class 1, from a report's votes; null where all abstain."""
        voted = [v.isin(0, 1) for v in voters]
        weight = lambda a: F.log(F.lit(a) / (1 - F.lit(a)))
        parts = [F.when(ok, F.when(v == 1, weight(a)).otherwise(-weight(a))).otherwise(0.0) for v, ok, a in zip(voters, voted, self.accuracy, strict=True)]
        odds = sum(parts, F.log(F.lit(self.prior) / (1 - F.lit(self.prior))))
        any_vote = F.coalesce(voted[0], F.lit(False))
        for ok in voted[1:]:
            any_vote = any_vote | F.coalesce(ok, F.lit(False))
        return F.when(any_vote, 1 / (1 + F.exp(-odds)))


def fit(rows: DataFrame, *voters: Column, rounds: int = 25, tolerance: float = 0.0) -> LabelModel:
    """Fitted in ``rounds`` of EM, or until no accuracy moves by more than ``tolerance``."""
    if not 0 < len(voters) <= MOST_VOTERS:
        raise ValueError(f"from 1 to {MOST_VOTERS} voters")
    names = [f"v{k}" for k in range(len(voters))]
    votes = rows.select(*(F.when(v.isin(0, 1), v.cast("int")).alias(n) for v, n in zip(voters, names, strict=True)))
    counted = staged(votes.where(F.coalesce(*names).isNotNull()).groupBy(*names).agg(F.count("*").alias("n")), "patterns")
    columns = [F.col(n) for n in names]
    ones, cast = sum((F.coalesce(c, F.lit(0)) for c in columns), F.lit(0)), sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    model, posterior = None, ones / cast
    for done in range(1, rounds + 1):
        right = [F.sum(F.when(c.isNotNull(), F.col("n") * F.when(c == 1, F.col("p")).otherwise(1 - F.col("p")))).alias(f"r_{n}") for c, n in zip(columns, names, strict=True)]
        seen = [F.sum(F.when(c.isNotNull(), F.col("n"))).alias(f"s_{n}") for c, n in zip(columns, names, strict=True)]
        got = counted.withColumn("p", posterior).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p"), *right, *seen).first()
        total = got["n"] or 0
        accuracy = tuple(((got[f"r_{n}"] or 0.0) + 1) / ((got[f"s_{n}"] or 0) + 2) for n in names)
        before, model = model, LabelModel(((got["p"] or 0.0) + 1) / (total + 2), accuracy, tuple(got[f"s_{n}"] or 0 for n in names), done)
        if before and max(abs(a - b) for a, b in zip(before.accuracy, accuracy, strict=True)) <= tolerance:
            break
        posterior = model.probability(*columns)
    return model
