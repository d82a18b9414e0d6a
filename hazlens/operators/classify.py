"""Whether a report tells of potential for serious injury or fatality."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, NGram, OneHotEncoder, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazlens.staging import staged


def vote(*functions: Column) -> Column:
    """Majority of labelling functions that give 1, 0 or null (abstain); null if all abstain, 1 on a tie."""
    ones = sum((F.coalesce(f, F.lit(0)) for f in functions[1:]), F.coalesce(functions[0], F.lit(0)))
    votes = sum((f.isNotNull().cast("int") for f in functions[1:]), functions[0].isNotNull().cast("int"))
    return F.when(votes > 0, (2 * ones >= votes).cast("int"))


def energy_and_control(text: Column, energy: str, control_failed: str) -> Column:
    """1 where a high-energy exposure and a failed critical control are both named."""
    return (F.coalesce(text.rlike(energy), F.lit(False)) & F.coalesce(text.rlike(control_failed), F.lit(False))).cast("int")


def decided(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def fold(key: Column, folds: int = 5) -> Column:
    """A row's fold; it depends on nothing but the key."""
    return F.pmod(key, F.lit(folds))


def soft_vote(members: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of the members' probabilities."""
    weights = weights or [1.0] * len(members)
    return sum((m * w for m, w in zip(members[1:], weights[1:])), members[0] * weights[0]) / sum(weights)


def features(text: str = "narrative", categories: tuple[str, ...] = (), size: int = 1 << 12) -> list:
    """Stages of a union of sparse features: weighted words, pairs of words and one-hot categories, in ``features``."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}\p{N}]+"),
        StopWordsRemover(inputCol="__words", outputCol="__kept"),
        NGram(n=2, inputCol="__kept", outputCol="__pairs"),
        HashingTF(inputCol="__kept", outputCol="__tf", numFeatures=size),
        HashingTF(inputCol="__pairs", outputCol="__tf2", numFeatures=size),
        IDF(inputCol="__tf", outputCol="__idf"),
    ]
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"__{c}_at", handleInvalid="keep"), OneHotEncoder(inputCol=f"__{c}_at", outputCol=f"__{c}_hot")]
    return [*stages, VectorAssembler(inputCols=["__idf", "__tf2", *(f"__{c}_hot" for c in categories)], outputCol="features")]


def featured(rows: DataFrame, keep: list[str], text: str = "narrative", categories: tuple[str, ...] = ()) -> tuple[PipelineModel, DataFrame]:
    """The fitted stages of :func:`features`, and ``rows`` as ``keep`` and ``features``.

    Texts are cut into words once: the counts are written, and weights and whatever is fitted on the features, in however many
    passes, start from them.
    """
    stages = features(text, categories)
    at = next(i for i, s in enumerate(stages) if isinstance(s, IDF))
    plain, weights, kinds, union = stages[:at], stages[at], stages[at + 1 : -1], stages[-1]
    coded = Pipeline(stages=kinds).fit(rows).stages
    counts = [s.getOutputCol() for s in plain[-2:]] + [f"__{c}_hot" for c in categories]
    counted = staged(PipelineModel([*plain, *coded]).transform(rows).select(*keep, *counts), "counts")
    fitted = weights.fit(counted)
    ready = PipelineModel([fitted, union]).transform(counted).select(*keep, "features")
    return PipelineModel([*plain, fitted, *coded, union]), ready


MEMBERS = ("lr", "nb", "rf")

#: Rows of a task that grows trees: a tree takes a number a feature, 33 kB a row, however few of them the row has.
TREE_ROWS = 8_192


def _member(name: str, label: str, seed: int):
    kind = {"lr": lambda **k: LogisticRegression(maxIter=20, regParam=0.01, **k), "nb": NaiveBayes, "rf": lambda **k: RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **k)}[name]
    return kind(labelCol=label, featuresCol="features", probabilityCol=f"__{name}_p", predictionCol=f"__{name}_c", rawPredictionCol=f"__{name}_r")


class Ensemble:
    """A soft vote of several classifiers on shared features."""

    def __init__(self, model: PipelineModel, members: tuple[str, ...], weights: list[float] | None) -> None:
        self.model, self.members, self.weights = model, members, weights

    @classmethod
    def fit(cls, rows: DataFrame, label: str, text: str = "narrative", categories: tuple[str, ...] = (), members: tuple[str, ...] = MEMBERS, weights: list[float] | None = None, seed: int = 1) -> Ensemble:
        shared, ready = featured(rows, [label], text, categories)
        dealt = ready.repartition(-(-ready.count() // TREE_ROWS) or 1) if "rf" in members else ready
        heads = [_member(m, label, seed).fit(dealt if m == "rf" else ready) for m in members]
        return cls(PipelineModel([*shared.stages, *heads]), members, weights)

    def save(self, path: str) -> None:
        """The fitted stages in ``path``/stages and what the vote needs beside them in ``path``/vote."""
        self.model.write().overwrite().save(f"{path}/stages")
        vote_of = json.dumps({"members": list(self.members), "weights": self.weights})
        SparkSession.active().createDataFrame([(vote_of,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/vote")

    @classmethod
    def load(cls, path: str) -> Ensemble:
        vote_of = json.loads(SparkSession.active().read.text(f"{path}/vote").first().value)
        return cls(PipelineModel.load(f"{path}/stages"), tuple(vote_of["members"]), vote_of["weights"])

    def score(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``rows``, a table or a stream, with sif_score, sif_pred and each member's probability."""
        out = self.model.transform(rows)
        out = out.withColumns({f"p_{m}": vector_to_array(f"__{m}_p")[1] for m in self.members})
        out = out.withColumn("sif_score", soft_vote([F.col(f"p_{m}") for m in self.members], self.weights))
        return out.withColumn("sif_pred", decided(F.col("sif_score"), threshold)).select(*rows.columns, *(f"p_{m}" for m in self.members), "sif_score", "sif_pred")


class MultiOutput:
    """One classifier for each rule over features that are computed once."""

    def __init__(self, shared: PipelineModel, heads: dict) -> None:
        self.shared, self.heads = shared, heads

    @classmethod
    def fit(cls, rows: DataFrame, labels: dict[str, str], text: str = "narrative", categories: tuple[str, ...] = ()) -> MultiOutput:
        shared, ready = featured(rows, [*dict.fromkeys(labels.values())], text, categories)
        heads = {rule: LogisticRegression(labelCol=label, maxIter=20, regParam=0.01, probabilityCol=f"__p_{rule}", predictionCol=f"__c_{rule}", rawPredictionCol=f"__r_{rule}").fit(ready) for rule, label in labels.items()}
        return cls(shared, heads)

    def score(self, rows: DataFrame, key: str = "report_id") -> DataFrame:
        """(key, rule_id, score)."""
        out = self.shared.transform(rows)
        for head in self.heads.values():
            out = head.transform(out)
        scores = F.array(*(F.struct(F.lit(rule).alias("rule_id"), vector_to_array(f"__p_{rule}")[1].alias("score")) for rule in self.heads))
        return out.select(key, F.explode(scores).alias("s")).select(key, "s.rule_id", "s.score")


class TokenBayes:
    """A Bernoulli classifier by the log odds of a report's distinct words, as two tables; fitted and applied by plain aggregation.

    weights: (term, weight), and (null, w) for the prior. A word that training never had counts nothing.
    """

    def __init__(self, weights: DataFrame) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, rows: DataFrame, label: str, words: Column, least: int = 2) -> TokenBayes:
        y = F.col(label) == 1
        sizes = rows.agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))  # one row
        terms = rows.select(F.explode(F.array_distinct(words)).alias("term"), y.alias("y")).groupBy("term").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n")).where(F.col("p") + F.col("n") >= least)
        odds = F.log((F.col("p") + 1) / (F.col("pos") + 2)) - F.log((F.col("n") + 1) / (F.col("neg") + 2))
        prior = sizes.select(F.lit(None).cast("string").alias("term"), F.log((F.col("pos") + 1) / (F.col("neg") + 1)).alias("weight"))
        return cls(terms.crossJoin(F.broadcast(sizes)).select("term", odds.alias("weight")).unionByName(prior))

    def score(self, rows: DataFrame, key: str, words: Column) -> DataFrame:
        """(key, log_odds) of every row."""
        asked = rows.select(key, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(words), F.array().cast("array<string>")))).alias("term"))
        met = asked.join(self.weights.withColumnRenamed("term", "__term"), F.col("term").eqNullSafe(F.col("__term")))
        return met.groupBy(key).agg(F.sum("weight").alias("log_odds"))


def tuned(rows: DataFrame, label: str, penalties: list[float], text: str = "narrative", folds: int = 3, seed: int = 1):
    """The best of a grid of penalties by cross-validation on the area under the precision-recall curve: (model, metric of each)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    head = LogisticRegression(labelCol=label, featuresCol="features", maxIter=20)
    grid = ParamGridBuilder().addGrid(head.regParam, penalties).build()
    search = CrossValidator(estimator=head, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"), numFolds=folds, seed=seed)
    # features don't depend on the grid, so they are made once
    shared, ready = featured(rows, [label], text)
    found = search.fit(ready)
    return PipelineModel([*shared.stages, found.bestModel]), dict(zip(penalties, found.avgMetrics))


def ridge(rows: DataFrame, target: str, penalty: float = 0.1, text: str = "narrative", categories: tuple[str, ...] = ()) -> PipelineModel:
    """A continuous score with a squared penalty, in ``severity_score``."""
    head = LinearRegression(labelCol=target, featuresCol="features", predictionCol="severity_score", elasticNetParam=0.0, regParam=penalty, standardization=False)
    shared, ready = featured(rows, [target], text, categories)
    return PipelineModel([*shared.stages, head.fit(ready)])
