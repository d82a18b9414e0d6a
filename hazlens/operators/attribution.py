"""Which words of a report made a linear model's score, and where they stand.

A linear head adds one number for each word, pair of words and category. Those numbers are
read off the fitted stages themselves: a report of the one word or pair goes through them,
and what it adds to the intercept is its contribution, whatever hashing and weighting lie
between. They are worked out once a distinct term, and joined back to the places of the terms, so all
contributions of a report sum to its score on the scale of the logit.

Defined results: a null text has no words; a term that hashing lets share its number with others has the sum of
what they teach, as in the model; where lower case changes a text's length places are null, since
they would point elsewhere; an unknown category adds what the model gives it; repeated
reports have their terms each.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, IDFModel, OneHotEncoderModel, StopWordsRemover, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazlens.functions import text as words_of
from hazlens.operators import patterns
from hazlens.operators.classify import MultiOutput, TokenBayes
from hazlens.staging import staged

#: Between a letter or digit and anything else.
EDGE = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])"

#: The letters whose lower case is a to z, one for one; U+212A is the sign for kelvin.
LATIN = r"A-Za-z\u212A"


def _edge(letters: str) -> str:
    """Between one of the letters and anything else."""
    return f"(?<=[{letters}])(?=[^{letters}])|(?<=[^{letters}])(?=[{letters}])"


def placed_words(text: Column, is_word: str, edge: str) -> Column:
    """(word, start, length) of the words of a lower-cased text in turn; places count from 1."""

    def listed(p: Column) -> Column:
        at = F.zip_with(p, words_of.starts(p), lambda w, s: F.struct(w.alias("word"), s.alias("start"), F.length(w).alias("length")))
        return F.filter(at, lambda x: x["word"].rlike(is_word))

    return words_of.bound(words_of.pieces(F.lower(text), edge), listed)


def _terms(reports: DataFrame, key: str, text: str, stop_words: list[str]) -> DataFrame:
    """(key, kind, term, start, length, snippet) of all words and pairs of words, as the features take them."""
    kept = F.filter(placed_words(F.col(text), r"^[\p{L}\p{N}]", EDGE), lambda x: ~x["word"].isin(stop_words))

    def both(ws: Column) -> Column:
        single = F.transform(ws, lambda x: F.struct(F.lit("word").alias("kind"), x["word"].alias("term"), x["start"].alias("start"), x["length"].alias("length")))
        many = F.greatest(F.size(ws) - 1, F.lit(0))
        pair = lambda a, b: F.struct(F.lit("pair").alias("kind"), F.concat(a["word"], F.lit(" "), b["word"]).alias("term"), a["start"].alias("start"), (b["start"] + b["length"] - a["start"]).alias("length"))
        return F.concat(single, F.zip_with(F.slice(ws, F.lit(1), many), F.slice(ws, F.lit(2), many), pair))

    same = F.length(F.lower(text)) == F.length(text)
    # with a row number in the same step, nothing works the words out twice
    found = reports.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("__row"), key, F.col(text).alias("__text"), same.alias("__same"), words_of.bound(kept, both).alias("__t"))
    rows = found.select("__row", key, "__text", "__same", F.inline("__t"))
    snippet = F.substring("__text", F.col("start"), F.col("length"))
    return rows.select(key, "kind", "term", *(F.when(F.col("__same"), c).alias(n) for n, c in (("start", F.col("start")), ("length", F.col("length")), ("snippet", snippet))))


def _added(model: MultiOutput, rows: DataFrame, keep: list[str], categories: bool) -> DataFrame:
    """``keep`` and (rule_id, contribution) of rows with __kept and __pairs, and categories if they have them."""
    kinds = (HashingTF, IDFModel, VectorAssembler, *((StringIndexerModel, OneHotEncoderModel) if categories else ()))
    for stage in model.shared.stages:
        if isinstance(stage, OneHotEncoderModel) and not categories:
            size = stage.categorySizes[0] - int(stage.getDropLast())
            rows = rows.withColumn(stage.getOutputCol(), array_to_vector(F.array_repeat(F.lit(0.0), size)))
        elif isinstance(stage, kinds):
            rows = stage.transform(rows)
    for head in model.heads.values():
        rows = head.transform(rows)
    parts = F.array(*(F.struct(F.lit(rule).alias("rule_id"), (vector_to_array(head.getRawPredictionCol())[1] - head.intercept).alias("contribution")) for rule, head in model.heads.items()))
    return rows.select(*keep, F.inline(parts))


NONE = "array<string>"


def contributions(model: MultiOutput, reports: DataFrame, key: str = "report_id", text: str = "narrative", categories: tuple[str, ...] = ()) -> DataFrame:
    """(key, rule_id, kind, term, start, length, snippet, contribution): what each word, pair and category adds to the logit of each rule.

    The row of kind ``intercept`` is there once a report and rule, so that all of them sum to the logit.
    """
    stop_words = next(s for s in model.shared.stages if isinstance(s, StopWordsRemover)).getStopWords()
    terms = staged(_terms(reports, key, text, stop_words), "terms")
    empty = F.array().cast(NONE)
    vocabulary = terms.select("kind", "term").distinct()
    only = lambda kind: F.when(F.col("kind") == kind, F.array("term")).otherwise(empty)
    # written, so that a term of very many places can be split in the join
    worth = staged(_added(model, vocabulary.withColumns({"__kept": only("word"), "__pairs": only("pair")}), ["kind", "term"], False), "worth")
    out = terms.join(worth, ["kind", "term"]).select(key, "rule_id", "kind", "term", "start", "length", "snippet", "contribution")
    nowhere = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("snippet")]
    if categories:
        named = _added(model, reports.select(key, *categories).withColumns({"__kept": empty, "__pairs": empty}), [key, *categories], True)
        out = out.unionByName(named.select(key, "rule_id", F.lit("category").alias("kind"), F.concat_ws(",", *categories).alias("term"), *nowhere, "contribution"))
    base = F.array(*(F.struct(F.lit(rule).alias("rule_id"), F.lit(float(head.intercept)).alias("contribution")) for rule, head in model.heads.items()))
    return out.unionByName(reports.select(key, F.inline(base)).select(key, "rule_id", F.lit("intercept").alias("kind"), F.lit(None).cast("string").alias("term"), *nowhere, "contribution"))


def justified(asked: DataFrame, parts: DataFrame, k: int = 3, key: str = "report_id") -> DataFrame:
    """The ``k`` places that speak most for each asked (key, rule_id), best first; those that speak against are no evidence."""
    spans = parts.where("start is not null and contribution > 0").join(asked.select(key, "rule_id").distinct(), [key, "rule_id"], "left_semi")
    return patterns.top_per_group(spans, [key, "rule_id"], [F.desc("contribution"), F.col("start"), F.col("length")], k)


def bayes_spans(model: TokenBayes, reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, start, length, snippet, contribution) of each known distinct word of a report, where it first stands.

    With the prior, which stands nowhere, they sum to the log odds. Words are runs of a to z, as in the model's fit.
    """
    same = F.length(F.lower(text)) == F.length(text)
    # where places are those of the text itself it is cut as it stands, so that snippets are its pieces
    cut = F.when(same, words_of.pieces(F.col(text), _edge(LATIN))).otherwise(words_of.pieces(F.lower(text), _edge("a-z")))

    def listed(c: Column) -> Column:
        snippet = lambda x, s: F.when(c["same"], x).otherwise(F.substring(F.col(text), s, F.length(x)))
        at = F.zip_with(c["p"], words_of.starts(c["p"]), lambda x, s: F.struct(F.lower(x).alias("term"), s.alias("start"), F.length(x).alias("length"), snippet(x, s).alias("snippet")))
        return F.sort_array(F.filter(at, lambda x: x["term"].rlike("^[a-z]")))

    # the words of a report are one list: in order of word and place, the first of each is kept before rows are made
    first = words_of.bound(words_of.bound(F.struct(same.alias("same"), cut.alias("p")), listed), lambda ws: F.filter(ws, lambda x, i: (i == 0) | (F.get(ws, i - 1)["term"] != x["term"])))
    # with the number of the row in the same step, and used, no filter moves below it and works the words out again
    found = reports.select(F.monotonically_increasing_id().alias("__row"), key, first.alias("__w")).select("__row", key, F.inline("__w")).where("__row >= 0")
    met = found.join(model.weights.where("term is not null"), "term")
    return met.select(key, "term", "start", "length", "snippet", F.col("weight").alias("contribution"))
